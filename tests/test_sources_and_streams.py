"""Readers of files, staged engines, blocks of images, and streams with timers, late rows and corrections."""

import struct
import wave
from datetime import timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lecturelake.operators import audio, frames, lines, models, pixels, regions
from lecturelake.params import KeyframeParams, SpeechParams
from lecturelake.plans.stream_queries import drained_in_turn
from lecturelake.sources import media, pcm
from lecturelake.streaming import stateful


def wav(path, samples, channels=1, rate=800):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes())


@pytest.mark.parametrize("part_bytes", [1, 37, 500, 10**6])
def test_windows_do_not_depend_on_how_files_are_cut(spark, tmp_path, part_bytes):
    r = np.random.default_rng(1)
    clips = {"a": r.integers(-32768, 32767, 403), "b": r.integers(-9, 9, 8), "none": [], "stereo": r.integers(-100, 100, 606)}
    for name, v in clips.items():
        wav(tmp_path / f"{name}.wav", v, 2 if name == "stereo" else 1)
    (tmp_path / "notes.txt").write_text("no audio")
    if part_bytes == 1:
        files = [(f, (tmp_path / f).stat().st_size) for f in ("a.wav", "none.wav")]
        parts = pcm.packed(files, 7)
        assert sum(b - a for p in parts for _, a, b in p.ranges) == sum(s for _, s in files) and max(sum(b - a for _, a, b in p.ranges) for p in parts) == 7
        return
    got = {(row.clip_id.rsplit("/", 1)[1], row.window_no): (row.n, row.sum_sq) for row in media.scan_pcm_windows(spark, str(tmp_path), 0.01, 800, part_bytes).collect()}
    want = {}
    for name, v in clips.items():
        mono = np.asarray(v, float).reshape(-1, 2 if name == "stereo" else 1).mean(axis=1) / 32768
        for k in range(0, len(mono), 8):
            want[(f"{name}.wav", k // 8)] = (len(mono[k : k + 8]), (mono[k : k + 8] ** 2).sum())
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_wav_headers(spark, tmp_path):
    body = np.arange(20, dtype="<i2").tobytes()
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 800, 1600, 2, 16)
    junk = struct.pack("<4sI", b"LIST", 70_001) + b"x" * 70_002
    path = tmp_path / "odd.wav"
    path.write_bytes(b"RIFF" + struct.pack("<I", 4) + b"WAVE" + form + junk + struct.pack("<4sI", b"data", 10**6) + body)
    lay = pcm.wav_layout(pa.OSFile(str(path)), "odd")
    assert (lay.channels, lay.rate, lay.bits, lay.size) == (1, 800, 16, 40)
    assert sum(r.n for r in media.scan_pcm_windows(spark, str(path), 0.01, 800).collect()) == 20
    for content in (b"RIFFxxxx", b"RIFF" + struct.pack("<I", 4) + b"WAVE" + form, b""):
        path.write_bytes(content)
        with pytest.raises(ValueError):
            pcm.wav_layout(pa.OSFile(str(path)), "odd")
    wav(tmp_path / "rate.wav", [1, 2], rate=900)
    with pytest.raises(Exception, match="800 Hz"):
        media.scan_pcm_windows(spark, str(tmp_path / "rate.wav"), 0.01, 800).collect()


def test_probe_numbers_in_any_notation(spark, tmp_path):
    rows = ["packet,12.3456789,K__", "packet,1e3,K__", "N/A,-.5,K_", "packet, 7 ,9,K__", "packet,1d,4.,K", "packet,nan,K", "packet,5,__", "", "packet,1.5E-2,K,"]
    (tmp_path / "v1.csv").write_text("\n".join(rows))
    assert sorted(r.ts for r in media.scan_probe_csv(spark, str(tmp_path)).collect()) == [-0.5, 4.0, 7.0, 12.3456789, 1000.0]
    (tmp_path / "frames").mkdir()
    (tmp_path / "frames" / "v2.csv").write_text("frame,1e-1,I\nframe,3,P\nframe,x,I")
    found = media.scan_probe_csv_or_iframes(spark, str(tmp_path / "v1.csv"), str(tmp_path / "frames"))
    assert sorted((r.video_id, r.ts) for r in found.collect())[-1] == ("v2", 0.1) and found.count() == 6


def test_unreadable_images_have_no_pixels(spark, tmp_path):
    rows = spark.createDataFrame([("good", 0, [1, 2, 3]), ("good", 1, [4, 5, 255]), ("bad", 0, [])], "name string, place long, levels array<short>")
    media.write_gray_images(rows, str(tmp_path), 3).collect()
    found = media.scan_images(spark, str(tmp_path))
    assert sorted((r.y, r.x, r.v) for r in pixels.gray_pixels(found).collect()) == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 4), (1, 1, 5), (1, 2, 255)]
    assert [r.frame_key.rsplit("/", 1)[1] for r in pixels.unreadable_images(found).collect()] == ["bad.png"]
    assert pixels.image_laplacian_variance(found).count() == 1


def image_frame(spark, images):
    rows = [((name, v.shape[0], v.shape[1], v.shape[2], 0, v.tobytes()),) for name, v in images]
    return spark.createDataFrame(rows, "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>")


@pytest.mark.parametrize("block", [1, 3, 64])
def test_blocks_of_images_give_the_variance_of_pixels(spark, block):
    r = np.random.default_rng(2)
    images = [(f"{h}x{w}x{c}", r.integers(0, 256, (h, w, c), dtype=np.uint8)) for h, w, c in ((1, 1, 1), (1, 9, 1), (7, 1, 3), (10, 4, 3), (6, 5, 1))]
    df = image_frame(spark, images)
    want = {x.frame_key: x.laplacian_variance for x in pixels.laplacian_variance(pixels.gray_pixels(df)).collect()}
    got = {x.frame_key: x.laplacian_variance for x in pixels.image_laplacian_variance(df, block).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_a_large_image_is_not_shuffled(spark):
    v = np.random.default_rng(3).integers(0, 256, (2000, 1000, 1), dtype=np.uint8)
    found = pixels.image_laplacian_variance(image_frame(spark, [("large", v)]))
    lap = pixels.stencil(v[:, :, 0].astype(np.int64))
    assert abs(found.first().laplacian_variance - lap.var()) < 1e-6
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning(frame_key") <= 2 and plan.index("Exchange") < plan.index("MapInArrow")  # the sums alone meet


def test_engines_run_on_what_is_left(spark):
    n = 60
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5), float(i % 3)]) for i in range(n)], "frame_key long, x array<double>")

    def engine(k):
        def load():
            def predict(x):
                return np.stack([np.where(x[:, k] == 0, 10.0, 5000.0), x[:, k]], axis=1)

            return predict

        score = models.score_with_model(load, ArrayType(DoubleType()), 16, [[3]])
        return lambda rows: F.transform(F.array(score("x")), lambda r: F.struct(r[0].alias("perplexity"), r[1].cast("long").alias("useful")))[0]

    chosen, runs = models.engine_cascade(df, [(f"e{k}", engine(k)) for k in range(3)])
    every = [(i, k, f"e{k - 1}", 10.0 if i % m == 0 else 5000.0, i % m) for i in range(n) for k, m in ((1, 7), (2, 5), (3, 3))]
    want = regions.engine_select(spark.createDataFrame(every, "frame_key long, engine_ord int, engine string, perplexity double, useful long"))
    assert {tuple(r) for r in chosen.collect()} == {tuple(r) for r in want.collect()}
    calls = {r.engine: r["count"] for r in runs.groupBy("engine").count().collect()}
    assert calls == {"e0": n, "e1": sum(i % 7 != 0 for i in range(n)), "e2": sum(i % 7 != 0 and i % 5 != 0 for i in range(n))}


WINDOW = "clip_id long, window_no long, n long, sum_sq double, at timestamp"


def test_timers_close_clips_and_late_windows_come_out(spark):
    p = SpeechParams(threshold=20, window_sec=1.0, silence_sec=3.0, min_segment_sec=5, max_segment_sec=20, drop_silence_sec=8)
    r = np.random.default_rng(4)
    rows = [(c, i, 1, float(r.choice((0, 50))) ** 2, 1_700_000_000 + i) for c in range(4) for i in range(40 + 9 * c)]
    df = spark.createDataFrame(rows, "clip_id long, window_no long, n long, sum_sq double, at long").withColumn("at", F.timestamp_seconds("at"))
    first, second = df.filter("window_no < 25"), df.filter("window_no >= 25")
    late = df.filter("clip_id = 2 and window_no in (20, 24)")
    beat = spark.createDataFrame([(-1, 0, 0, 0.0)], "clip_id long, window_no long, n long, sum_sq double").withColumn("at", F.timestamp_seconds(F.lit(1_800_000_000)))
    out = drained_in_turn(lambda s: stateful.stream_silence_segments(s, p, 1, "at", "1000 seconds", 5), first, second.unionByName(late.filter("false")), late, beat)
    want = {(x.clip_id, x.seg_no, x["first"], x["last"], x.n) for x in audio.silence_segments(df, p, units=F.lit(1.0)).collect()}
    assert {(x.clip_id, x.seg_no, x["first"], x["last"], x.n) for x in stateful.settled_segments(out).collect()} == want
    assert sorted((x.clip_id, x["first"]) for x in out.filter("late").collect()) == [(2, 20), (2, 24)]


def test_late_frames_are_reported(spark):
    df = spark.createDataFrame([(lesson, i, float(50 + i % 3), [i * 77]) for lesson in (1, 2) for i in range(30)], "lesson_id long, frame_index long, score double, signature array<long>")
    early, behind = df.filter("frame_index % 4 <> 1"), df.filter("frame_index % 4 = 1")
    p = KeyframeParams(min_score=45, min_change=0.05, max_keyframes=None, signature_bits=64)
    out = drained_in_turn(lambda s: stateful.stream_keyframes(s, p), early, behind)
    assert {tuple(r) for r in stateful.late_frames(out).collect()} == {(1, 7), (2, 7)}  # 29 is newer than all before it
    kept = frames.select_keyframes(df.filter("frame_index % 4 <> 1 or frame_index = 29"), p)
    assert {tuple(r) for r in stateful.settled_keyframes(out).collect()} == {tuple(r) for r in kept.collect()}


def board_lines(spark):
    rows = [("a", 5, 1, "One line"), ("a", 6, 0, " one LINE "), ("a", 7, 0, "two"), ("b", 1, 1, "one line"), ("a", 3, 2, "ONE line"), ("a", 3, 1, "one line"), ("a", 9, 9, "  ")]
    return spark.createDataFrame(rows, "lesson_id string, frame_index long, line_no long, line string")


def test_lines_keep_their_smallest_place(spark):
    df = board_lines(spark)
    out = drained_in_turn(stateful.stream_line_union, df.filter("frame_index >= 5"), df.filter("frame_index < 5"))
    assert {tuple(r) for r in stateful.settled_lines(out).collect()} == {tuple(r) for r in lines.line_union(df).select("lesson_id", "frame_index", "line_no", "line").collect()}
    assert [r.version for r in out.filter("lesson_id = 'a' and key = 'one line'").orderBy("version").collect()] == [0, 1]


def test_a_memory_of_lines_that_ends(spark, tmp_path):
    df = board_lines(spark)
    df.write.parquet(str(tmp_path / "in"))
    stream = stateful.stream_line_union(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), timedelta(days=1))
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-check").trigger(once=True).start().awaitTermination(60)
    assert stateful.settled_lines(spark.read.parquet(out)).count() == 3


def test_small_parts_share_tasks(spark, tmp_path):
    for k in range(60):
        wav(tmp_path / f"{k:02d}.wav", list(range(k, k + 30)))
    files = [(f"{k}.wav", 104) for k in range(600)]
    parts = pcm.packed(files, 50)
    some = pcm.dealt(parts, 64)
    assert len(parts) > 1000 and len(some) == 64 and [r for p in some for r in p.ranges] == [r for p in parts for r in p.ranges]
    assert len(pcm.dealt(parts, 64, 500)) == -(-600 * 104 // 500) and pcm.dealt(parts[:3], 64) == parts[:3]
    found = media.scan_pcm_windows(spark, str(tmp_path), 0.01, 800, 7)
    assert found.rdd.getNumPartitions() == 64
    want = {(f"{k:02d}.wav", w): len(range(k, k + 30)[w * 8 : w * 8 + 8]) for k in range(60) for w in range(4)}
    assert {(r.clip_id.rsplit("/", 1)[1], r.window_no): r.n for r in found.collect()} == want
