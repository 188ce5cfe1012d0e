"""Rules of the lecture operators on tiny frames, with results worked out by hand or by a plain restatement."""

import json
import math
import random
import struct
import wave
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lecturelake.functions import numeric as N
from lecturelake.functions import text as X
from lecturelake.operators import answers, assemble, audio, frames, lines, models, pixels, regions
from lecturelake.params import KeyframeParams, LineParams, SamplingParams, SpeechParams
from lecturelake.sources import media, sinks


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("r")).first().r


def board(spark, rows):
    return spark.createDataFrame(rows, "lesson_id string, frame_index long, line_no long, line string")


def test_line_union_keeps_first_sight_and_folds_case(spark):
    rows = [("a", 1, 0, " Straße "), ("a", 2, 0, "STRASSE"), ("a", 0, 1, "strasse"), ("a", 0, 0, "\t"), ("b", 0, 0, "Straße"), ("a", 1, 1, None), ("a", 3, 0, " x ")]
    got = {(r.lesson_id, r.frame_index, r.line) for r in lines.line_union(board(spark, rows)).collect()}
    assert got == {("a", 0, "strasse"), ("b", 0, "Straße"), ("a", 3, "x")}


def subsumed(texts, min_len):
    keys = [t.strip().lower().replace("ß", "ss") for t in texts]
    return {i for i, k in enumerate(keys) if len(k) >= min_len and any(len(o) > len(k) and k in o for o in keys if len(o) >= min_len)}


@pytest.mark.parametrize("min_len", [8, 3])
def test_substring_dedupe_matches_plain_rule(spark, min_len):
    r = random.Random(min_len)
    words = ["alpha", "beta", "gamma", "de", "f", "", "longerword", "x=1"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 5))) for _ in range(60)]
    texts += [t[r.randint(0, 3) : r.randint(6, 20)] for t in texts] + ["sentence with words", "nce wit", "ence with wo", "equal line", "equal line"]
    got = lines.substring_dedupe(board(spark, [("a", 0, i, t) for i, t in enumerate(texts)]), min_len).select("line_no").collect()
    assert {r.line_no for r in got} == set(range(len(texts))) - subsumed(texts, min_len)


def test_noise_filters_and_low_value(spark):
    rows = [("a", 0, 0, "  ab12  "), ("a", 0, 1, "abcde 123456789"), ("a", 0, 2, "x+y=z"), ("a", 0, 3, "日本語の文章です。黒板の字")]
    assert {r.line_no for r in lines.noise_line_filter(board(spark, rows), LineParams(min_chars=12, min_letters=5)).collect()} == {1, 3}
    assert {r.line_no for r in lines.noise_line_filter_math(board(spark, rows), LineParams(min_chars=4, min_letters=5)).collect()} == {1, 2, 3}
    for text, low in (("", True), (None, True), ("abcdefgh", False), ("--", True), ("12 ab", True), ("123 abcd", False), ("1234567890123", False)):
        assert one(spark, X.low_value(F.col("t")), t=text) is low


def test_text_functions(spark):
    assert one(spark, X.ascii_only(F.col("t")), t=" aéb  漢 c ") == "a b c"
    assert one(spark, X.drop_singleton_tokens(F.col("t")), t="a I x 3D x=5 - ab -- b1") == "a I 3D x=5 ab -- b1"
    assert sorted(one(spark, X.tokenize_mixed(F.col("t")), t="Ab ab 12 漢字 x2")) == ["12", "2", "ab", "x", "字", "漢"]
    assert one(spark, X.keyword_overlap(F.col("a"), F.col("b")), a="", b="") == 1.0
    assert one(spark, X.keyword_overlap(F.col("a"), F.col("b")), a="one two", b="two three") == pytest.approx(1 / 3)
    assert one(spark, X.text_chunks(F.col("t"), 4), t="abcdefghi") == ["abcd", "efgh", "i"]
    assert one(spark, X.text_chunks(F.col("t"), 4), t="") == []
    assert one(spark, X.latin1_safe(F.col("t")), t="aé漢") == "aé?"
    prompt = one(spark, X.alignment_prompt(F.col("a"), F.col("b")), a="  ", b=" hi ")
    assert [m.role for m in prompt] == ["system", "user"] and prompt[1].content == "board_text:\n[EMPTY]\n\nspeech_text:\nhi"


def test_clarity_and_verdict_limits(spark):
    for lap, stroke, want in ((120.0, 0.0, 100.0), (40.0, 8.0, 0.0), (40.0, 0.0, 45.0), (500.0, 100.0, 55.0)):
        assert one(spark, N.clarity_total(F.col("l"), F.col("s")), l=lap, s=stroke) == pytest.approx(want)
    assert one(spark, N.clarity_label(F.col("t")), t=70.0) == "clear" and one(spark, N.clarity_label(F.col("t")), t=44.9) == "poor"
    for s, o, want in ((0.72, 0.35, "highly_aligned"), (0.72, 0.1, "partially_related"), (0.1, 0.2, "partially_related"), (0.1, 0.1, "content_mismatch")):
        assert one(spark, N.alignment_verdict(F.col("s"), F.col("o")), s=s, o=o) == want


@pytest.mark.parametrize(
    "text,want",
    [('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('so: {"a": {"b": 2}} done', '{"a": {"b": 2}}'), ("[1]", None), ("", None), (None, None), ("} {", None), ('{"a": 1} and {"b": 2}', None)],
)
def test_json_objects_in_answers(spark, text, want):
    assert one(spark, N.llm_json_object(F.col("t")), t=text) == want


def test_relevance_rows(spark):
    lessons = spark.createDataFrame([(i,) for i in range(5)], "lesson_id long")
    bodies = [(0, '{"overall_relevance": "Off_Topic", "score": "90", "evidence": "x"}'), (1, '{"score": 350, "reason": " ok ", "evidence": ["1", "", "2", "3", "4", "5", "6"]}'), (2, "nothing"), (3, '{"score": null, "evidence": []}')]
    got = {r.lesson_id: r for r in answers.relevance_rows(lessons, spark.createDataFrame(bodies, "lesson_id long, body string")).collect()}
    assert (got[0].overall_relevance, got[0].score, got[0].evidence) == ("off_topic", 90.0, ["x"])
    assert (got[1].overall_relevance, got[1].score, got[1].reason, got[1].evidence) == ("highly_relevant", 100.0, "ok", ["1", "2", "3", "4", "5"])
    assert got[2].score is None and got[2].evidence == [] and "JSON" in got[2].error
    assert got[3].overall_relevance == "off_topic" and got[3].evidence == ["No reason returned."]
    assert got[4].error == "no answer"
    assert answers.empty_relevance(lessons).filter("error = 'disabled'").count() == 5


def test_kept_indices(spark):
    rows = spark.createDataFrame([(x, i, f"line number {i}") for x in "abcdef" for i in range(4)], "lesson_id string, line_index long, line string")
    said = [("a", '{"kept_indices": [2, "1", 7.9, null, 99]}'), ("b", '{"kept_indices": []}'), ("c", '{"kept_indices": "all"}'), ("d", '{"kept_indices": [50]}'), ("e", "oops")]
    out = answers.apply_kept_indices(rows, spark.createDataFrame(said, "lesson_id string, answer string"), LineParams(filter_max_lines=3)).collect()
    got = {x: sorted(r.line_index for r in out if r.lesson_id == x) for x in "abcdef"}
    assert got == {"a": [1, 2, 3], "b": [3], "c": [0, 1, 2, 3], "d": [0, 1, 2, 3], "e": [0, 1, 2, 3], "f": [0, 1, 2, 3]}


def boxes(spark, rows):
    return spark.createDataFrame(rows, "frame_key string, ord long, x1 int, y1 int, x2 int, y2 int, class_id int, source string").withColumns({"w": F.lit(100), "h": F.lit(60)})


def test_regions(spark):
    b = boxes(spark, [("a", 1, 0, 0, 10, 10, 0, "yolo"), ("a", 2, 20, 20, 30, 30, 0, "yolo"), ("a", 3, 5, 5, 5, 50, 0, "yolo_world"), ("b", 1, -5, -5, 200, 90, 1, "heuristic")])
    assert regions.largest_roi(b).filter("frame_key = 'a'").first().ord == 1
    assert regions.largest_roi(b, last_tie=True).filter("frame_key = 'a'").first().ord == 2
    clipped = regions.roi_clip(b).filter("frame_key = 'b'").first()
    assert (clipped.x1, clipped.y1, clipped.x2, clipped.y2) == (0, 0, 100, 60)
    got = {r.frame_key: r for r in regions.roi_cascade(spark.createDataFrame([("a", 100, 60), ("c", 80, 40)], "frame_key string, w int, h int"), b).collect()}
    assert got["a"].roi_method == "yolo" and (got["c"].roi_method, got["c"].x2, got["c"].y2) == ("full_frame", 80, 40)


def test_reading_order(spark):
    det = [("f", 1, [(50.0, 10.0), (60.0, 20.0)], "world", 0.9), ("f", 2, [(0.0, 11.0), (9.0, 21.0)], "hello", 0.15), ("f", 3, [(0.0, 40.0), (9.0, 50.0)], "next", None), ("f", 4, [(0.0, 40.0), (9.0, 50.0)], "weak", 0.149), ("f", 5, [(20.0, 41.0), (29.0, 50.0)], "  ", 1.0)]
    df = spark.createDataFrame(det, "frame_key string, ord long, polygon array<struct<x:double,y:double>>, text string, conf double")
    got = [(r.line_no, r.line) for r in regions.reading_order_lines(regions.ocr_entries(df)).orderBy("line_no").collect()]
    assert got == [(0, "hello world"), (1, "next")]


def test_engine_choice(spark):
    runs = [("a", 0, "e0", 900.0, 5), ("a", 1, "e1", 500.0, 0), ("a", 2, "e2", 10.0, 50), ("b", 0, "e0", math.inf, 0), ("c", 0, "e0", 5000.0, 13), ("c", 1, "e1", 1.0, 1)]
    got = {r.frame_key: r.engine for r in regions.engine_select(spark.createDataFrame(runs, "frame_key string, engine_ord int, engine string, perplexity double, useful int")).collect()}
    assert got == {"a": "e1", "c": "e0"}


def test_sampling_and_pairing(spark):
    rows = spark.createDataFrame([("a", i, 10.0, 0.0) for i in range(20)] + [("b", i, 0.0, 40.0 * i) for i in range(20)], "lesson_id string, frame_index long, fps double, msec double")
    got = frames.sample_frames(rows, SamplingParams(every_sec=0.25)).collect()  # 2.5 frames round half to even, 6.25 to 6
    assert {r.frame_index for r in got if r.lesson_id == "a"} == set(range(0, 20, 2)) and {r.frame_index for r in got if r.lesson_id == "b"} == {0, 6, 12, 18}
    assert frames.harvest_sample(rows, SamplingParams(max_scans=0)).count() == 0
    times = spark.createDataFrame([("a", t) for t in (3.0, 1.0, 2.0)], "lesson_id string, ts double")
    files = spark.createDataFrame([("a", "kf_010.png"), ("a", "kf_009.png")], "lesson_id string, file string")
    assert [(r.ts, r.file) for r in frames.pair_frames_by_ordinal(times, files, 5).orderBy("ts").collect()] == [(1.0, "kf_009.png"), (2.0, "kf_010.png")]


def keyframe_rows(seed, n=60):
    r = random.Random(seed)
    return [(k, i, float(r.randint(30, 60) if k else r.randint(0, 40)), [r.getrandbits(63) - (r.getrandbits(1) << 63)]) for k in range(3) for i in range(n)]


def test_keyframes_follow_the_rule(spark):
    p = KeyframeParams(min_score=45, min_change=0.5, max_keyframes=7, signature_bits=64)
    rows = keyframe_rows(4)
    got = {(r.lesson_id, r.frame_index) for r in frames.select_keyframes(spark.createDataFrame(rows, "lesson_id long, frame_index long, score double, signature array<long>"), p).collect()}
    want = set()
    for k in range(3):
        last, n = None, 0
        mine = [x for x in rows if x[0] == k]
        for _, i, score, (sig,) in mine:
            if n < 7 and score >= 45 and (last is None or bin((sig ^ last) & (2**64 - 1)).count("1") / 64 >= 0.5):
                last, n = sig, n + 1
                want.add((k, i))
        if not n:
            want.add((k, max(mine, key=lambda x: x[2])[1]))
    assert got == want and len(want) > 8


def segment_rule(energies, threshold, need, least, most, drop):
    out, buf, silent, speech = [], [], 0, False
    for i, e in enumerate(energies):
        buf.append(i)
        silent, speech = (0, True) if e >= threshold else (silent + 1, speech)
        if (speech and silent >= need and len(buf) >= least) or len(buf) >= most:
            out.append((buf[0], buf[-1]))
            buf, silent, speech = [], 0, False
        elif not speech and len(buf) > drop:
            buf, silent = [], 0
    return out + ([(buf[0], buf[-1])] if buf else [])


SPEECH = SpeechParams(threshold=20, window_sec=1.0, silence_sec=3.0, min_segment_sec=5, max_segment_sec=20, drop_silence_sec=8)


def energy_rows(seed):
    r = random.Random(seed)
    return {c: [r.choice([5.0, 5.0, 30.0]) if r.random() < 0.6 else 1.0 for _ in range(r.randint(1, 90))] for c in range(8)}


def test_silence_segments_follow_the_rule(spark):
    clips = energy_rows(2)
    rows = [(c, i, 1, e * e) for c, es in clips.items() for i, e in enumerate(es)]
    got = audio.silence_segments(spark.createDataFrame(rows, "clip_id long, window_no long, n long, sum_sq double"), SPEECH, units=F.lit(1.0)).collect()
    assert {(r.clip_id, r.first, r.last) for r in got} == {(c, *s) for c, es in clips.items() for s in segment_rule(es, 20, 3, 5, 20, 8)}


def test_segment_times(spark):
    rows = [("c", 0, 2.0, 1.0, " hi "), ("c", 1, 3.0, 0.0, "x"), ("c", 2, None, 4.0, "y"), ("c", 3, 1.0, 2.0, " ")]
    got = {r.seg_no: (r.start_sec, r.end_sec, r.duration_sec) for r in audio.segment_normalize(spark.createDataFrame(rows, "clip_id string, seg_no long, start double, end double, text string")).collect()}
    assert got == {0: (2.0, 2.0, 0.0), 1: (3.0, 3.0, 0.0), 2: (0.0, 4.0, 4.0)}


def test_bands_of_rows(spark):
    inked = [*range(0, 8), *range(20, 30), *range(45, 60), *range(36, 40)]  # padded gaps of 4 and 7 rows, and a run too low
    px = spark.createDataFrame([("f", y, x, 255) for y in inked for x in range(3)], "frame_key string, y long, x long, v long")
    sizes = spark.createDataFrame([("f", 60, 100), ("g", 50, 10)], "frame_key string, h long, w long")
    bands = pixels.text_bands(px, sizes)
    assert sorted((r.band_no, r.y1, r.y2) for r in bands.collect()) == [(0, 0, 34), (1, 41, 60)]
    assert (0, 50) in {(r.y1, r.y2) for r in pixels.band_default(sizes, bands).collect()}


def test_constant_image_has_no_variance(spark):
    px = spark.createDataFrame([("f", y, x, 7) for y in range(3) for x in range(3)], "frame_key string, y long, x long, v long")
    assert pixels.laplacian_variance(px).first().laplacian_variance == 0.0


def test_diagnoses(spark):
    lessons = spark.createDataFrame([(x, True, True, 200, 90) for x in "abcdef"], "lesson_id string, harvest_ran boolean, harvest_full_frame boolean, lines_before long, lines_after long")
    rows = [("a", "full_frame", "x", 1), ("b", "yolo", "printed_full_frame", 9), ("c", "yolo", "x", 9), ("d", "yolo", "x", 0), ("e", "yolo", "x", 5)]
    lessons = lessons.withColumn("lines_after", F.when(F.col("lesson_id").isin("d", "e"), 150).otherwise(F.col("lines_after")))
    got = {r.lesson_id: r.issue for r in assemble.ocr_diagnostics(lessons, spark.createDataFrame(rows, "lesson_id string, roi_method string, ocr_source string, n_lines long")).collect()}
    assert got == {"a": "localization", "b": "mixed_fullframe_ocr", "c": "harvest_full_frame_noise", "d": "recognition_or_sparse_board", "e": "healthy_or_merge_noise", "f": "no_keyframes"}


def test_errors_and_sinks(spark, tmp_path):
    rows = [("a", "s1", 2, "late"), ("a", "s1", 1, "first"), ("a", "s2", 1, None), ("b", "s1", 0, "é")]
    errors = assemble.error_collect(spark.createDataFrame(rows, "lesson_id string, step string, ord long, message string"))
    assert {r.lesson_id: r.errors for r in errors.collect()} == {"a": {"s1": "first"}, "b": {"s1": "é"}}
    assemble.sink_lesson_json(errors, str(tmp_path / "out"))
    assert any("é" in p.read_text() for p in (tmp_path / "out").glob("rows/*/*/*.txt"))
    keyframes = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y")], "lesson_id string, frame_index long, path string")
    assemble.sink_keyframe_metadata(keyframes, str(tmp_path / "meta"))
    document = sinks.read_batches(spark, str(tmp_path / "meta")).first().document
    assert [k["frame_index"] for k in json.loads(document)["keyframes"]] == [1, 2]


def test_sources(spark, tmp_path):
    (tmp_path / "img").mkdir()
    row = b"\x00" + bytes([255, 0, 0, 0, 255, 0])  # a red and a green pixel
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    (tmp_path / "img/a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(row)) + chunk(b"IEND", b""))
    (tmp_path / "img/b.png").write_bytes(b"broken")
    images = media.scan_images(spark, str(tmp_path / "img"))
    assert images.count() == 2 and images.filter("image.height = 1").count() == 1
    assert {(r.x, r.v) for r in pixels.gray_pixels(images.filter("image.height = 1")).collect()} == {(0, 76), (1, 150)}
    (tmp_path / "wav").mkdir()
    with wave.open(str(tmp_path / "wav/c.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(struct.pack("<hh", 16384, 0) * 2000)
    got = media.scan_pcm_windows(spark, str(tmp_path / "wav")).orderBy("window_no").collect()
    assert [(r.window_no, r.n) for r in got] == [(0, 1600), (1, 400)] and got[0].sum_sq == pytest.approx(1600 / 16)
    for lesson, name, size in (("l1", "video.mp4", 40), ("l2", "image.png", 40), ("l2", "audio.mp3", 32), ("l3", "image.png", 40), ("l4", "video.mkv", 31), ("l5", "video.txt", 40)):
        (tmp_path / "up" / lesson).mkdir(parents=True, exist_ok=True)
        (tmp_path / "up" / lesson / name).write_bytes(b"x" * size)
    found = {r.lesson_id: r.reason for r in media.scan_media_manifest(spark, str(tmp_path / "up")).collect()}
    assert found["l1"] is None and found["l2"] is None and found["l3"].startswith("needs") and found["l4"] == "file too short" and found["l5"] == "video type"
    (tmp_path / "probe").mkdir()
    (tmp_path / "probe/v1.csv").write_text("N/A,1.5,K__\npacket,2.5,___\npacket,3.25,K__\n")
    assert sorted(r.ts for r in media.scan_probe_csv(spark, str(tmp_path / "probe")).collect()) == [1.5, 3.25]


def test_model_scoring_and_perplexity(spark):
    def load():
        return lambda v: v * 2.0

    score = models.score_with_model(load, DoubleType())
    assert [r.s for r in spark.range(3).select(score(F.col("id").cast("double")).alias("s")).orderBy("s").collect()] == [0.0, 2.0, 4.0]
    corpus = spark.createDataFrame([(1, "a b"), (2, "a c")], "id long, text string")
    texts = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "id long, text string")
    got = {r.id: r.perplexity for r in models.paragraph_perplexity(texts, corpus, "id").collect()}
    assert got[1] == pytest.approx(math.exp(-(math.log(3 / 5) + math.log(2 / 5)) / 2)) and math.isinf(got[2]) and math.isinf(got[3])
