"""Streaming forms give what the batch forms give."""

import test_lecture_operators as base
from pyspark.sql import functions as F

from lecturelake.operators import audio, frames
from lecturelake.params import KeyframeParams
from lecturelake.streaming import stateful


def as_stream(spark, df, path, order, parts=3):
    """The rows of df as a stream of several files, read in order one a micro-batch."""
    edges = df.select(F.percentile(order, F.array(*[F.lit(i / parts) for i in range(1, parts)])).alias("p")).first().p
    bounds = [-1e18, *edges, 1e18]
    for a, b in zip(bounds, bounds[1:]):
        df.filter((F.col(order) > a) & (F.col(order) <= b)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream, name, tmp_path):
    out = str(tmp_path / name)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(out)


def test_keyframes(spark, tmp_path):
    p = KeyframeParams(min_score=45, min_change=0.5, max_keyframes=7, signature_bits=64)
    df = spark.createDataFrame(base.keyframe_rows(9), "lesson_id long, frame_index long, score double, signature array<long>")
    out = drain(stateful.stream_keyframes(as_stream(spark, df, str(tmp_path / "in"), "frame_index"), p), "keyframes_out", tmp_path)
    got = {tuple(r) for r in stateful.settled_keyframes(out).select("lesson_id", "frame_index").collect()}
    assert got == {(r.lesson_id, r.frame_index) for r in frames.select_keyframes(df, p).collect()}


def test_silence(spark, tmp_path):
    rows = [(c, i, 1, e * e) for c, es in base.energy_rows(5).items() for i, e in enumerate(es)]
    df = spark.createDataFrame(rows, "clip_id long, window_no long, n long, sum_sq double")
    out = drain(stateful.stream_silence_segments(as_stream(spark, df, str(tmp_path / "in"), "window_no"), base.SPEECH, rate=1), "segments_out", tmp_path)
    got = {(r.clip_id, r.seg_no, r.first, r.last, r.n) for r in stateful.settled_segments(out).collect()}
    assert got == {(r.clip_id, r.seg_no, r.first, r.last, r.n) for r in audio.silence_segments(df, base.SPEECH, units=F.lit(1.0)).collect()}


def test_line_union(spark, tmp_path):
    rows = [("a", i, 0, f"Line {i % 7}" if i % 2 else f"line {i % 7} ") for i in range(40)]
    df = base.board(spark, rows)
    out = drain(stateful.stream_line_union(as_stream(spark, df, str(tmp_path / "in"), "frame_index")), "lines_out", tmp_path)
    assert {r.key for r in out.collect()} == {f"line {i}" for i in range(7)} and stateful.settled_lines(out).count() == 7
