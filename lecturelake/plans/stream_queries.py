"""Queries that run the streaming forms to their end over the tables and give what the batch forms give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lecturelake.plans.audio_queries import P, SEGMENTS
from lecturelake.plans.bindings import FRAMES, UNION, WINDOWS, Tables, frames, lines, windows
from lecturelake.plans.frame_queries import KEYFRAMES, WALK
from lecturelake.plans.registry import query
from lecturelake.storage import shared_folder
from lecturelake.streaming import stateful

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StreamTables(Tables):
    """The tables as streams of their files."""

    def __getattr__(self, name: str) -> DataFrame:
        path = f"{self.path}/{name}.parquet"
        return self.spark.readStream.schema(self.spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")  # a pattern, as a table may be a file or a folder


def run_to_end(stream: DataFrame, folder: str) -> None:
    """Runs a stream over everything that is there now; a second run with the same folder goes on where the first ended."""
    spark = stream.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKS)
    try:
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)


def drained(stream: DataFrame) -> DataFrame:
    """Everything that a stream gives of the rows that are there now, as a written table."""
    folder = shared_folder(stream.sparkSession, "stream")
    run_to_end(stream, folder)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def drained_in_turn(form: Callable[[DataFrame], DataFrame], *tables: DataFrame) -> DataFrame:
    """Everything that a stream gives if the tables arrive one after another; it is stopped and started again between them."""
    spark = tables[0].sparkSession
    source, folder = shared_folder(spark, "stream-in"), shared_folder(spark, "stream")
    for i, rows in enumerate(tables):
        rows.write.parquet(f"{source}/turn-{i}")
        stream = form(spark.readStream.schema(tables[0].schema).option("recursiveFileLookup", True).parquet(source))
        run_to_end(stream, folder)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("stream_line_union", f"WITH {UNION} SELECT lesson_id, frame_index, line_no, line FROM merged")
def stream_line_union(t):
    return stateful.settled_lines(drained(stateful.stream_line_union(lines(StreamTables(t.spark, t.path)))))


@query("stream_keyframes", f"WITH RECURSIVE {WALK} SELECT * FROM keyframes")
def stream_keyframes(t):
    return stateful.settled_keyframes(drained(stateful.stream_keyframes(frames(StreamTables(t.spark, t.path)), KEYFRAMES)))


LATE = """f AS (SELECT *, frame_index % 10 = 3 AS behind FROM frames), m AS (SELECT lesson_id, max(frame_index) AS newest FROM f WHERE NOT behind GROUP BY lesson_id),
 b AS (SELECT lesson_id, frame_index, newest FROM f LEFT JOIN m USING (lesson_id) WHERE behind)"""


@query("stream_late_frames", f"WITH {FRAMES}, {LATE} SELECT lesson_id, count(*) AS late FROM b WHERE frame_index < newest GROUP BY lesson_id")
def stream_late_frames(t):
    rows = frames(t).select("lesson_id", "frame_index", "score", "signature")
    behind = F.col("frame_index") % 10 == 3
    return stateful.late_frames(drained_in_turn(lambda stream: stateful.stream_keyframes(stream, KEYFRAMES), rows.filter(~behind), rows.filter(behind)))


@query("stream_timed_silence", f"WITH RECURSIVE {SEGMENTS} SELECT clip_id, seg_no, first, last, n, round(sum_sq, 4) AS sum_sq FROM segments")
def stream_timed_silence(t):
    start = F.unix_micros(F.timestamp_seconds(F.lit(1_700_000_000)))
    rows = windows(t).select("clip_id", "window_no", "n", "sum_sq", F.timestamp_micros(start + F.col("window_no") * 1_000_000).alias("at"))
    # a window of no clip, a year on, moves the watermark past the ends of all clips
    beat = rows.agg(F.max("at").alias("at")).select(F.lit(-1).cast("long").alias("clip_id"), F.lit(0).cast("long").alias("window_no"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("sum_sq"), (F.col("at") + F.expr("interval 365 days")).alias("at"))
    found = stateful.settled_segments(drained_in_turn(lambda stream: stateful.stream_silence_segments(stream, P, rate=1, event_time="at"), rows, beat))
    return found.filter("clip_id >= 0").withColumn("sum_sq", F.round("sum_sq", 4))


@query("stream_silence_segments", f"WITH RECURSIVE {SEGMENTS} SELECT clip_id, seg_no, first, last, n, round(sum_sq, 4) AS sum_sq FROM segments")
def stream_silence_segments(t):
    folder = shared_folder(t.spark, "stream")
    rows = windows(t).select("clip_id", "window_no", "n", "sum_sq")
    rows.write.parquet(folder)  # windows are numbered over all events, which a stream can't do
    stream = t.spark.readStream.schema(rows.schema).parquet(folder)
    return stateful.settled_segments(drained(stateful.stream_silence_segments(stream, P, rate=1))).withColumn("sum_sq", F.round("sum_sq", 4))
