"""Operators on energy windows: windows(clip_id, window_no, n, sum_sq), n samples and their sum of squares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lecturelake.functions.numeric import segment_times
from lecturelake.functions.text import trimmed
from lecturelake.params import SpeechParams


def sample_normalize(samples: DataFrame, dtype_max: float | None = None) -> DataFrame:
    """Mono samples in -1..1 (clip_id, i, channel, v): integers over their type's limit, loud floats over their peak."""
    if dtype_max is not None:
        level = samples.withColumn("v", F.col("v") / dtype_max)
    else:
        peak = samples.groupBy("clip_id").agg(F.max(F.abs("v")).alias("peak"))
        level = samples.join(peak, "clip_id").withColumn("v", F.when(F.col("peak") > 1.5, F.col("v") / F.col("peak")).otherwise(F.col("v"))).drop("peak")
    mono = level.groupBy("clip_id", "i").agg(F.avg("v").alias("v"))
    return mono.withColumn("v", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("v"))))


def energy_windows(samples: DataFrame, rate: int, window_sec: float = 0.1) -> DataFrame:
    """Sums of samples (clip_id, i, v) by analysis window; sums combine before the shuffle."""
    size = max(1, int(rate * max(0.01, window_sec)))
    return samples.groupBy("clip_id", F.floor(F.col("i") / size).alias("window_no")).agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("v")).alias("sum_sq"))


def rms_windows(windows: DataFrame) -> DataFrame:
    return windows.withColumn("rms", F.when(F.col("n") > 0, F.sqrt(F.col("sum_sq") / F.col("n"))).otherwise(0.0))


def _fold(p: SpeechParams, silent_needed: int, least: float, most: float, drop_over: float) -> Column:
    """Folds a clip's windows w(no, n, loud, sum_sq) into segments (first, last, windows are counted in duration units)."""
    segment = "struct<first:bigint,last:bigint,n:bigint,sum_sq:double>"
    kind = f"struct<first:bigint,last:bigint,n:bigint,sum_sq:double,units:double,silent:bigint,speech:boolean,done:array<{segment}>>"
    empty = F.from_json(F.lit('{"n":0,"sum_sq":0,"units":0,"silent":0,"speech":false,"done":[]}'), kind)

    def step(s: Column, w: Column) -> Column:
        first = F.when(s["n"] == 0, w["no"]).otherwise(s["first"])
        n, sum_sq, units = s["n"] + w["n"], s["sum_sq"] + w["sum_sq"], s["units"] + w["units"]
        silent = F.when(w["loud"], F.lit(0).cast("long")).otherwise(s["silent"] + 1)
        speech = s["speech"] | w["loud"]
        flush = (speech & (silent >= silent_needed) & (units >= least)) | (units >= most)
        drop = ~flush & ~speech & (units > drop_over)
        closed = F.struct(first.alias("first"), w["no"].alias("last"), n.alias("n"), sum_sq.alias("sum_sq")).cast(segment)
        reset = flush | drop
        return F.struct(
            first.alias("first"),
            w["no"].alias("last"),
            F.when(reset, F.lit(0).cast("long")).otherwise(n).alias("n"),
            F.when(reset, F.lit(0.0)).otherwise(sum_sq).alias("sum_sq"),
            F.when(reset, F.lit(0.0)).otherwise(units).alias("units"),
            F.when(reset, F.lit(0).cast("long")).otherwise(silent).alias("silent"),
            F.when(reset, F.lit(False)).otherwise(speech).alias("speech"),
            F.when(flush, F.concat(s["done"], F.array(closed))).otherwise(s["done"]).alias("done"),
        ).cast(kind)

    def finish(s: Column) -> Column:
        rest = F.struct(s["first"].alias("first"), s["last"].alias("last"), s["n"].alias("n"), s["sum_sq"].alias("sum_sq")).cast(segment)
        return F.when(s["n"] > 0, F.concat(s["done"], F.array(rest))).otherwise(s["done"])

    return F.aggregate("w", empty, step, finish)


def silence_segments(windows: DataFrame, p: SpeechParams | None = None, units: Column | None = None, rate: int = 16_000) -> DataFrame:
    """clip_id, seg_no, first, last (window numbers), n, sum_sq: stretches of speech, cut at pauses and at a longest length.

    ``units`` is a window's length in the unit of the limits (seconds by default, from its samples).
    """
    p = p or SpeechParams()
    window = max(0.01, p.window_sec)
    least = max(0.0, p.min_segment_sec)
    most = max(least if least > 0 else 0.1, p.max_segment_sec)
    length = F.col("n") / rate if units is None else units
    loud = F.when(F.col("n") > 0, F.sqrt(F.col("sum_sq") / F.col("n"))).otherwise(0.0) >= p.threshold
    item = F.struct(F.col("window_no").cast("long").alias("no"), F.col("n").cast("long").alias("n"), F.col("sum_sq").cast("double").alias("sum_sq"), length.cast("double").alias("units"), loud.alias("loud"))
    clips = windows.groupBy("clip_id").agg(F.array_sort(F.collect_list(item)).alias("w"))
    found = clips.select("clip_id", F.posexplode(_fold(p, max(1, int(p.silence_sec / window)), least, most, p.drop_silence_sec)).alias("seg_no", "s"))
    return found.select("clip_id", F.col("seg_no").cast("long").alias("seg_no"), "s.*")


def fixed_segments(windows: DataFrame, per_segment: int) -> DataFrame:
    """Equal pieces of so many windows, numbered from 0."""
    piece = F.floor(F.col("window_no") / per_segment).cast("long")
    return windows.groupBy("clip_id", piece.alias("seg_no")).agg(F.min("window_no").cast("long").alias("first"), F.max("window_no").cast("long").alias("last"), F.sum("n").cast("long").alias("n"), F.sum("sum_sq").alias("sum_sq"))


def segments_or_fixed(segments: DataFrame, fixed: DataFrame) -> DataFrame:
    return segments.unionByName(fixed.join(segments.select("clip_id").distinct(), "clip_id", "left_anti"))


def segment_rms(segments: DataFrame) -> DataFrame:
    return segments.withColumn("rms", F.when(F.col("n") > 0, F.sqrt(F.col("sum_sq") / F.col("n"))).otherwise(0.0))


def energy_gate(segments: DataFrame, least: float) -> DataFrame:
    return segment_rms(segments).filter(F.col("rms") >= least)


def segment_bounds(segments: DataFrame, window_sec: float, rate: int) -> DataFrame:
    """Adds start_sec, duration_sec and end_sec, to the millisecond."""
    start, duration = F.col("first") * window_sec, F.col("n") / rate
    return segments.withColumns({"start_sec": F.round(start, 3), "duration_sec": F.round(duration, 3), "end_sec": F.round(start + duration, 3)})


def segment_normalize(transcripts: DataFrame) -> DataFrame:
    """Segments (clip_id, seg_no, start, end, text) with clean times; blank texts go."""
    rows = transcripts.withColumn("text", trimmed(F.coalesce("text", F.lit("")))).filter("text <> ''")
    return rows.select("clip_id", "seg_no", segment_times(F.col("start"), F.col("end")).alias("t"), "text").select("clip_id", "seg_no", "t.*", "text")


def speech_segments(segments: DataFrame, transcripts: DataFrame, least: float, window_sec: float, rate: int) -> DataFrame:
    """Loud enough segments with their transcript text; blank ones go."""
    loud = segment_bounds(energy_gate(segments, least), window_sec, rate)
    texts = transcripts.select("clip_id", "seg_no", trimmed(F.coalesce("text", F.lit(""))).alias("text")).filter("text <> ''")
    return loud.join(texts, ["clip_id", "seg_no"]).select("clip_id", "seg_no", "start_sec", "end_sec", "duration_sec", "text")


def ordered_windows(events: DataFrame, clip: str, *order: str) -> DataFrame:
    """Numbers the windows of each clip from 0."""
    return events.withColumn("window_no", F.row_number().over(Window.partitionBy(clip).orderBy(*order)) - 1)
