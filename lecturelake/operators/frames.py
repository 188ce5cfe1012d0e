"""Operators on sampled frames: frames(lesson_id, frame_index, fps, msec, score, signature, ...)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lecturelake.functions.numeric import change_ratio as _change_ratio
from lecturelake.operators.regions import area_ratio
from lecturelake.params import KeyframeParams, SamplingParams


def _fps(p: SamplingParams) -> Column:
    return F.when(F.col("fps") > 0, F.col("fps")).otherwise(p.default_fps)


def frame_timestamp(frames: DataFrame) -> DataFrame:
    """Adds ts: the position in the stream if known, else index over rate, else 0."""
    ts = F.when(F.col("msec") > 0, F.col("msec") / 1000).when(F.col("fps") > 0, F.col("frame_index") / F.col("fps")).otherwise(0.0)
    return frames.withColumn("ts", ts)


def sample_frames(frames: DataFrame, p: SamplingParams | None = None, every: float | None = None, least: float | None = None) -> DataFrame:
    """Every n-th frame of each lesson, with ts to the millisecond."""
    p = p or SamplingParams()
    gap = max(least or p.least_sec, every or p.every_sec)
    step = F.greatest(F.lit(1), F.bround(F.lit(gap) * _fps(p)).cast("long"))
    return frame_timestamp(frames.filter(F.col("frame_index") % step == 0)).withColumn("ts", F.round("ts", 3))


def _first(rows: DataFrame, n: int, order: str = "frame_index") -> DataFrame:
    number = F.row_number().over(Window.partitionBy("lesson_id").orderBy(order))  # a limit a group: Spark prunes each task to n rows a lesson
    return rows.withColumn("_n", number).filter(F.col("_n") <= n).drop("_n")


def harvest_sample(frames: DataFrame, p: SamplingParams | None = None) -> DataFrame:
    """A second, coarser pass with a limit of scans; a limit of 0 disables it."""
    p = p or SamplingParams()
    if p.max_scans <= 0 or p.harvest_every_sec <= 0:
        return sample_frames(frames.limit(0), p)
    return _first(sample_frames(frames, p, p.harvest_every_sec, p.harvest_least_sec), p.max_scans)


def max_pool_scan(frames: DataFrame, p: SamplingParams | None = None) -> DataFrame:
    """Sampled frames with a large enough region, the first of each lesson up to the pool's size."""
    p = p or SamplingParams()
    return _first(sample_frames(frames, p).filter(area_ratio() >= p.min_roi_area_ratio), p.max_pool)


def iframe_cap(times: DataFrame, n: int) -> DataFrame:
    """lesson_id, ordinal, ts of the first n times of each lesson."""
    number = F.row_number().over(Window.partitionBy("lesson_id").orderBy("ts"))
    return times.withColumn("ordinal", number).filter(F.col("ordinal") <= n).select("lesson_id", "ordinal", "ts")


def pair_frames_by_ordinal(times: DataFrame, files: DataFrame, n: int) -> DataFrame:
    """The k-th time with the k-th frame file by the number in its name, as far as both go."""
    number = F.regexp_extract("file", r"kf_(\d+)", 1).cast("long")
    ranked = files.withColumn("ordinal", F.row_number().over(Window.partitionBy("lesson_id").orderBy(number, "file")))
    return iframe_cap(times, n).join(ranked, ["lesson_id", "ordinal"]).select("lesson_id", "ordinal", "ts", "file")


def source_fallback(primary: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of the primary source, and of the other for lessons that the primary lacks."""
    return primary.unionByName(other.join(primary.select("lesson_id").distinct(), "lesson_id", "left_anti"))


def change_ratio(frames: DataFrame, bits: int) -> DataFrame:
    """Adds change: the part of the signature that differs from the frame before, to four digits."""
    before = F.lag("signature").over(Window.partitionBy("lesson_id").orderBy("frame_index"))
    return frames.withColumn("change", F.round(_change_ratio(before, F.col("signature"), bits), 4))


def best_clarity_frame(frames: DataFrame, *extra: str) -> DataFrame:
    """The frame with the best score of each lesson, the last of equals."""
    best = frames.groupBy("lesson_id").agg(F.max_by(F.struct("frame_index", "score", *extra), F.struct("score", "frame_index")).alias("b"))
    return best.select("lesson_id", "b.*")


def highest_clarity(boards: DataFrame) -> DataFrame:
    """Best board of each frame (lesson_id, frame_index, clarity), then best frame of each lesson."""
    frames = boards.groupBy("lesson_id", "frame_index").agg(F.max("clarity").alias("clarity"))
    return frames.groupBy("lesson_id").agg(F.max("clarity").alias("highest_clarity"))


def keep_step(state: dict, frame_index: int, score: float, signature, p: KeyframeParams) -> float | None:
    """One step of the keyframe rule, shared by the batch and the streaming form: the change if the frame is kept.

    state: last (kept signature), kept (number), best (score, frame_index) for the fallback.
    """
    if p.max_keyframes is not None and state["kept"] >= p.max_keyframes:
        return None
    if state["best"] is None or score > state["best"][0]:
        state["best"] = (score, frame_index)
    last = state["last"]
    change = 1.0 if last is None else sum((int(a) ^ int(b)).bit_count() if (int(a) ^ int(b)) >= 0 else ((int(a) ^ int(b)) & (2**64 - 1)).bit_count() for a, b in zip(last, signature, strict=True)) / p.signature_bits
    if score < p.min_score or (last is not None and change < p.min_change):
        return None
    state["last"], state["kept"] = list(signature), state["kept"] + 1
    return change


def new_keyframe_state() -> dict:
    return {"last": None, "kept": 0, "best": None}


def select_keyframes(frames: DataFrame, p: KeyframeParams | None = None) -> DataFrame:
    """lesson_id, frame_index, change of frames that differ enough from the last kept one; else the best frame.

    The rule looks at the last kept frame, so it is a fold per lesson over (frame_index, score, signature);
    pixels stay out. Lessons too long for one task go through the streaming form, whose state is constant.
    """
    p = p or KeyframeParams()

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = new_keyframe_state(), []
        for r in pdf.sort_values("frame_index").itertuples(index=False):
            change = keep_step(state, r.frame_index, r.score, r.signature, p)
            if change is not None:
                out.append((key[0], r.frame_index, change))
        if not out and state["best"] is not None:
            out.append((key[0], state["best"][1], 1.0))
        return pd.DataFrame(out, columns=["lesson_id", "frame_index", "change"])

    lesson = frames.schema["lesson_id"].dataType.simpleString()
    return frames.select("lesson_id", "frame_index", "score", "signature").groupBy("lesson_id").applyInPandas(fold, f"lesson_id {lesson}, frame_index long, change double")


def keyframe_cap(keyframes: DataFrame, n: int) -> DataFrame:
    return _first(keyframes, n)
