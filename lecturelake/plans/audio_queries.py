"""Queries over energy windows and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lecturelake.operators import audio
from lecturelake.params import SpeechParams
from lecturelake.plans.bindings import WINDOWS, Tables, windows
from lecturelake.plans.registry import query
from lecturelake.sources import media
from lecturelake.storage import shared_folder

P = SpeechParams(threshold=20, window_sec=1.0, silence_sec=3.0, min_segment_sec=5, max_segment_sec=20, drop_silence_sec=8)


def segments(t: Tables) -> DataFrame:
    return audio.silence_segments(windows(t), P, units=F.lit(1.0))


SEGMENTS = f"""{WINDOWS}, wl AS (SELECT *, value >= 20 AS loud FROM windows),
 walk AS (SELECT clip_id, window_no, 1 AS n, CASE WHEN loud THEN 0 ELSE 1 END AS silent, loud AS speech, window_no AS first, sum_sq, false AS flush, false AS dropped FROM wl WHERE window_no = 0
  UNION ALL SELECT clip_id, window_no, n, silent, speech, first, sum_sq, (speech AND silent >= 3 AND n >= 5) OR n >= 20, NOT ((speech AND silent >= 3 AND n >= 5) OR n >= 20) AND NOT speech AND n > 8 FROM (
   SELECT e.clip_id, e.window_no, CASE WHEN flush OR dropped THEN 1 ELSE w.n + 1 END AS n, CASE WHEN e.loud THEN 0 WHEN flush OR dropped THEN 1 ELSE silent + 1 END AS silent, CASE WHEN flush OR dropped THEN e.loud ELSE speech OR e.loud END AS speech,
    CASE WHEN flush OR dropped THEN e.window_no ELSE first END AS first, CASE WHEN flush OR dropped THEN e.sum_sq ELSE w.sum_sq + e.sum_sq END AS sum_sq FROM walk w JOIN wl e ON e.clip_id = w.clip_id AND e.window_no = w.window_no + 1)),
 ends AS (SELECT *, window_no = max(window_no) OVER (PARTITION BY clip_id) AS final FROM walk),
 segments AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY window_no) - 1 AS seg_no, first, window_no AS last, CAST(n AS BIGINT) AS n, sum_sq FROM ends WHERE flush OR (final AND NOT dropped))"""


@query("rms_windows", f"WITH {WINDOWS} SELECT clip_id, window_no // 4 AS window_no, count(*) AS n, round(sqrt(sum(sum_sq) / count(*)), 6) AS rms FROM windows GROUP BY ALL")
def rms_windows(t):
    samples = windows(t).select("clip_id", F.col("window_no").alias("i"), F.col("value").alias("v"))
    w = audio.rms_windows(audio.energy_windows(samples, rate=40, window_sec=0.1))
    return w.select("clip_id", "window_no", "n", F.round("rms", 6).alias("rms"))


@query("sample_normalize", f"WITH {WINDOWS}, c AS (SELECT clip_id, window_no // 2 AS i, CASE WHEN max(abs(value)) OVER (PARTITION BY clip_id) > 1.5 THEN value / max(abs(value)) OVER (PARTITION BY clip_id) ELSE value END AS v FROM windows) SELECT clip_id, i, round(greatest(-1.0, least(1.0, avg(v))), 6) AS v FROM c GROUP BY clip_id, i")
def sample_normalize(t):
    samples = windows(t).select("clip_id", F.floor(F.col("window_no") / 2).alias("i"), (F.col("window_no") % 2).alias("channel"), F.col("value").alias("v"))
    return audio.sample_normalize(samples).select("clip_id", "i", F.round("v", 6).alias("v"))


CLIPS = f"""{WINDOWS}, clips AS (SELECT clip_id, window_no AS i, CAST(floor(value * 50) AS BIGINT) - 12000 AS v FROM windows)"""


@query("scan_pcm_windows", f"WITH {CLIPS} SELECT clip_id, i // 8 AS window_no, count(*) AS n, round(sum((v / 32768) * (v / 32768)), 9) AS sum_sq FROM clips GROUP BY ALL")
def scan_pcm_windows(t):
    samples = windows(t).select("clip_id", F.col("window_no").alias("i"), (F.floor(F.col("value") * 50) - 12000).alias("v"))
    folder = shared_folder(t.spark, "clips")
    media.write_pcm(samples, folder, rate=800).write.parquet(shared_folder(t.spark, "clips-written"))
    found = media.scan_pcm_windows(t.spark, folder, window_sec=0.01, rate=800, part_bytes=2000)  # small parts, so that clips are cut
    return found.select(F.regexp_extract("clip_id", r"(\d+)\.wav$", 1).cast("long").alias("clip_id"), "window_no", "n", F.round("sum_sq", 9).alias("sum_sq"))


@query("silence_segments", f"WITH RECURSIVE {SEGMENTS} SELECT clip_id, seg_no, first, last, n, round(sum_sq, 4) AS sum_sq FROM segments")
def silence_segments(t):
    return segments(t).withColumn("sum_sq", F.round("sum_sq", 4))


@query("segment_rms", f"WITH RECURSIVE {SEGMENTS} SELECT clip_id, seg_no, round(sqrt(sum_sq / n), 6) AS rms FROM segments")
def segment_rms(t):
    return audio.segment_rms(segments(t)).select("clip_id", "seg_no", F.round("rms", 6).alias("rms"))


@query("energy_gate", f"WITH RECURSIVE {SEGMENTS} SELECT clip_id, seg_no, n FROM segments WHERE sqrt(sum_sq / n) >= 25")
def energy_gate(t):
    return audio.energy_gate(segments(t), 25).select("clip_id", "seg_no", "n")


FIXED = "fixed AS (SELECT clip_id, window_no // 7 AS seg_no, min(window_no) AS first, max(window_no) AS last, count(*) AS n FROM windows GROUP BY clip_id, window_no // 7)"


@query("fixed_segments", f"WITH {WINDOWS}, {FIXED} SELECT * FROM fixed")
def fixed_segments(t):
    return audio.fixed_segments(windows(t), 7).drop("sum_sq")


@query("segments_or_fixed", f"WITH RECURSIVE {SEGMENTS}, {FIXED}, s AS (SELECT clip_id, seg_no, first, last, n FROM segments WHERE clip_id % 3 <> 0) SELECT * FROM s UNION ALL SELECT * FROM fixed WHERE clip_id NOT IN (SELECT clip_id FROM s)")
def segments_or_fixed(t):
    return audio.segments_or_fixed(segments(t).filter("clip_id % 3 <> 0"), audio.fixed_segments(windows(t), 7)).drop("sum_sq")


@query("segment_bounds", f"WITH {WINDOWS}, {FIXED} SELECT clip_id, seg_no, round(first / 2, 3) AS start_sec, round(n / 2, 3) AS duration_sec, round(first / 2 + n / 2, 3) AS end_sec FROM fixed")
def segment_bounds(t):
    return audio.segment_bounds(audio.fixed_segments(windows(t), 7), 0.5, 2).select("clip_id", "seg_no", "start_sec", "duration_sec", "end_sec")


def transcripts(t: Tables) -> DataFrame:
    e = t.events
    return e.select(
        F.col("user_id").alias("clip_id"),
        F.col("event_id").alias("seg_no"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_id") / 8).alias("start"),
        F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(F.col("event_id") / 4 - 100).alias("end"),
        F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.col("event_type")).alias("text"),
    )


@query(
    "segment_normalize",
    """WITH r AS (SELECT user_id AS clip_id, event_id AS seg_no, CASE WHEN event_id % 11 <> 0 THEN event_id / 8 ELSE 0 END AS s, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id / 4 - 100 END AS e, event_type AS text FROM events WHERE event_id % 7 <> 0),
 c AS (SELECT *, greatest(s, CASE WHEN e = 0 THEN s ELSE e END) AS f FROM r) SELECT clip_id, seg_no, round(s, 3) AS start_sec, round(f, 3) AS end_sec, round(f - s, 3) AS duration_sec, text FROM c""",
)
def segment_normalize(t):
    return audio.segment_normalize(transcripts(t))


@query(
    "speech_segments",
    f"""WITH RECURSIVE {SEGMENTS}, tx AS (SELECT conv_id AS clip_id, turn AS seg_no, trim(role) AS text FROM conversations)
SELECT clip_id, seg_no, round(first / 1, 3) AS start_sec, round(n / 1, 3) AS duration_sec, round(first / 1 + n, 3) AS end_sec, text FROM segments JOIN tx USING (clip_id, seg_no) WHERE sqrt(sum_sq / n) >= 25""",
)
def speech_segments(t):
    texts = t.conversations.select(F.col("conv_id").alias("clip_id"), F.col("turn").alias("seg_no"), F.col("role").alias("text"))
    return audio.speech_segments(segments(t), texts, 25, 1.0, 1)
