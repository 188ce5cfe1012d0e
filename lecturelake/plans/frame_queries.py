"""Queries over sampled frames and keyframes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lecturelake.operators import frames as O
from lecturelake.params import KeyframeParams, SamplingParams
from lecturelake.plans.bindings import AREA, FRAMES, SAMPLES, STAMP, Tables, frames, sampled_sql, samples
from lecturelake.plans.registry import query
from lecturelake.sources import media
from lecturelake.storage import shared_folder

KEEP = ("lesson_id", "frame_index", "ts")


@query("frame_timestamp", f"WITH {SAMPLES} SELECT lesson_id, frame_index, round({STAMP}, 6) AS ts FROM samples")
def frame_timestamp(t):
    return O.frame_timestamp(samples(t)).select("lesson_id", "frame_index", F.round("ts", 6).alias("ts"))


@query("sample_frames", f"WITH {SAMPLES}, {sampled_sql(0.25)} SELECT lesson_id, frame_index, ts FROM sampled")
def sample_frames(t):
    return O.sample_frames(samples(t)).select(*KEEP)


@query("harvest_sample", f"WITH {SAMPLES}, {sampled_sql(0.3)} SELECT lesson_id, frame_index, ts FROM sampled QUALIFY row_number() OVER (PARTITION BY lesson_id ORDER BY frame_index) <= 8")
def harvest_sample(t):
    return O.harvest_sample(samples(t), SamplingParams(harvest_every_sec=0.3, max_scans=8)).select(*KEEP)


@query("max_pool_scan", f"WITH {SAMPLES}, {sampled_sql(0.25)} SELECT lesson_id, frame_index, ts FROM sampled WHERE {AREA} / greatest(1, h * w) >= 0.1 QUALIFY row_number() OVER (PARTITION BY lesson_id ORDER BY frame_index) <= 9")
def max_pool_scan(t):
    return O.max_pool_scan(samples(t), SamplingParams(max_pool=9)).select(*KEEP)


def times(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("lesson_id"), (F.col("event_id") / 8).alias("ts"))


TIMES = "times AS (SELECT user_id AS lesson_id, event_id / 8 AS ts FROM events), capped AS (SELECT lesson_id, row_number() OVER (PARTITION BY lesson_id ORDER BY ts) AS ordinal, ts FROM times QUALIFY ordinal <= 80)"


@query("iframe_cap", f"WITH {TIMES} SELECT * FROM capped")
def iframe_cap(t):
    return O.iframe_cap(times(t), 80).withColumn("ordinal", F.col("ordinal").cast("long"))


@query(
    "pair_frames_by_ordinal",
    f"WITH {TIMES}, files AS (SELECT o_custkey % 200 AS lesson_id, 'kf_' || o_orderkey || '.png' AS file, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey) AS ordinal FROM orders) SELECT lesson_id, ordinal, ts, file FROM capped JOIN files USING (lesson_id, ordinal)",
)
def pair_frames(t):
    files = t.orders.select((F.col("o_custkey") % 200).alias("lesson_id"), F.concat(F.lit("kf_"), "o_orderkey", F.lit(".png")).alias("file"))
    return O.pair_frames_by_ordinal(times(t), files, 80).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("source_fallback", "SELECT user_id AS lesson_id, event_id / 8 AS ts FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_id / 8 + 0.5 FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click')")
def source_fallback(t):
    e = t.events
    first = e.filter("event_type = 'click'").select(F.col("user_id").alias("lesson_id"), (F.col("event_id") / 8).alias("ts"))
    return O.source_fallback(first, e.select(F.col("user_id").alias("lesson_id"), (F.col("event_id") / 8 + 0.5).alias("ts")))


@query("change_ratio", f"WITH {FRAMES}, p AS (SELECT *, lag(bits) OVER (PARTITION BY lesson_id ORDER BY frame_index) AS before FROM frames) SELECT lesson_id, frame_index, CASE WHEN before IS NULL THEN 1.0::DOUBLE ELSE round(len(list_filter(list_zip(before, bits), lambda z: z[1] <> z[2])) / 64, 4) END AS change FROM p")
def change_ratio(t):
    return O.change_ratio(frames(t), 64).select("lesson_id", "frame_index", "change")


KEYFRAMES = KeyframeParams(min_score=45, min_change=0.5, max_keyframes=None, signature_bits=64)
WALK = f"""{FRAMES}, e AS (SELECT *, row_number() OVER (PARTITION BY lesson_id ORDER BY frame_index) AS k FROM frames WHERE score >= 45),
 walk AS (SELECT lesson_id, k, frame_index, 1.0::DOUBLE AS change, true AS keep, bits AS last FROM e WHERE k = 1
  UNION ALL SELECT e.lesson_id, e.k, e.frame_index, len(list_filter(list_zip(last, bits), lambda z: z[1] <> z[2])) / 64, len(list_filter(list_zip(last, bits), lambda z: z[1] <> z[2])) / 64 >= 0.5,
   CASE WHEN len(list_filter(list_zip(last, bits), lambda z: z[1] <> z[2])) / 64 >= 0.5 THEN bits ELSE last END FROM walk w JOIN e ON e.lesson_id = w.lesson_id AND e.k = w.k + 1),
 keyframes AS (SELECT lesson_id, frame_index, change FROM walk WHERE keep)"""


@query("select_keyframes", f"WITH RECURSIVE {WALK} SELECT * FROM keyframes")
def select_keyframes(t):
    return O.select_keyframes(frames(t), KEYFRAMES)


@query("keyframe_cap", f"WITH RECURSIVE {WALK} SELECT * FROM keyframes QUALIFY row_number() OVER (PARTITION BY lesson_id ORDER BY frame_index) <= 8")
def keyframe_cap(t):
    return O.keyframe_cap(O.select_keyframes(frames(t), KEYFRAMES), 8)


@query("best_clarity_frame", f"WITH {FRAMES} SELECT lesson_id, frame_index, score FROM frames QUALIFY row_number() OVER (PARTITION BY lesson_id ORDER BY score DESC, frame_index DESC) = 1")
def best_clarity_frame(t):
    return O.best_clarity_frame(frames(t))


@query("highest_clarity", "SELECT l_suppkey AS lesson_id, max(l_extendedprice / 1000) AS highest_clarity FROM lineitem GROUP BY 1")
def highest_clarity(t):
    return O.highest_clarity(t.lineitem.select(F.col("l_suppkey").alias("lesson_id"), F.col("l_orderkey").alias("frame_index"), (F.col("l_extendedprice") / 1000).alias("clarity")))


def packets(t: Tables) -> DataFrame:
    """Packet lines a user's events: a cell without number, the time (in one of three notations), and flags with K for one kind of event."""
    flags = F.when((F.col("event_type") == "click") & (F.col("user_id") % 5 != 0), "K__").otherwise("___")
    first = F.when(F.col("event_id") % 2 == 0, "N/A").otherwise("packet")
    time = F.when(F.col("event_id") % 3 == 0, F.concat("event_id", F.lit("25e-2"))).when(F.col("event_id") % 3 == 1, F.concat("event_id", F.lit(".25000001"))).otherwise(F.concat(F.lit(" +"), "event_id", F.lit(".25")))
    return t.events.select(F.col("user_id").alias("video_id"), F.concat_ws(",", first, time, flags).alias("value"))


def dumped(rows: DataFrame, name: str) -> str:
    """A folder of text files, each with the lines of many videos, so that files grow with the rows and not with the videos."""
    folder = shared_folder(rows.sparkSession, name)
    rows.select(F.concat(F.col("video_id").cast("string"), F.lit("\t"), F.col("value"))).write.text(f"{folder}/{media.PACKED}")
    return folder


def _rounded(times: DataFrame) -> DataFrame:
    return times.select(F.col("video_id").cast("long").alias("video_id"), F.round("ts", 6).alias("ts"))


TIME = "CASE event_id % 3 WHEN 0 THEN (event_id * 100 + 25) / 100 WHEN 1 THEN event_id + 0.25000001::DOUBLE ELSE event_id + 0.25::DOUBLE END"
PACKETS = f"packets AS (SELECT user_id AS video_id, round({TIME}, 6) AS ts FROM events WHERE event_type = 'click' AND user_id % 5 <> 0)"


@query("scan_probe_csv", f"WITH {PACKETS} SELECT * FROM packets")
def scan_probe_csv(t):
    return _rounded(media.scan_probe_csv(t.spark, dumped(packets(t), "packets")))


@query("scan_probe_csv_fallback", f"WITH {PACKETS} SELECT * FROM packets UNION ALL SELECT user_id, event_id + 0.5 FROM events WHERE event_id % 3 = 0 AND user_id NOT IN (SELECT video_id FROM packets)")
def scan_probe_csv_fallback(t):
    kind = F.when(F.col("event_id") % 3 == 0, "I").otherwise("P")
    rows = t.events.select(F.col("user_id").alias("video_id"), F.concat_ws(",", F.lit("frame"), F.concat("event_id", F.lit(".5")), kind).alias("value"))
    return _rounded(media.scan_probe_csv_or_iframes(t.spark, dumped(packets(t), "packets"), dumped(rows, "iframes")))


@query(
    "scan_media_manifest",
    """WITH f AS (SELECT o_orderkey // 2 AS lesson_id, CASE o_orderkey % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'image' ELSE 'audio' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN 'wav' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'mp4' WHEN 1 THEN 'png' ELSE 'mp3' END END AS ending, CAST(floor(o_totalprice) AS BIGINT) % 500 AS length FROM orders),
 s AS (SELECT lesson_id, count(*) FILTER (kind = 'video') AS v, count(*) FILTER (kind = 'image') AS i, count(*) FILTER (kind = 'audio') AS a, count(*) FILTER (length < 32) AS short, count(*) FILTER (kind = 'audio' AND ending <> 'mp3') AS ba, count(*) FILTER (kind = 'video' AND ending NOT IN ('mp4', 'mov', 'avi', 'mkv')) AS bv FROM f GROUP BY 1),
 r AS (SELECT lesson_id, CASE WHEN v > 0 AND i + a > 0 THEN 'video together with image or audio' WHEN v <> 1 AND NOT (i = 1 AND a = 1) THEN 'needs one video, or one image and one audio' WHEN short > 0 THEN 'file too short' WHEN ba > 0 THEN 'audio type' WHEN bv > 0 THEN 'video type' END AS reason FROM s)
SELECT lesson_id, reason IS NULL AS accepted, reason FROM r""",
)
def scan_media_manifest(t):
    key = F.col("o_orderkey")
    kind = F.element_at(F.array(F.lit("video"), F.lit("image"), F.lit("audio")), (key % 3 + 1).cast("int"))
    ending = F.when(key % 4 == 0, "wav").otherwise(F.element_at(F.array(F.lit("mp4"), F.lit("png"), F.lit("mp3")), (key % 3 + 1).cast("int")))
    files = t.orders.select(F.floor(key / 2).alias("lesson_id"), kind.alias("kind"), F.concat(F.lit("up/"), "o_orderkey", F.lit("."), ending).alias("path"), (F.floor("o_totalprice") % 500).alias("length"))
    return media.manifest_rows(files)
