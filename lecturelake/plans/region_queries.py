"""Queries over board regions and recognised text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lecturelake.functions.text import useful_char_count
from lecturelake.operators import assemble, models, regions
from lecturelake.plans.bindings import AREA, BOXES, Tables, boxes
from lecturelake.plans.registry import query
from lecturelake.sources import sinks
from lecturelake.storage import shared_folder

COLS = ("frame_key", "ord", "x1", "y1", "x2", "y2")


@query("roi_clip", f"WITH {BOXES} SELECT frame_key, ord, least(greatest(0, x1 - 20), w) AS x1, least(greatest(0, y1 - 10), h) AS y1, least(greatest(0, x2 + 30), w) AS x2, least(greatest(0, y2 + 20), h) AS y2 FROM boxes")
def roi_clip(t):
    wide = boxes(t).withColumns({"x1": F.col("x1") - 20, "y1": F.col("y1") - 10, "x2": F.col("x2") + 30, "y2": F.col("y2") + 20})
    return regions.roi_clip(wide).select(*COLS)


@query("roi_valid", f"WITH {BOXES} SELECT frame_key, ord, x1, y1, x2, y2 FROM boxes WHERE x2 > x1 AND y2 > y1")
def roi_valid(t):
    return regions.roi_valid(boxes(t)).select(*COLS)


@query("roi_area_ratio", f"WITH {BOXES} SELECT frame_key, ord, round({AREA} / greatest(1, h * w), 6) AS ratio FROM boxes")
def roi_area_ratio(t):
    return regions.roi_area_ratio(boxes(t)).select("frame_key", "ord", F.round("ratio", 6).alias("ratio"))


@query("roi_area_filter", f"WITH {BOXES} SELECT frame_key, ord, x1, y1, x2, y2 FROM boxes WHERE {AREA} / greatest(1, h * w) >= 0.1")
def roi_area_filter(t):
    return regions.roi_area_filter(boxes(t), 0.1).select(*COLS)


SMALL = f"{AREA} / greatest(1, h * w) < 0.1"


@query("roi_full_frame_fallback", f"WITH {BOXES} SELECT frame_key, ord, CASE WHEN {SMALL} THEN 0 ELSE x1 END AS x1, CASE WHEN {SMALL} THEN 0 ELSE y1 END AS y1, CASE WHEN {SMALL} THEN w ELSE x2 END AS x2, CASE WHEN {SMALL} THEN h ELSE y2 END AS y2, CASE WHEN {SMALL} THEN 'full_frame_video_fallback' ELSE 'yolo' END AS roi_method FROM boxes")
def roi_full_frame_fallback(t):
    return regions.roi_full_frame_fallback(boxes(t).withColumn("roi_method", F.lit("yolo")), 0.1).select(*COLS, "roi_method")


@query("largest_roi", f"WITH {BOXES} SELECT frame_key, ord, x1, y1, x2, y2 FROM boxes WHERE {AREA} > 0 QUALIFY row_number() OVER (PARTITION BY frame_key ORDER BY {AREA} DESC, ord) = 1")
def largest_roi(t):
    return regions.largest_roi(boxes(t))


@query("largest_roi_last_tie", f"WITH {BOXES} SELECT frame_key, ord, x1, y1, x2, y2 FROM boxes WHERE {AREA} > 0 AND class_id IN (1, 2, 3) QUALIFY row_number() OVER (PARTITION BY frame_key ORDER BY {AREA} DESC, ord DESC) = 1")
def largest_roi_last_tie(t):
    return regions.largest_roi(boxes(t), last_tie=True, classes=[1, 2, 3])


@query(
    "roi_cascade",
    f"""WITH {BOXES}, c AS (SELECT *, CASE class_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS rank FROM boxes WHERE {AREA} > 0),
 best AS (SELECT * FROM c WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY frame_key ORDER BY rank, {AREA} DESC, ord) = 1), f AS (SELECT DISTINCT frame_key, w, h FROM boxes)
SELECT f.frame_key, CASE rank WHEN 1 THEN 'yolo_world' WHEN 2 THEN 'yolo' WHEN 3 THEN 'heuristic' ELSE 'full_frame' END AS roi_method, coalesce(x1, 0) AS x1, coalesce(y1, 0) AS y1, coalesce(x2, f.w) AS x2, coalesce(y2, f.h) AS y2 FROM f LEFT JOIN best USING (frame_key)""",
)
def roi_cascade(t):
    kind = F.element_at(F.array(*map(F.lit, ("yolo_world", "yolo", "heuristic", "unknown"))), (F.col("class_id") % 4 + 1).cast("int"))
    b = boxes(t).withColumn("source", kind)
    return regions.roi_cascade(b.select("frame_key", "w", "h").distinct(), b)


@query("contour_roi_topk", f"WITH {BOXES}, c AS (SELECT *, {AREA} AS area FROM boxes) SELECT frame_key, ord, x1, y1, x2, y2 FROM c WHERE area >= 0.05 * w * h AND x2 - x1 >= 0.2 * w AND y2 - y1 >= 0.15 * h QUALIFY row_number() OVER (PARTITION BY frame_key ORDER BY area DESC, ord) = 1")
def contour_roi_topk(t):
    return regions.contour_roi_topk(boxes(t).withColumn("area", regions.area()))


def detections(t: Tables) -> DataFrame:
    """A slanted polygon a box; its text is the part's name, blank for some, and some have no confidence."""
    b = boxes(t).join(t.part.select(F.col("p_partkey").alias("part"), "p_name"), "part", "left")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    polygon = F.array(point(F.col("x1") + 1, F.col("y1")), point(F.col("x2"), F.col("y1") + 1), point(F.col("x2") - 1, F.col("y2")), point(F.col("x1"), F.col("y2")))
    return b.select("frame_key", "ord", polygon.alias("polygon"), F.when(F.col("ord") % 6 == 0, "  ").otherwise(F.col("p_name")).alias("text"), F.when(F.col("class_id") != 5, F.round("conf", 4)).alias("conf"))


ENTRIES = f"""{BOXES}, entries AS (SELECT frame_key, ord, CAST(least(y1, y1 + 1, y2) AS DOUBLE) AS ymin, CAST(greatest(y1, y1 + 1, y2) AS DOUBLE) AS ymax, CAST(least(x1 + 1, x2, x2 - 1, x1) AS DOUBLE) AS xmin,
 CASE WHEN ord % 6 = 0 THEN '  ' ELSE p_name END AS text FROM boxes LEFT JOIN part ON p_partkey = part WHERE CASE WHEN class_id <> 5 THEN round(conf, 4) ELSE 1 END >= 0.15)"""


@query("ocr_entries", f"WITH {ENTRIES} SELECT * FROM entries")
def ocr_entries(t):
    return regions.ocr_entries(detections(t))


@query("median_height", f"WITH {ENTRIES} SELECT frame_key, median(greatest(1.0, ymax - ymin)) AS median_height FROM entries GROUP BY frame_key")
def median_height(t):
    return regions.median_height(regions.ocr_entries(detections(t)))


@query(
    "reading_order_lines",
    f"""WITH RECURSIVE {ENTRIES}, e AS (SELECT frame_key, (ymin + ymax) / 2 AS cy, xmin, ord, trim(text) AS text, row_number() OVER (PARTITION BY frame_key ORDER BY (ymin + ymax) / 2, xmin, ord) AS k,
  greatest(5.0, 0.55 * median(greatest(1.0, ymax - ymin)) OVER (PARTITION BY frame_key)) AS near FROM entries WHERE trim(text) <> ''),
 walk AS (SELECT frame_key, k, 0 AS line_no, cy AS total, 1 AS n FROM e WHERE k = 1
  UNION ALL SELECT e.frame_key, e.k, CASE WHEN abs(e.cy - total / n) <= near THEN line_no ELSE line_no + 1 END, CASE WHEN abs(e.cy - total / n) <= near THEN total + e.cy ELSE e.cy END, CASE WHEN abs(e.cy - total / n) <= near THEN n + 1 ELSE 1 END
  FROM walk w JOIN e ON e.frame_key = w.frame_key AND e.k = w.k + 1)
SELECT frame_key, CAST(line_no AS BIGINT) AS line_no, string_agg(text, ' ' ORDER BY xmin, cy, ord) AS line FROM walk JOIN e USING (frame_key, k) GROUP BY ALL""",
)
def reading_order_lines(t):
    return regions.reading_order_lines(regions.ocr_entries(detections(t)))


def weak_frames(t: Tables, name: str) -> DataFrame:
    """Parts as frames: a full name, a short one, digits or nothing, by key."""
    k = F.col("p_partkey")
    if name == "first":
        text = F.when(k % 4 == 0, "").when(k % 4 == 1, F.col("p_size").cast("string")).otherwise(F.col("p_name"))
        return t.part.select(k.alias("frame_key"), text.alias("text"))
    return t.part.filter(k % 3 == 0).select(k.alias("frame_key"), F.when(k % 2 == 0, "12").otherwise(F.col("p_name")).alias("text"))


def low_sql(x: str) -> str:
    l, d, a = (f"len(regexp_extract_all(trim({x}), '{p}'))" for p in (r"\p{L}", r"\p{Nd}", r"[\p{L}\p{N}]"))
    return f"(CASE WHEN trim({x}) = '' THEN true WHEN {l} >= 8 THEN false WHEN {a} = 0 THEN true ELSE {d} >= {l} AND {a} <= 12 END)"


@query(
    "ocr_source_label",
    f"""WITH f AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(p_size AS VARCHAR) ELSE p_name END AS a, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN '12' ELSE p_name END END AS b FROM part)
SELECT k AS frame_key, CASE WHEN {low_sql('a')} AND b IS NOT NULL AND NOT {low_sql('b')} THEN 'handwriting_full_frame' WHEN NOT {low_sql('a')} THEN 'roi_easyocr' WHEN trim(a) <> '' THEN 'roi_easyocr_weak' ELSE 'none' END AS ocr_source FROM f""",
)
def ocr_source_label(t):
    return regions.ocr_source_label(weak_frames(t, "first"), weak_frames(t, "second"))


@query(
    "engine_select",
    f"""WITH {BOXES}, r AS (SELECT frame_key, ord, 'engine' || ord AS engine, x1 * 20.0 AS p, quantity % 20 AS u FROM boxes), s AS (SELECT *, min(CASE WHEN p < 400 OR u > 12 THEN ord END) OVER (PARTITION BY frame_key) AS until FROM r)
SELECT frame_key, engine FROM s WHERE (until IS NULL OR ord <= until) AND (p < 600 OR u > 0) QUALIFY row_number() OVER (PARTITION BY frame_key ORDER BY ord DESC) = 1""",
)
def engine_select(t):
    runs = boxes(t).select("frame_key", F.col("ord").alias("engine_ord"), F.concat(F.lit("engine"), "ord").alias("engine"), (F.col("x1") * 20.0).alias("perplexity"), (F.col("quantity") % 20).alias("useful"))
    return regions.engine_select(runs, stop_below=400, useful_over=12, accept_below=600)


ENGINES = 4


@query(
    "engine_cascade",
    f"""WITH {BOXES}, r AS (SELECT frame_key, ord, x1 * 20.0 AS p, quantity % 20 AS u FROM boxes WHERE ord <= {ENGINES}), s AS (SELECT *, min(CASE WHEN p < 400 OR u > 12 THEN ord END) OVER (PARTITION BY frame_key) AS until FROM r),
 c AS (SELECT frame_key, CAST(coalesce(any_value(until), {ENGINES}) AS BIGINT) AS calls, max(CASE WHEN (until IS NULL OR ord <= until) AND (p < 600 OR u > 0) THEN ord END) AS last FROM s GROUP BY frame_key) SELECT frame_key, calls, 'engine' || last AS engine FROM c""",
)
def engine_cascade(t):
    at = lambda name: F.transform(F.sequence(F.lit(1), F.lit(ENGINES)), lambda k: F.coalesce(F.get(F.transform(F.filter("b", lambda b: b["ord"] == k), lambda b: b[name]), F.lit(0)), F.lit(-1.0)))
    boxed = boxes(t).filter(F.col("ord") <= ENGINES).groupBy("frame_key").agg(F.collect_list(F.struct("ord", F.col("x1").cast("double").alias("x"), F.col("quantity").cast("double").alias("q"))).alias("b"))
    frames = boxed.select("frame_key", at("x").alias("x"), at("q").alias("q"))

    def engine(k: int):
        def load():
            import numpy as np

            def predict(x, q):  # a frame without a box for this engine has no text
                return np.stack([np.where(x[:, k] < 0, np.inf, x[:, k] * 20), np.where(x[:, k] < 0, 0, q[:, k] % 20)], axis=1)

            return predict

        score = models.score_with_model(load, ArrayType(DoubleType()), 512, [[ENGINES], [ENGINES]])
        return lambda rows: F.transform(F.array(score("x", "q")), lambda r: F.struct(r[0].alias("perplexity"), r[1].cast("long").alias("useful")))[0]

    chosen, runs = models.engine_cascade(frames, [(f"engine{k + 1}", engine(k)) for k in range(ENGINES)], stop_below=400, useful_over=12, accept_below=600)
    return runs.groupBy("frame_key").agg(F.count("*").alias("calls")).join(chosen, "frame_key", "left")


METHOD = "CASE l_linenumber % 4 WHEN 0 THEN 'full_frame' WHEN 1 THEN 'yolo' WHEN 2 THEN 'heuristic' END"


@query(
    "ocr_diagnostics",
    f"""WITH k AS (SELECT l_suppkey AS s, coalesce({METHOD}, 'unknown') AS m, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS p, CAST(l_quantity AS BIGINT) % 3 AS n FROM lineitem),
 a AS (SELECT s, count(*) AS k, sum(p) AS p, sum(n) AS n, count(*) FILTER (m IN ('full_frame', 'heuristic')) AS w, count(*) FILTER (m = 'yolo') AS y FROM k GROUP BY s)
SELECT s_suppkey AS lesson_id, CASE WHEN k IS NULL THEN 'no_keyframes' WHEN w >= k * 0.45 THEN 'localization' WHEN p >= k * 0.35 THEN 'mixed_fullframe_ocr' WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 AND s_suppkey * 3 > greatest(80, 2 * s_suppkey) THEN 'harvest_full_frame_noise'
 WHEN n / k < 0.75 THEN 'recognition_or_sparse_board' ELSE 'healthy_or_merge_noise' END AS issue, coalesce(k, 0) AS keyframes, CAST(coalesce(p, 0) AS BIGINT) AS printed, y AS yolo, round(n / k, 4) AS lines_per_keyframe, s_suppkey % 2 = 0 AS harvest_ran, s_suppkey % 3 <> 0 AS harvest_full_frame, s_suppkey * 3 AS lines_before, s_suppkey AS lines_after FROM supplier LEFT JOIN a ON s = s_suppkey""",
)
def ocr_diagnostics(t):
    k = t.lineitem.select(F.col("l_suppkey").alias("lesson_id"), F.expr(METHOD).alias("roi_method"), F.when(F.col("l_returnflag") == "R", "printed_full_frame").otherwise("roi").alias("ocr_source"), (F.col("l_quantity").cast("long") % 3).alias("n_lines"))
    s = F.col("s_suppkey")
    lessons = t.supplier.select(s.alias("lesson_id"), (s % 2 == 0).alias("harvest_ran"), (s % 3 != 0).alias("harvest_full_frame"), (s * 3).alias("lines_before"), s.alias("lines_after"))
    found = assemble.ocr_diagnostics(lessons, k)
    return found.select("lesson_id", "issue", "keyframes", "printed", F.col("roi_method_counts")["yolo"].alias("yolo"), "lines_per_keyframe", "harvest_ran", "harvest_full_frame", "lines_before", "lines_after")


@query(
    "error_collect",
    """WITH e AS (SELECT o_custkey AS c, o_orderpriority AS step, o_orderkey AS n, o_orderstatus || o_orderkey AS m FROM orders WHERE o_orderstatus <> 'P'), f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY c, step ORDER BY n) = 1)
SELECT c AS lesson_id, count(*) AS steps, string_agg(step || '=' || m, ';' ORDER BY step) AS errors FROM f GROUP BY c""",
)
def error_collect(t):
    e = t.orders.select(F.col("o_custkey").alias("lesson_id"), F.col("o_orderpriority").alias("step"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") != "P", F.concat("o_orderstatus", "o_orderkey")).alias("message"))
    joined = F.array_join(F.transform(F.array_sort(F.map_entries("errors")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return assemble.error_collect(e).select("lesson_id", F.size("errors").cast("long").alias("steps"), joined.alias("errors"))


def assembled(t: Tables) -> DataFrame:
    base = t.customer.select(F.col("c_custkey").alias("lesson_id"), F.col("c_name").alias("name"))
    n = t.orders.groupBy(F.col("o_custkey").alias("lesson_id")).agg(F.count("*").alias("orders"))
    first = t.orders.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("lesson_id")).agg(F.min("o_orderkey").alias("first_open"))
    return assemble.lesson_assemble(base, n, first)


ASSEMBLED = "assembled AS (SELECT c_custkey AS lesson_id, c_name AS name, orders, first_open FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first_open FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b ON b.o_custkey = c_custkey)"


@query("lesson_assemble", f"WITH {ASSEMBLED} SELECT * FROM assembled")
def lesson_assemble(t):
    return assembled(t)


@query("sink_lesson_json", f"""WITH {ASSEMBLED} SELECT lesson_id, '{{"lesson_id":' || lesson_id || ',"name":"' || name || '"' || coalesce(',"orders":' || orders, '') || coalesce(',"first_open":' || first_open, '') || '}}' AS document FROM assembled""")
def sink_lesson_json(t):
    """Lessons in two batches, of which the second is cut off once and then repeated twice; what was written is read again."""
    path, lessons = shared_folder(t.spark, "lessons"), assembled(t)
    even, odd = lessons.filter("lesson_id % 2 = 0"), lessons.filter("lesson_id % 2 <> 0")
    assemble.sink_lesson_json(even, path, 0)
    sinks.write_attempt(assemble.lesson_json(odd.filter("lesson_id % 3 = 0")), path, 1)
    for _ in range(2):
        assemble.sink_lesson_json(odd, path, 1)
    return sinks.latest(sinks.read_batches(t.spark, path)).select(F.col("lesson_id").cast("long").alias("lesson_id"), "document")


@query("sink_keyframe_metadata", "SELECT CAST(label AS BIGINT) AS lesson_id, count(*) AS keyframes, string_agg(vec_id || ':' || (vec_id * 37) % 101, ',' ORDER BY vec_id) AS listed FROM embeddings GROUP BY 1")
def sink_keyframe_metadata(t):
    k = t.embeddings.select(F.col("label").cast("long").alias("lesson_id"), F.col("vec_id").alias("frame_index"), ((F.col("vec_id") * 37) % 101).alias("score"))
    path = shared_folder(t.spark, "keyframes")
    assemble.sink_keyframe_metadata(k, path)
    kind = "struct<lesson_id:bigint,keyframes:array<struct<frame_index:bigint,score:bigint>>>"
    m = sinks.read_batches(t.spark, path).select(F.from_json("document", kind).alias("m")).select("m.*")
    listed = F.array_join(F.transform("keyframes", lambda x: F.concat_ws(":", x["frame_index"].cast("string"), x["score"].cast("string"))), ",")
    return m.select("lesson_id", F.size("keyframes").cast("long").alias("keyframes"), listed.alias("listed"))
