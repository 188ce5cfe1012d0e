"""Queries over pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lecturelake.operators import pixels as O
from lecturelake.params import ClarityParams
from lecturelake.plans.bindings import PIXELS, Tables, pixels
from lecturelake.plans.registry import query
from lecturelake.sources import media
from lecturelake.storage import shared_folder


def images(t: Tables) -> DataFrame:
    """Each embedding as an image row of 8 x 8 gray levels."""
    p = t.embeddings.select(F.col("vec_id").cast("string").alias("origin"), F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 127)).alias("v"))
    data = F.unhex(F.array_join(F.transform("v", lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return p.select(F.struct("origin", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), data.alias("data")).alias("image"))


@query("gray_pixels", f"WITH {PIXELS} SELECT CAST(frame_key AS VARCHAR) AS frame_key, y, x, v FROM pixels")
def gray_pixels(t):
    return O.gray_pixels(images(t))


#: Vectors that are drawn below each other in one picture.
TALL = 200


@query(
    "scan_images",
    f"""WITH {PIXELS} SELECT 'tall-' || frame_key // {TALL} AS picture, (frame_key - min(frame_key) OVER (PARTITION BY frame_key // {TALL})) * 8 + y AS y, x, v FROM pixels
UNION ALL SELECT DISTINCT 'broken-' || vec_id // {TALL}, NULL, NULL, NULL FROM embeddings""",
)
def scan_images(t):
    """Writes pictures, and a broken one for each, and gives the pixels of those that the source reads and the names of the others."""
    picture = F.floor(F.col("vec_id") / TALL).cast("long")
    row = F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 127).cast("short"))
    folder = shared_folder(t.spark, "pictures")
    media.write_gray_images(t.embeddings.select(F.concat(F.lit("tall-"), picture).alias("name"), F.col("vec_id").alias("place"), row.alias("levels")), folder, width=8).write.parquet(shared_folder(t.spark, "pictures-written"))
    broken = t.embeddings.select(F.concat(F.lit("broken-"), picture).alias("name"), F.lit(0).cast("long").alias("place"), F.array().cast("array<short>").alias("levels")).distinct()
    media.write_gray_images(broken, folder, width=8).write.parquet(shared_folder(t.spark, "pictures-written"))
    found = media.scan_images(t.spark, folder)
    name = F.regexp_extract("frame_key", r"([^/]+)\.png$", 1).alias("picture")
    none = F.lit(None).cast("long")
    return O.gray_pixels(found).select(name, "y", "x", "v").unionByName(O.unreadable_images(found).select(name, none.alias("y"), none.alias("x"), none.alias("v")))


STENCIL = f"""{PIXELS}, s AS (SELECT *, lag(v) OVER r AS a, lead(v) OVER r AS b, lag(v) OVER c AS d, lead(v) OVER c AS e FROM pixels WINDOW r AS (PARTITION BY frame_key, y ORDER BY x), c AS (PARTITION BY frame_key, x ORDER BY y)),
 stencil AS (SELECT frame_key, y, x, coalesce(a, b) + coalesce(b, a) + coalesce(d, e) + coalesce(e, d) - 4 * v AS lap FROM s)"""


@query("laplacian_stencil", f"WITH {STENCIL} SELECT * FROM stencil")
def laplacian_stencil(t):
    return O.laplacian_stencil(pixels(t)).select("frame_key", "y", "x", "lap")


@query("laplacian_variance", f"WITH {STENCIL} SELECT frame_key, round(var_pop(lap) + 1e-7, 4) AS laplacian_variance FROM stencil GROUP BY frame_key")
def laplacian_variance(t):
    return O.laplacian_variance(pixels(t)).select("frame_key", F.round(F.col("laplacian_variance") + 1e-7, 4).alias("laplacian_variance"))


@query("image_laplacian_variance", f"WITH {STENCIL} SELECT CAST(frame_key AS VARCHAR) AS frame_key, round(var_pop(lap) + 1e-7, 4) AS laplacian_variance FROM stencil GROUP BY frame_key")
def image_laplacian_variance(t):
    return O.image_laplacian_variance(images(t), block_rows=3).withColumn("laplacian_variance", F.round(F.col("laplacian_variance") + 1e-7, 4))


def ink(t: Tables) -> DataFrame:
    """Line items as ink: a frame is a supplier, a component some of its parts."""
    return t.lineitem.select(F.col("l_suppkey").alias("frame_key"), (F.col("l_partkey") % 23).alias("component"), (F.col("l_quantity") / 25).alias("dist"), F.lit(100).alias("h"), F.lit(100).alias("w"))


STROKES = """parts AS (SELECT l_suppkey AS frame_key, l_partkey % 23 AS component, count(*) AS area, avg(l_quantity / 25) AS mean FROM lineitem GROUP BY ALL),
 strokes AS (SELECT frame_key, coalesce(var_pop(CASE WHEN area >= 20 AND mean > 0.5 THEN mean END), 0) AS v, count(*) FILTER (area >= 20 AND mean > 0.5) AS components FROM parts GROUP BY frame_key)"""


@query("stroke_width_variance", f"WITH {STROKES} SELECT frame_key, round(v, 6) AS stroke_width_variance, components FROM strokes")
def stroke_width_variance(t):
    return O.stroke_width_variance(ink(t)).withColumn("stroke_width_variance", F.round("stroke_width_variance", 6))


def clarity_sql(lap: str, stroke: str, high: float, low: float, uneven: float) -> str:
    sharp = f"CASE WHEN {lap} >= {high} THEN 1.0 WHEN {lap} <= {low} THEN 0.0 ELSE ({lap} - {low}) / ({high} - {low} + 1e-6) END"
    return f"greatest(0.0, least(100.0, 100 * (0.55 * ({sharp}) + 0.45 * greatest(0.0, 1 - least(1.0, {stroke} / {uneven})))))"


LABEL = "CASE WHEN s >= 70 THEN 'clear' WHEN s >= 45 THEN 'fair' ELSE 'poor' END"


@query("clarity_score", f"WITH c AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {clarity_sql('l_extendedprice / 500', 'l_quantity / 5', 120.0, 40.0, 8.0)} AS s FROM lineitem) SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(s, 2) AS score, {LABEL} AS clarity FROM c")
def clarity_score(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_extendedprice") / 500).alias("laplacian_variance"), (F.col("l_quantity") / 5).alias("stroke_width_variance"))
    return O.clarity_score(rows).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "score", "clarity")


@query("clarity_frames", f"WITH {STENCIL}, {STROKES}, l AS (SELECT frame_key, var_pop(lap) AS lap FROM stencil GROUP BY frame_key), c AS (SELECT frame_key, coalesce(components, 0) AS components, {clarity_sql('lap', 'coalesce(v, 0)', 12000.0, 2000.0, 0.05)} AS s FROM l LEFT JOIN strokes USING (frame_key)) SELECT frame_key, components, round(s, 2) AS score, {LABEL} AS clarity FROM c")
def clarity_frames(t):
    p = ClarityParams(sharp_from=12000, blurred_to=2000, uneven_from=0.05)
    sharp = O.image_laplacian_variance(images(t)).withColumn("frame_key", F.col("frame_key").cast("long"))
    return O.clarity_frames(sharp, ink(t), p).select("frame_key", "components", "score", "clarity")


def mask(t: Tables) -> DataFrame:
    return pixels(t).withColumn("v", F.when(F.col("v") > 140, F.col("v")).otherwise(0))


ROWS = "projection AS (SELECT frame_key, y, count(*) FILTER (v > 140) AS ink FROM pixels GROUP BY ALL)"


@query("ink_row_projection", f"WITH {PIXELS}, {ROWS} SELECT * FROM projection")
def ink_row_projection(t):
    return O.ink_row_projection(mask(t))


def inked(t: Tables) -> DataFrame:
    """A mask sparse enough to have bands: only strong pixels count."""
    return pixels(t).withColumn("v", F.when(F.col("v") > 145, F.col("v")).otherwise(0))


def sizes(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("frame_key"), F.lit(8).cast("long").alias("h"), F.lit(100).cast("long").alias("w"))


def bands(t: Tables) -> DataFrame:
    return O.text_bands(inked(t), sizes(t), min_height=2, min_gap=2, pad=0)


BANDS = f"""{PIXELS}, inked AS (SELECT frame_key, y, count(*) FILTER (v > 145) AS ink FROM pixels GROUP BY ALL), on_rows AS (SELECT *, y - row_number() OVER (PARTITION BY frame_key ORDER BY y) AS island FROM inked WHERE ink >= 2),
 runs AS (SELECT frame_key, min(y) AS y1, max(y) + 1 AS y2 FROM on_rows GROUP BY frame_key, island HAVING max(y) + 1 - min(y) >= 2),
 gaps AS (SELECT *, CASE WHEN y1 - max(y2) OVER (PARTITION BY frame_key ORDER BY y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 2 THEN 0 ELSE 1 END AS new FROM runs),
 numbered AS (SELECT *, sum(new) OVER (PARTITION BY frame_key ORDER BY y1 ROWS UNBOUNDED PRECEDING) - 1 AS band_no FROM gaps),
 bands AS (SELECT frame_key, CAST(band_no AS BIGINT) AS band_no, min(y1) AS y1, max(y2) AS y2 FROM numbered GROUP BY frame_key, band_no)"""


@query("text_bands", f"WITH {BANDS} SELECT * FROM bands")
def text_bands(t):
    return bands(t)


@query("band_default", f"WITH {BANDS} SELECT vec_id AS frame_key, coalesce(band_no, 0) AS band_no, coalesce(y1, 0) AS y1, coalesce(y2, 8) AS y2 FROM embeddings LEFT JOIN bands ON frame_key = vec_id")
def band_default(t):
    return O.band_default(sizes(t), bands(t))


@query("ink_pixel_gate", f"WITH {BANDS} SELECT b.* FROM bands b JOIN inked i ON i.frame_key = b.frame_key AND i.y >= b.y1 AND i.y < b.y2 GROUP BY ALL HAVING sum(ink) >= 9")
def ink_pixel_gate(t):
    return O.ink_pixel_gate(inked(t), bands(t), least=9)


@query("frame_signature", f"WITH {PIXELS}, c AS (SELECT frame_key, (y * 4 // 8) * 4 + x * 4 // 8 AS cell, avg(CASE WHEN v > 140 THEN v ELSE 0 END) > 32 AS is_on FROM pixels GROUP BY ALL) SELECT frame_key, CAST(sum(CASE WHEN is_on THEN CAST(pow(2, cell) AS BIGINT) ELSE 0 END) AS BIGINT) AS signature FROM c GROUP BY frame_key")
def frame_signature(t):
    m = mask(t).withColumns({"h": F.lit(8), "w": F.lit(8)})
    return O.frame_signature(m, rows=4, columns=4, over=32).select("frame_key", F.col("signature")[0].alias("signature"))
