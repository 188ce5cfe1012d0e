"""Operators on pixel tables: pixels(frame_key, y, x, v), one row a gray pixel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lecturelake.functions.numeric import clarity_advice, clarity_label, clarity_total
from lecturelake.params import ClarityParams


def gray_pixels(images: DataFrame) -> DataFrame:
    """frame_key, y, x, v from the built-in image source (struct image of BGR, BGRA or gray bytes), one Arrow batch at a time. Rows of unreadable files have no pixels; ``unreadable_images`` names them."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                v = gray(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels))
                y, x = np.indices(v.shape)
                yield pd.DataFrame({"frame_key": r.origin, "y": y.ravel(), "x": x.ravel(), "v": v.ravel()})

    flat = images.filter(_readable()).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInPandas(decode, "frame_key string, y long, x long, v long")


def _readable() -> Column:
    i = F.col("image")
    return F.coalesce((i["height"] > 0) & (i["width"] > 0) & (F.length(i["data"]) == i["height"] * i["width"] * i["nChannels"]), F.lit(False))


def unreadable_images(images: DataFrame) -> DataFrame:
    """frame_key of images that couldn't be decoded."""
    return images.filter(~_readable()).select(F.col("image.origin").alias("frame_key"))


def laplacian_stencil(pixels: DataFrame) -> DataFrame:
    """Adds lap: the four neighbours minus four times the pixel; at an edge the inner neighbour counts twice."""
    row = Window.partitionBy("frame_key", "y").orderBy("x")
    column = Window.partitionBy("frame_key", "x").orderBy("y")
    around = None
    for w in (row, column):
        left, right = F.lag("v").over(w), F.lead("v").over(w)
        for here, other in ((left, right), (right, left)):
            part = F.coalesce(here, other, F.col("v"))
            around = part if around is None else around + part
    return pixels.withColumn("lap", around - 4 * F.col("v"))


def image_laplacian_variance(images: DataFrame, block_rows: int = 256) -> DataFrame:
    """frame_key, laplacian_variance of images (as the image source gives them), without a row a pixel.

    An image is cut into blocks of rows with one more row on either side, so that a block's stencil needs no other; a
    block gives its count, sum and sum of squares as whole numbers, and only these meet. Where an image lies in one
    block, nothing is shuffled before the sums. Rows of unreadable files are left out.
    """
    i = F.col("image")
    last = F.ceil(i["height"] / block_rows).cast("int") - 1
    cut = images.filter(_readable()).select(i["origin"].alias("frame_key"), i["width"].alias("width"), i["nChannels"].alias("channels"), i["height"].alias("height"), i["data"].alias("data"), F.explode(F.sequence(F.lit(0), last)).alias("block"))
    first = F.greatest(F.col("block") * block_rows - 1, F.lit(0))
    end = F.least((F.col("block") + 1) * block_rows + 1, F.col("height"))
    line = F.col("width") * F.col("channels")
    blocks = cut.select("frame_key", "width", "channels", (F.col("block") > 0).alias("above"), (end < (F.col("block") + 1) * block_rows + 1).alias("below_is_edge"), F.substring("data", first * line + 1, (end - first) * line).alias("data"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, width, channels, above, edge, data in zip(*(b.column(n).to_pylist() for n in range(5)), b.column(5), strict=True):
                v = gray(np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, width, channels))
                lap = stencil(v)[int(above) : len(v) if edge else len(v) - 1]
                out.append((key, lap.size, int(lap.sum()), int((lap * lap).sum())))
            yield pa.record_batch([pa.array([r[n] for r in out], t) for n, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["frame_key", "n", "total", "squares"])

    parts = blocks.mapInArrow(sums, "frame_key string, n long, total long, squares long")
    s = parts.groupBy("frame_key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    return s.select("frame_key", (F.col("squares") / F.col("n") - (F.col("total") / F.col("n")) ** 2).alias("laplacian_variance"))


def gray(raw: np.ndarray) -> np.ndarray:
    """Whole gray levels of an image's bytes (rows, columns, channels in the order blue, green, red)."""
    if raw.shape[2] == 1:
        return raw[:, :, 0].astype(np.int64)
    v = raw.astype(float)
    return np.rint(0.114 * v[:, :, 0] + 0.587 * v[:, :, 1] + 0.299 * v[:, :, 2]).astype(np.int64)


def stencil(v: np.ndarray) -> np.ndarray:
    """The four neighbours of each level minus four times itself; at an edge the inner neighbour counts twice."""
    out = -4 * v
    for axis in (0, 1):
        size = v.shape[axis]
        if size == 1:
            out = out + 2 * v
            continue
        before = np.take(v, [1, *range(size - 1)], axis)
        after = np.take(v, [*range(1, size), size - 2], axis)
        out = out + before + after
    return out


def laplacian_variance(pixels: DataFrame) -> DataFrame:
    return laplacian_stencil(pixels).groupBy("frame_key").agg(F.var_pop(F.col("lap").cast("double")).alias("laplacian_variance"))


def stroke_width_variance(ink: DataFrame) -> DataFrame:
    """Variance of mean stroke widths over a frame's components (frame_key, component, dist, h, w); specks go."""
    parts = ink.groupBy("frame_key", "component").agg(F.count("*").alias("area"), F.avg("dist").alias("mean"), F.max("h").alias("h"), F.max("w").alias("w"))
    large = F.col("area") >= F.greatest(F.lit(20), F.floor(0.0001 * F.col("h") * F.col("w")))
    kept = F.when(large & (F.col("mean") > 0.5), F.col("mean"))
    return parts.groupBy("frame_key").agg(F.coalesce(F.var_pop(kept), F.lit(0.0)).alias("stroke_width_variance"), F.count(kept).alias("components"))


def clarity_score(rows: DataFrame, p: ClarityParams | None = None) -> DataFrame:
    """Adds score, clarity and suggestion from laplacian_variance and stroke_width_variance."""
    scored = rows.withColumn("total", clarity_total(F.col("laplacian_variance"), F.col("stroke_width_variance"), p))
    return scored.withColumns({"score": F.round("total", 2), "clarity": clarity_label(F.col("total")), "suggestion": clarity_advice(F.col("total"))}).drop("total")


def clarity_frames(sharpness: DataFrame, ink: DataFrame, p: ClarityParams | None = None) -> DataFrame:
    """Clarity of frames from their laplacian_variance (of pixels or of images) and the strokes of their ink."""
    strokes = stroke_width_variance(ink)
    both = sharpness.join(strokes, "frame_key", "left")
    return clarity_score(both.fillna({"stroke_width_variance": 0.0, "components": 0}), p)


def ink_row_projection(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("frame_key", "y").agg(F.count_if(F.col("v") > 0).alias("ink"))


def ink_pixel_gate(pixels: DataFrame, bands: DataFrame, least: int = 50) -> DataFrame:
    """Bands (frame_key, band_no, y1, y2) with enough ink."""
    inside = bands.join(ink_row_projection(pixels), "frame_key").filter((F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2")))
    inked = inside.groupBy("frame_key", "band_no").agg(F.sum("ink").alias("ink"))
    return bands.join(inked.filter(F.col("ink") >= least).select("frame_key", "band_no"), ["frame_key", "band_no"], "left_semi")


def text_bands(pixels: DataFrame, sizes: DataFrame, min_height: int = 8, min_gap: int = 5, pad: int = 4) -> DataFrame:
    """frame_key, band_no, y1, y2: runs of rows with enough ink, padded, and joined where their gap is small. sizes: frame_key, h, w."""
    rows = ink_row_projection(pixels).join(sizes, "frame_key").filter(F.col("ink") >= F.greatest(F.lit(1.0), 0.02 * F.col("w")))
    island = F.col("y") - F.row_number().over(Window.partitionBy("frame_key").orderBy("y"))
    runs = rows.withColumn("island", island).groupBy("frame_key", "island", "h").agg(F.min("y").alias("a"), (F.max("y") + 1).alias("b"))
    bands = runs.filter(F.col("b") - F.col("a") >= min_height).select("frame_key", F.greatest(F.lit(0), F.col("a") - pad).alias("y1"), F.when(F.col("b") >= F.col("h"), F.col("h")).otherwise(F.least(F.col("h"), F.col("b") + pad)).alias("y2"))
    order = Window.partitionBy("frame_key").orderBy("y1")
    reach = F.max("y2").over(order.rowsBetween(Window.unboundedPreceding, -1))
    number = F.sum(F.when(F.col("reach").isNull() | (F.col("y1") - F.col("reach") >= min_gap), 1).otherwise(0)).over(order) - 1
    joined = bands.withColumn("reach", reach).withColumn("band_no", number)
    return joined.groupBy("frame_key", "band_no").agg(F.min("y1").alias("y1"), F.max("y2").alias("y2"))


def band_default(frames: DataFrame, bands: DataFrame) -> DataFrame:
    """Bands of each frame (frame_key, h), or one that spans it."""
    joined = frames.join(bands, "frame_key", "left")
    return joined.select("frame_key", F.coalesce("band_no", F.lit(0)).alias("band_no"), F.coalesce("y1", F.lit(0)).alias("y1"), F.coalesce("y2", F.col("h")).alias("y2"))


def frame_signature(mask: DataFrame, rows: int = 90, columns: int = 160, over: float = 32.0) -> DataFrame:
    """frame_key, signature: the ink mask (pixels with h and w) averaged over a grid and cut at a level, packed into longs."""
    cell = F.floor(F.col("y") * rows / F.col("h")) * columns + F.floor(F.col("x") * columns / F.col("w"))
    cells = mask.groupBy("frame_key", cell.cast("long").alias("cell")).agg((F.avg("v") > over).alias("on"))
    bit = F.when(F.col("on"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("cell") % 64).cast("int"))).otherwise(F.lit(0).cast("long"))
    words = cells.groupBy("frame_key", F.floor(F.col("cell") / 64).cast("long").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("frame_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda s: s["bits"]).alias("signature"))
