"""Operators on board regions and recognised text: boxes x1, y1, x2, y2 in pixels of a frame w by h."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lecturelake.functions.text import low_value, trimmed

BOX = ("x1", "y1", "x2", "y2")


def roi_clip(rows: DataFrame) -> DataFrame:
    """Boxes cut to their frame (w, h)."""
    inside = lambda c, top: F.least(F.greatest(F.lit(0), F.col(c)), F.col(top))
    return rows.withColumns({"x1": inside("x1", "w"), "y1": inside("y1", "h"), "x2": inside("x2", "w"), "y2": inside("y2", "h")})


def roi_valid(rows: DataFrame) -> DataFrame:
    return rows.filter("x2 > x1 and y2 > y1")


def area() -> Column:
    side = lambda a, b: F.greatest(F.lit(0), F.col(b) - F.col(a))
    return side("x1", "x2") * side("y1", "y2")


def area_ratio() -> Column:
    return area() / F.greatest(F.lit(1), F.col("h") * F.col("w"))


def roi_area_ratio(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ratio", area_ratio())


def roi_area_filter(rows: DataFrame, least: float) -> DataFrame:
    return rows.filter(area_ratio() >= least)


def roi_full_frame_fallback(rows: DataFrame, least: float) -> DataFrame:
    """Boxes that are too small become the whole frame, and say so in roi_method."""
    small = area_ratio() < least
    whole = {"x1": F.lit(0), "y1": F.lit(0), "x2": F.col("w"), "y2": F.col("h"), "roi_method": F.lit("full_frame_video_fallback")}
    return rows.withColumns({c: F.when(small, v).otherwise(F.col(c)) for c, v in whole.items()})


def largest_roi(boxes: DataFrame, frame: tuple[str, ...] = ("frame_key",), last_tie: bool = False, classes: list[int] | None = None) -> DataFrame:
    """The largest box of each frame (area over 0); of equal ones the first by ``ord``, or the last."""
    rows = boxes if classes is None else boxes.filter(F.col("class_id").isin(classes))
    tie = F.col("ord") if last_tie else -F.col("ord")
    best = rows.filter(area() > 0).groupBy(*frame).agg(F.max_by(F.struct("ord", *BOX), F.struct(area().alias("area"), tie.alias("tie"))).alias("b"))
    return best.select(*frame, "b.*")


def roi_cascade(frames: DataFrame, candidates: DataFrame, priority: tuple[str, ...] = ("yolo_world", "yolo", "heuristic")) -> DataFrame:
    """For each frame (frame_key, w, h) the largest box of the first source that has one, else the whole frame."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("source"))
    found = candidates.filter(area() > 0).withColumn("rank", rank).filter("rank > 0")
    best = found.groupBy("frame_key").agg(F.min_by(F.struct("source", *BOX), F.struct("rank", (-area()).alias("size"), "ord")).alias("b"))
    joined = frames.join(best, "frame_key", "left")
    return joined.select("frame_key", F.coalesce("b.source", F.lit("full_frame")).alias("roi_method"), *[F.coalesce(F.col(f"b.{c}"), d).alias(c) for c, d in zip(BOX, (F.lit(0), F.lit(0), F.col("w"), F.col("h")), strict=True)])


def contour_roi_topk(contours: DataFrame, min_area_ratio: float = 0.05) -> DataFrame:
    """The largest contour of each frame (area, x1..y2, ord) that is wide and high enough; small ones don't count."""
    fit = (F.col("area") >= min_area_ratio * F.col("w") * F.col("h")) & (F.col("x2") - F.col("x1") >= 0.2 * F.col("w")) & (F.col("y2") - F.col("y1") >= 0.15 * F.col("h"))
    best = contours.filter(fit).groupBy("frame_key").agg(F.max_by(F.struct("ord", *BOX), F.struct("area", (-F.col("ord")).alias("tie"))).alias("b"))
    return best.select("frame_key", "b.*")


def ocr_entries(detections: DataFrame, least_conf: float = 0.15) -> DataFrame:
    """frame_key, ord, ymin, ymax, xmin, text of detections (polygon of x, y points); weak and malformed ones go."""
    xs, ys = F.transform("polygon", lambda p: p["x"]), F.transform("polygon", lambda p: p["y"])
    good = (F.size("polygon") >= 1) & ~F.exists("polygon", lambda p: p["x"].isNull() | p["y"].isNull()) & (F.coalesce("conf", F.lit(1.0)) >= least_conf)
    rows = detections.filter(F.coalesce(good, F.lit(False)))
    return rows.select("frame_key", "ord", F.array_min(ys).alias("ymin"), F.array_max(ys).alias("ymax"), F.array_min(xs).alias("xmin"), "text")


def median_height(entries: DataFrame) -> DataFrame:
    return entries.groupBy("frame_key").agg(F.median(F.greatest(F.lit(1.0), F.col("ymax") - F.col("ymin"))).alias("median_height"))


def reading_order_lines(entries: DataFrame, gap_ratio: float = 0.55) -> DataFrame:
    """frame_key, line_no, line: entries gathered into lines from top to bottom, each read from left to right.

    Going down by centre, an entry joins the current line while it is near the line's mean centre. The fold
    runs per frame over its own detections.
    """
    kept = entries.withColumn("text", trimmed(F.coalesce("text", F.lit("")))).filter("text <> ''")
    item = F.struct(((F.col("ymin") + F.col("ymax")) / 2).alias("cy"), F.col("xmin").alias("x"), F.col("ord").alias("o"), "text")
    frames = kept.groupBy("frame_key").agg(F.array_sort(F.collect_list(item)).alias("items"), F.median(F.greatest(F.lit(1.0), F.col("ymax") - F.col("ymin"))).alias("height"))
    near = F.greatest(F.lit(5.0), gap_ratio * F.col("height"))
    kind = "struct<sum:double,items:array<struct<cy:double,x:double,o:bigint,text:string>>>"
    start = F.lit(None).cast(f"array<{kind}>")
    one = lambda i: F.struct(i["cy"].cast("double").alias("sum"), F.array(F.struct(i["cy"].cast("double").alias("cy"), i["x"].cast("double").alias("x"), i["o"].cast("long").alias("o"), i["text"].alias("text"))).alias("items")).cast(kind)

    def step(lines: Column, i: Column) -> Column:
        last = F.element_at(lines, -1)
        joins = F.abs(i["cy"] - last["sum"] / F.size(last["items"])) <= near
        grown = F.struct((last["sum"] + i["cy"]).alias("sum"), F.concat(last["items"], one(i)["items"]).alias("items")).cast(kind)
        return F.when(lines.isNull(), F.array(one(i))).when(joins, F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(grown))).otherwise(F.concat(lines, F.array(one(i))))

    lines = frames.select("frame_key", F.posexplode(F.aggregate("items", start, step)).alias("line_no", "l"))
    by_x = F.array_sort(F.transform("l.items", lambda i: F.struct(i["x"].alias("x"), i["cy"].alias("cy"), i["o"].alias("o"), i["text"].alias("text"))))
    return lines.select("frame_key", F.col("line_no").cast("long").alias("line_no"), F.array_join(F.transform(by_x, lambda i: i["text"]), " ").alias("line"))


def ocr_source_label(frames: DataFrame, fallback: DataFrame, prefer_printed: bool = True, engine: str = "easyocr") -> DataFrame:
    """frame_key, ocr_source: which pass gave a frame's text. frames and fallback: frame_key, text (joined lines).

    The fallback pass replaces weak text only where its own isn't weak.
    """
    other = fallback.select("frame_key", F.col("text").alias("other"))
    both = frames.join(other, "frame_key", "left").withColumn("text", F.coalesce("text", F.lit("")))
    weak, rescue = low_value(F.col("text")), ~low_value(F.col("other"))
    name = {"easyocr": "roi_easyocr", "paddleocr": "roi_paddleocr"}.get(engine, "roi_printed") if prefer_printed else "roi_handwriting"
    other_name = "handwriting_full_frame" if prefer_printed else "printed_full_frame"
    label = F.when(weak & F.coalesce(rescue, F.lit(False)), other_name).when(~weak, name).when(trimmed(F.col("text")) != "", f"{name}_weak").otherwise("none")
    return both.select("frame_key", label.alias("ocr_source"))


def stops(perplexity: Column, useful: Column, stop_below: float, useful_over: int) -> Column:
    """Whether no engine is tried after one with this result."""
    return (perplexity < stop_below) | (useful > useful_over)


def engine_select(runs: DataFrame, stop_below: float = 800.0, useful_over: int = 12, accept_below: float = 1000.0) -> DataFrame:
    """For each frame the engine whose text is taken. runs: frame_key, engine_ord, engine, perplexity, useful.

    Engines are tried in order until one is fluent or gives enough characters; the last tried one that is
    acceptable, or gives any, wins.
    """
    last = stops(F.col("perplexity"), F.col("useful"), stop_below, useful_over)
    until = F.coalesce(F.min(F.when(last, F.col("engine_ord"))).over(Window.partitionBy("frame_key")), F.lit(2**31 - 1))
    tried = runs.withColumn("until", until).filter("engine_ord <= until").filter((F.col("perplexity") < accept_below) | (F.col("useful") > 0))
    return tried.groupBy("frame_key").agg(F.max_by("engine", "engine_ord").alias("engine"))
