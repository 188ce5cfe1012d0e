"""Where each family of operators gets its rows from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Tables:
    """The tables of one folder, read as they are asked for."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


# --- board lines: documents cut at line ends; a lesson is a source, a frame is a document
def lines(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("source").alias("lesson_id"), F.col("doc_id").alias("frame_index"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return d.withColumn("line_no", F.col("line_no").cast("long"))


def indexed_lines(t: Tables) -> DataFrame:
    """lesson_id, frame_index, line_index, line: all lines, numbered over a lesson. Numbers come from sums over blocks of documents, so that no task sorts a lesson."""
    d = t.documents.select(F.col("source").alias("lesson_id"), F.col("doc_id").alias("frame_index"), F.floor(F.col("doc_id") / 1000).alias("block"), F.split("text", "\n").alias("held"))
    d = d.withColumn("n", F.coalesce(F.size("held"), F.lit(0)))
    sums = d.groupBy("lesson_id", "block").agg(F.sum("n").alias("of_block"))
    before = sums.select("lesson_id", "block", (F.sum("of_block").over(Window.partitionBy("lesson_id").orderBy("block")) - F.col("of_block")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("lesson_id", "block").orderBy("frame_index")) - F.col("n")
    placed = d.withColumn("first", inside).join(before, ["lesson_id", "block"])
    rows = placed.select("lesson_id", "frame_index", (F.col("before") + F.col("first")).alias("first"), F.posexplode("held").alias("i", "line"))
    return rows.select("lesson_id", "frame_index", (F.col("first") + F.col("i")).alias("line_index"), "line")


LINES = r"""lines AS (SELECT d.source AS lesson_id, d.doc_id AS frame_index, u.n - 1 AS line_no, u.line AS line
  FROM documents d, unnest(string_split(d.text, chr(10))) WITH ORDINALITY AS u(line, n))"""


def trim_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def key_sql(x: str) -> str:
    return f"lower(replace({trim_sql(x)}, 'ß', 'ss'))"


UNION = LINES + f""", merged AS (SELECT lesson_id, frame_index, line_no, {trim_sql('line')} AS line, {key_sql('line')} AS key FROM lines WHERE {key_sql('line')} <> ''
  QUALIFY row_number() OVER (PARTITION BY lesson_id, {key_sql('line')} ORDER BY frame_index, line_no) = 1)"""


# --- speech: conversations dealt over the lessons by conv_id
def speech(t: Tables) -> DataFrame:
    return t.conversations.select(F.concat(F.lit("src"), F.col("conv_id") % 20).alias("lesson_id"), F.col("conv_id").alias("start_sec"), F.col("turn").alias("seg_no"), "text")


SPEECH = f"""speech AS (SELECT 'src' || (conv_id % 20) AS lesson_id, conv_id AS start_sec, turn AS seg_no, {trim_sql("coalesce(text, '')")} AS line FROM conversations),
  transcripts AS (SELECT lesson_id, {trim_sql("string_agg(line, ' ' ORDER BY start_sec, seg_no, line)")} AS transcript FROM speech WHERE line <> '' GROUP BY lesson_id)"""
BOARDS = "boards AS (SELECT lesson_id, string_agg(line, chr(10) ORDER BY frame_index, line_no, line) AS paragraph FROM merged GROUP BY lesson_id)"


# --- frames: embeddings by label; 64 signature bits, one for each positive number
def frames(t: Tables) -> DataFrame:
    bits = F.aggregate(
        F.transform("embedding", lambda e, i: F.when(e > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)
    )
    return t.embeddings.select(F.col("label").cast("long").alias("lesson_id"), F.col("vec_id").alias("frame_index"), ((F.col("vec_id") * 37) % 101).cast("double").alias("score"), F.array(bits).alias("signature"))


FRAMES = """frames AS (SELECT CAST(label AS BIGINT) AS lesson_id, vec_id AS frame_index, CAST((vec_id * 37) % 101 AS DOUBLE) AS score,
  list_transform(embedding, lambda e: e > 0) AS bits FROM embeddings)"""


# --- pixels: each embedding as 8 x 8 gray
def pixels(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").alias("frame_key"), F.posexplode("embedding").alias("i", "e"))
    return e.select("frame_key", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("long").alias("x"), F.floor((F.col("e").cast("double") + 1) * 127).alias("v"))


PIXELS = """pixels AS (SELECT e.vec_id AS frame_key, (u.n - 1) // 8 AS y, (u.n - 1) % 8 AS x, CAST(floor((CAST(u.e AS DOUBLE) + 1) * 127) AS BIGINT) AS v
  FROM embeddings e, unnest(e.embedding) WITH ORDINALITY AS u(e, n))"""


# --- energy windows: events of a user in order, one number a window
def windows(t: Tables) -> DataFrame:
    e = t.events.select(F.col("user_id").alias("clip_id"), "ts", "event_id", F.col("value").cast("double").alias("value"))
    number = F.row_number().over(Window.partitionBy("clip_id").orderBy("ts", "event_id")) - 1
    return e.withColumn("window_no", number.cast("long")).select("clip_id", "window_no", F.lit(1).cast("long").alias("n"), (F.col("value") * F.col("value")).alias("sum_sq"), "value")


WINDOWS = """windows AS (SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS window_no, CAST(1 AS BIGINT) AS n,
  CAST(value AS DOUBLE) * CAST(value AS DOUBLE) AS sum_sq, CAST(value AS DOUBLE) AS value FROM events)"""

# --- boxes: line items of an order; the ordinal is over all columns, as their key isn't unique
ALL = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def boxes(t: Tables) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ALL))
    return t.lineitem.select(
        F.col("l_orderkey").alias("frame_key"),
        order.cast("long").alias("ord"),
        (F.col("l_partkey") % 60).alias("x1"),
        (F.col("l_suppkey") % 40).alias("y1"),
        (F.col("l_partkey") % 60 + F.col("l_quantity").cast("long")).alias("x2"),
        (F.col("l_suppkey") % 40 + F.round(F.col("l_tax") * 500).cast("long")).alias("y2"),
        F.col("l_linenumber").cast("long").alias("class_id"),
        (F.col("l_discount") * 10).alias("conf"),
        F.lit(100).cast("long").alias("w"),
        F.lit(60).cast("long").alias("h"),
        F.col("l_partkey").alias("part"),
        "l_returnflag",
        F.col("l_quantity").cast("long").alias("quantity"),
    )


BOXES = f"""boxes AS (SELECT l_orderkey AS frame_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ALL)}) AS ord,
  l_partkey % 60 AS x1, l_suppkey % 40 AS y1, l_partkey % 60 + CAST(l_quantity AS BIGINT) AS x2, l_suppkey % 40 + CAST(round(l_tax * 500) AS BIGINT) AS y2,
  CAST(l_linenumber AS BIGINT) AS class_id, l_discount * 10 AS conf, CAST(100 AS BIGINT) AS w, CAST(60 AS BIGINT) AS h, l_partkey AS part, l_returnflag,
  CAST(l_quantity AS BIGINT) AS quantity FROM lineitem)"""
AREA = "(greatest(0, x2 - x1) * greatest(0, y2 - y1))"


# --- sampled frames: events of a user, with frame rates of 0, 10 and 20 and a position for some
def samples(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("lesson_id"),
        F.col("event_id").alias("frame_index"),
        ((F.col("user_id") % 3) * 10).cast("double").alias("fps"),
        F.when(F.col("event_id") % 5 == 0, F.col("event_id") * 7).otherwise(0).cast("double").alias("msec"),
        F.lit(0).cast("long").alias("x1"),
        F.lit(0).cast("long").alias("y1"),
        (F.col("event_id") % 101).alias("x2"),
        (F.col("event_id") % 61).alias("y2"),
        F.lit(100).cast("long").alias("w"),
        F.lit(60).cast("long").alias("h"),
    )


SAMPLES = """samples AS (SELECT user_id AS lesson_id, event_id AS frame_index, CAST((user_id % 3) * 10 AS DOUBLE) AS fps,
  CAST(CASE WHEN event_id % 5 = 0 THEN event_id * 7 ELSE 0 END AS DOUBLE) AS msec, 0 AS x1, 0 AS y1, event_id % 101 AS x2, event_id % 61 AS y2, 100 AS w, 60 AS h FROM events)"""
STAMP = "CASE WHEN msec > 0 THEN msec / 1000 WHEN fps > 0 THEN frame_index / fps ELSE 0 END"


def sampled_sql(gap: float) -> str:
    return f"sampled AS (SELECT *, round({STAMP}, 3) AS ts FROM samples WHERE frame_index % greatest(1, CAST(round_even({gap} * CASE WHEN fps > 0 THEN fps ELSE 25 END, 0) AS BIGINT)) = 0)"
