"""Sinks of JSON lines that may be cut off and repeated: each batch is written once, and a reader sees whole batches only.

An attempt writes its rows to a folder of its own; a line in the commit log then says which attempt of a batch
counts. An attempt that was cut off left no line and is never read; a batch that has one is not written again. Of two
attempts that ended side by side the smaller name counts, for every reader alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "batch long, attempt string"


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """batch, attempt: the attempt that counts of each batch that was written whole. One row a batch."""
    log = spark.read.schema(COMMIT).option("recursiveFileLookup", True).option("ignoreMissingFiles", True).json(f"{path}/commit[s]")
    return log.groupBy("batch").agg(F.min("attempt").alias("attempt"))


def _has(spark: SparkSession, folder: str) -> bool:
    """Whether a folder is there, in whichever file system holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_attempt(rows: DataFrame, path: str, batch: int) -> str:
    """Writes document (a JSON text) of each row to a new folder of the batch and gives its name; it doesn't count yet."""
    attempt = uuid.uuid4().hex
    rows.select(F.col("document").alias("value")).write.text(f"{path}/rows/batch={batch}/attempt={attempt}")
    return attempt


def commit(spark: SparkSession, path: str, batch: int, attempt: str) -> None:
    spark.range(1).select(F.lit(batch).cast("long").alias("batch"), F.lit(attempt).alias("attempt")).coalesce(1).write.mode("append").json(f"{path}/commits")


def is_committed(spark: SparkSession, path: str, batch: int) -> bool:
    return _has(spark, f"{path}/commits") and not _commits(spark, path).filter(F.col("batch") == batch).isEmpty()


def write_batch(rows: DataFrame, path: str, batch: int = 0) -> None:
    """Writes the rows (document) as one batch, unless it was written before."""
    spark = rows.sparkSession
    if not is_committed(spark, path, batch):
        commit(spark, path, batch, write_attempt(rows, path, batch))


def stream_batches(stream: DataFrame, path: str, checkpoint: str):
    """Starts a stream of rows (document) into the sink; micro-batches that Spark repeats after a loss are written once."""
    return stream.writeStream.foreachBatch(lambda rows, n: write_batch(rows, path, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """batch, document: all rows of the batches that were written whole."""
    if not _has(spark, f"{path}/commits"):
        return spark.createDataFrame([], "batch long, document string")
    rows = spark.read.schema("value string, batch long, attempt string").option("basePath", f"{path}/rows").text(f"{path}/rows")
    return rows.join(_commits(spark, path), ["batch", "attempt"], "left_semi").select("batch", F.col("value").alias("document"))


def latest(documents: DataFrame, key: str = "lesson_id") -> DataFrame:
    """``key`` (text), document: of each key the document of its last batch, and of several there the last in order of text."""
    keyed = documents.withColumn(key, F.get_json_object("document", f"$.{key}"))
    return keyed.groupBy(key).agg(F.max_by("document", F.struct("batch", "document")).alias("document"))
