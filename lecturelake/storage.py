"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in that of spark.checkpoint.dir, or in one of our own where it is unset and Spark runs on one machine."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lecturelake-")
        context.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table, so that what several parts of a plan read is computed once and outlives any executor."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few short columns that may be broadcast.
BROADCAST_ROWS = 200_000


def bounded(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table with a broadcast hint if a count shows that it is within ``rows``, else as it is."""
    return F.broadcast(table) if table.count() <= rows else table


#: Of a sieve's 64-bit keys so many leading bits name the word, the six after them a bit of it; so it has 524,288 rows of two numbers at most.
SIEVE_BITS = 19


def _cell(key: Column) -> tuple[Column, Column]:
    return F.shiftright(key, 64 - SIEVE_BITS), F.shiftright(key, 58 - SIEVE_BITS).bitwiseAND(F.lit(63)).cast("int")


def sieve(keys: DataFrame, key: Column, name: str) -> DataFrame:
    """A table of bits that tells which parts of the 64-bit numbers hold a key; it is as small for any number of keys, so that it may be broadcast."""
    word, bit = _cell(key)
    marked = keys.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit"))
    return written(marked.groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), name)


def sieved(rows: DataFrame, key: Column, table: DataFrame, outside: bool = False) -> DataFrame:
    """``rows`` whose key may be among those of a sieve: all whose key is, and by chance some others. ``outside``: the other rows, whose key is surely none of them.

    So what a join can't meet is dropped before the join shuffles it; the more keys a sieve has, the more it lets through.
    """
    word, bit = _cell(F.col("_key"))
    met = F.call_function("shiftright", F.col("_bits"), bit).bitwiseAND(F.lit(1)) == 1
    joined = rows.withColumn("_key", key).withColumn("_word", word).join(F.broadcast(table), "_word", "left" if outside else "inner")
    return joined.filter(~F.coalesce(met, F.lit(False)) if outside else met).select(*rows.columns)
