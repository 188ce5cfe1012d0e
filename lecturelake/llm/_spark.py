"""Small helpers that every operator here shares: shared-folder tables, plain document reads, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and Spark runs on one machine."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lecturelake-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cuts lineage by a table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a table that ``materialize`` wrote, once nothing reads it any more."""
    spark = table.sparkSession
    files = table.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of a table can't clash with those that an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column end to end, and the n + 1 offsets into them. Nulls are empty."""
    texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a piece holds about ``limit`` bytes of ``column``, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = byte_view(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(off, off[start] + limit, side="right")) - 1)
            yield batch.slice(start, min(end, batch.num_rows) - start)
            start = end


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


#: Rows of one or two numbers that may be broadcast (some 50 MB in each executor); beyond it a join shuffles.
BROADCAST_ROWS = 1_000_000


def hinted(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it is within ``bound`` rows, else as it is. Give it a written table."""
    return F.broadcast(df) if df.count() <= bound else df


#: Rows of one key that a task of a spread join may read.
ROWS_A_PART = 400


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", narrow: bool = True, rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """Joins rows with a table, where a key may hold a third of all rows. Give it written tables.

    A narrow table within the bound of ``hinted`` is broadcast. Else each key with more than ``rows_a_part`` rows is
    dealt over several parts by a hash of the row, and what the table has of such a key goes to all of its parts.
    """
    if narrow and table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys, how)
    hot = materialize(rows.groupBy(*keys).count().filter(F.col("count") > rows_a_part).select(*keys, F.ceil(F.col("count") / rows_a_part).cast("int").alias("_parts")), "hot-keys")
    if hot.isEmpty():
        return rows.join(table, keys, how)
    one = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hinted(hot), keys, "left").withColumn("_part", F.pmod(F.xxhash64(*rows.columns), one).cast("int")).drop("_parts")
    copies = table.join(hinted(hot), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), one - 1))).drop("_parts")
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")


def content_key(text: Column) -> Column:
    """A 64-bit hash of a text. With doc_id it names a row, as doc_ids may be null or shared; rows that repeat whole share it."""
    return F.xxhash64(text)


def _is_row(docs: DataFrame, keys: DataFrame) -> Column:
    return docs["doc_id"].cast("long").eqNullSafe(keys["_doc_id"]) & (content_key(docs["text"]) == keys["_key"])


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` but those that ``gone`` (doc_id, key; a written table) names, all columns kept."""
    keys = hinted(gone.select(F.col("doc_id").cast("long").alias("_doc_id"), F.col("key").alias("_key")))
    return docs.join(keys, _is_row(docs, keys), "left_anti")


def one_of_each(docs: DataFrame, again: DataFrame) -> DataFrame:
    """``docs`` with one row only for each that ``again`` (doc_id, key; a written table) names, all columns kept."""
    if again.isEmpty():
        return docs
    keys = hinted(again.select(F.col("doc_id").cast("long").alias("_doc_id"), F.col("key").alias("_key")))
    some = docs.join(keys, _is_row(docs, keys), "left_semi")
    return without(docs, again).unionByName(some.dropDuplicates(["doc_id", "text"]))
