"""Exact deduplication by a log-structured merge index of text digests.

Each task is a memtable: it digests its documents and flushes one run, sorted by digest, as Parquet with a
Bloom filter and min/max statistics on the digest. Compaction merges runs into one entry a digest, which
keeps the smallest identifier under the order (most code points, smallest doc_id). A probe reads the runs
against the compacted entries; digests with more than one row are hits, and hits are verified on the bytes
of their normalised texts before they count as copies.

Defined results: a null text counts as empty; empty texts are copies of each other; of rows that repeat
whole, one stays; a null doc_id sorts after all others; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lecturelake.llm._spark import content_key, hinted, materialize, one_of_each, read_table, shared_dir, table_columns, without

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def sha256_bytes(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


@dataclass
class DigestIndex:
    """Sorted runs of (digest, doc_id, key, n_chars, row) and, after compaction, one entry a digest."""

    digest: Callable[[Column], Column] = sha256_bytes
    runs: list[DataFrame] = field(default_factory=list)
    entries: DataFrame | None = None

    def flush(self, docs: DataFrame) -> None:
        """Adds documents (doc_id, text) as new sorted runs, one a task."""
        spark = docs.sparkSession
        rows = table_columns(docs, "doc_id", "text").select(
            self.digest(normalised(F.col("text"))).alias("digest"),
            "doc_id",
            content_key(F.col("text")).alias("key"),
            F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
            (F.monotonically_increasing_id() + F.lit(len(self.runs) << 55)).alias("row"),
        )
        path = f"{shared_dir(spark)}/digest-run-{uuid.uuid4().hex}"
        (
            rows.sortWithinPartitions("digest")
            .write.option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.expected.ndv#digest", "1000000")
            .parquet(path)
        )
        self.runs.append(spark.read.schema(rows.schema).parquet(path))

    def all_runs(self) -> DataFrame:
        out = self.runs[0]
        for run in self.runs[1:]:
            out = out.unionByName(run)
        return out

    def compact(self) -> DataFrame:
        """Merges all runs: rows of each digest and the row that stays. Counts are combined before the shuffle."""
        order = F.struct((-F.col("n_chars")).alias("longest"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
        merged = self.all_runs().groupBy("digest").agg(F.count("*").alias("n"), F.min(order).alias("keep"))
        self.entries = materialize(
            merged.select("digest", "n", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row")), "digest-index"
        )
        return self.entries

    def probe(self, docs: DataFrame) -> DataFrame:
        """For each document, whether an indexed text has its digest (doc_id, digest, keep_id or null)."""
        asked = table_columns(docs, "doc_id", "text").select("doc_id", self.digest(normalised(F.col("text"))).alias("digest"))
        return asked.join(self.entries.select("digest", "keep_id"), "digest", "left")


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256_bytes) -> DataFrame:
    """One row a document: doc_id, key (see content_key), keep_id, group_size, kept, digest.

    ``digest`` maps the normalised text to a binary or string; a weak one costs time, never correctness.
    """
    index = DigestIndex(digest)
    index.flush(docs)
    entries = index.compact()
    runs = index.all_runs()
    hits = entries.filter("n > 1")
    plain = runs.join(hits, "digest", "left").select(
        "digest",
        "doc_id",
        "key",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (F.col("n").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"),
    )
    collided = _verified(docs, runs, hits, digest)
    if collided is None:
        return plain
    return plain.join(collided, "digest", "left_anti").unionByName(_by_text(docs, collided, digest))


def _verified(docs: DataFrame, runs: DataFrame, hits: DataFrame, digest: Callable[[Column], Column]) -> DataFrame | None:
    """Compares the bytes of all texts that share a digest. Returns digests that stand for several texts, or None."""
    suspects = materialize(runs.join(hits.select("digest"), "digest", "left_semi").select("doc_id"), "digest-hits")
    texts = (
        table_columns(docs, "doc_id", "text")
        .alias("d")
        .join(hinted(suspects).alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")), "left_semi")
        .select(normalised(F.col("d.text")).alias("norm"))
        .distinct()
    )
    several = texts.select(digest(F.col("norm")).alias("digest")).groupBy("digest").count().filter("count > 1").select("digest")
    several = materialize(several, "digest-collisions")
    return None if several.isEmpty() else several


def _by_text(docs: DataFrame, collided: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Groups documents of the given digests by the normalised text itself."""
    rows = materialize(
        table_columns(docs, "doc_id", "text")
        .withColumn("norm", normalised(F.col("text")))
        .withColumn("digest", digest(F.col("norm")))
        .join(collided, "digest", "left_semi")
        .select("digest", "norm", "doc_id", content_key(F.col("text")).alias("key"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("row")),
        "digest-collided-rows",
    )
    order = F.struct((-F.col("n_chars")).alias("longest"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    keep = rows.groupBy("norm").agg(F.count("*").alias("group_size"), F.min(order).alias("keep"))
    return rows.join(keep, "norm").select("digest", "doc_id", "key", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """Documents without exact copies, all columns kept; of rows that repeat whole, one stays."""
    found = materialize(exact_groups(docs).select("doc_id", "key", "kept"), "exact-groups")
    rows = found.groupBy("doc_id", "key").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    rows = materialize(rows.filter("not stays or n > 1"), "exact-gone")
    return one_of_each(without(docs, rows.filter("not stays").select("doc_id", "key")), rows.filter("stays").select("doc_id", "key"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_groups(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k
"""
