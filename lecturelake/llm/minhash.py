"""Near copies by min-wise hashing: one permutation with optimal densification, banded buckets, star-shaped candidates.

Each document's set of distinct k-word shingles is sketched (see sketch.py) and filed under a hash of each band. The
documents of a bucket are a star: each is a candidate with the bucket's centre, so a bucket of m documents gives
m - 1 pairs. Candidates are verified on the whole sets. Buckets whose documents are then still in several components
are compared further, until no two documents of a bucket that could be alike are unknown to each other; the documents
of crowded buckets, such as those of a passage that countless documents hold, are indexed by their rare tokens first,
as in ``near_join``, whose ``settled`` has the steps. So a link is lost only if its documents share no bucket: with the
4 rows and 48 bands here, one of 1e11 links of similarity 0.8 is, and fewer of any above.

Defined results: null and empty texts have no shingles and link with nothing; a text of fewer than k words is one
shingle; equal sets link without a sketch; rows that repeat whole, rows that share a doc_id but not the text, and rows
without doc_id are told apart as in ``near_join``; a component's id is its smallest doc_id, null if none has one; ties
don't arise; very long texts are shingled whole; columns other than doc_id and text may have any name; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lecturelake.llm import near_join
from lecturelake.llm._spark import read_table
from lecturelake.llm.near_join import LinkParams
from lecturelake.llm.sketch import SketchParams, shared_bands


@dataclass(frozen=True)
class MinHashParams(LinkParams):
    rows: int = 4
    bands: int = 48
    crowd: int = 16


def links(docs: DataFrame, maps: DataFrame, params: MinHashParams) -> DataFrame:
    """id, component of all documents that link with another; ``docs`` (doc_id, text) has one document for each different set."""
    least = -(-params.num // (params.den - params.num)) if params.num < params.den else 2**62  # smaller sets link with equal ones only
    buckets = shared_bands(docs, SketchParams(params.words, params.rows, params.bands, params.chunk_bytes, least))
    buckets = buckets.select("sig", "doc", "n", F.lit(0).alias("rare"), F.lit(False).alias("many"))
    return near_join.settled(docs, maps, buckets, params, [(by_prefixes, True), (near_join.crowd_bands, False)])


def by_prefixes(docs: DataFrame, params: MinHashParams) -> DataFrame:
    """Entries of rare tokens and of combinations of the documents of crowded buckets."""
    return near_join.live_entries(docs.select("doc_id", "text"), params).join(docs.select(F.col("doc_id").alias("doc"), "component"), "doc")


def near_groups(docs: DataFrame, params: MinHashParams | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for each document."""
    return near_join.near_groups(docs, params or MinHashParams(), links)


def drop_near_copies(docs: DataFrame, params: MinHashParams | None = None) -> DataFrame:
    """One document of each group of near copies (the one with the smallest doc_id), all columns kept."""
    return near_join.drop_near_copies(docs, params or MinHashParams(), links)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(read_table(spark, sf_dir, "documents"), MinHashParams(words=4))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
