"""A corpus pipeline of five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; a stage's rows are written as Parquet and read
again as the next one's documents. All but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lecturelake.llm import decontaminate, exact_dedup, near_join, pieces, quality
from lecturelake.llm._spark import materialize, read_table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return near_join.drop_near_copies(docs, near_join.JaccardParams(words=5, num=80, den=100))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark phrase occurs."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the documents that are left."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("sentencepiece encoding", as_pieces),
]

#: A fitted classifier and a tokenizer aren't SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{n}")
    return docs
