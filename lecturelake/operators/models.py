"""Scoring with models: user-supplied ones run in batches, and a counted bigram model of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from lecturelake.operators.regions import engine_select, stops
from lecturelake.storage import written


def score_with_model(make_predict: Callable, return_type: DataType, batch_size: int = 64, shapes: list[list[int]] | None = None) -> Callable[..., Column]:
    """A column function from ``make_predict``, which loads a model once a Python worker and returns its batch function.

    ``shapes``: the tensor shape of each array column.
    """
    return predict_batch_udf(make_predict, return_type=return_type, batch_size=batch_size, input_tensor_shapes=shapes)


def engine_cascade(frames: DataFrame, engines: list[tuple[str, Callable[[DataFrame], Column]]], stop_below: float = 800.0, useful_over: int = 12, accept_below: float = 1000.0) -> tuple[DataFrame, DataFrame]:
    """Engines tried in order, each only on the frames that none before it has settled; gives what ``engine_select`` would, and the runs.

    frames: frame_key and what the engines read. An engine is a name and a function from the frames to a column of
    struct<perplexity: double, useful: long>, such as one made by ``score_with_model``. The rows of an engine are
    written before they are split into settled ones and others, so no frame is scored twice, full batches reach the
    next engine, and a lost executor costs its own rows only. The runs have a row for each call of an engine.
    """
    runs, left = None, frames
    for number, (name, engine) in enumerate(engines, 1):
        tried = written(left.withColumn("_run", engine(left)), f"engine-{number}")
        found = tried.select("frame_key", F.lit(number).alias("engine_ord"), F.lit(name).alias("engine"), F.col("_run.perplexity").alias("perplexity"), F.col("_run.useful").alias("useful"))
        runs = found if runs is None else runs.unionByName(found)
        left = tried.filter(~F.coalesce(stops(F.col("_run.perplexity"), F.col("_run.useful"), stop_below, useful_over), F.lit(False))).drop("_run")
    return engine_select(runs, stop_below, useful_over, accept_below), runs


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bigrams(texts: DataFrame, key: str) -> DataFrame:
    w = texts.select(key, words(F.col("text")).alias("w"))
    pairs = F.zip_with(F.concat(F.array(F.lit("")), F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))), F.col("w"), lambda a, b: F.struct(a.alias("before"), b.alias("word")))
    return w.filter(F.size("w") > 0).select(key, F.explode(pairs).alias("p")).select(key, "p.before", "p.word")


def bigram_model(corpus: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of word pairs, of words in front of others, and the number of distinct words (one row), from texts (id, text)."""
    counts = _bigrams(corpus, corpus.columns[0]).groupBy("before", "word").agg(F.count("*").alias("pair_n"))
    before = counts.groupBy("before").agg(F.sum("pair_n").alias("before_n"))
    return counts, before, counts.agg(F.count_distinct("word").alias("v"))


#: Rows of a pair of words and two counts that may be broadcast.
MODEL_ROWS = 500_000


def paragraph_perplexity(texts: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """key, perplexity: exp of the mean negative log-likelihood of a text's words, with one added to every count.

    A text without words has an infinite one. A model of up to ``MODEL_ROWS`` pairs goes to the texts, so that no word of
    theirs is shuffled; with a larger one pairs are counted per text before they meet it.
    """
    counts, before, size = bigram_model(corpus)
    counts, before = written(counts, "bigrams"), written(before, "bigram-heads")
    mine = _bigrams(texts, key)
    if counts.count() <= MODEL_ROWS:
        counts, before, mine = F.broadcast(counts), F.broadcast(before), mine.withColumn("n", F.lit(1))
    else:
        mine = mine.groupBy(key, "before", "word").agg(F.count("*").alias("n"))
    p = (F.coalesce("pair_n", F.lit(0)) + 1) / (F.coalesce("before_n", F.lit(0)) + size.scalar())
    scored = mine.join(counts, ["before", "word"], "left").join(before, "before", "left")
    each = scored.groupBy(key).agg(F.exp(F.sum(-F.log(p) * F.col("n")) / F.sum("n")).alias("perplexity"))
    return texts.select(key).distinct().join(each, key, "left").select(key, F.coalesce("perplexity", F.lit(float("inf"))).alias("perplexity"))
