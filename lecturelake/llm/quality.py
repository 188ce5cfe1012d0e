"""Text quality by a sparse rule ensemble, compiled into Spark columns.

Statistics of a text are native column expressions. A random forest of shallow trees is grown on a bounded
sample of labelled rows; every path from a root to a node becomes a conjunctive rule; a logistic regression
with a lasso penalty weighs the rules, and those with a weight left are compiled into one column expression
that scores any number of documents in a single scan without a join, a shuffle or Python.

Defined results: null and empty texts have statistics of 0 and get the score that the rules give these;
labels that are null are not learned from; with labels of one class only, the score is that class's share;
with none, it is 0.5. Labels, lang, source and doc_id are never part of a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lecturelake.llm._spark import materialize, read_table, table_columns


@dataclass(frozen=True)
class QualityParams:
    sample_rows: int = 20_000
    """Bound of the labelled rows that the trees and weights are fitted on, taken in the order of a hash of doc_id."""
    n_trees: int = 16
    depth: int = 3
    lasso: float = 0.0005
    threshold: float = 0.3
    seed: int = 11


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name; all doubles, all 0 for an empty text."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / n
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")
    return {
        "chars": F.length(t).cast("double"),
        "words": F.size(words).cast("double"),
        "word_length": (n - F.size(words) + 1) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "line_words": n_words / n_lines,
        "symbols": share(r"[#$%&*@^~=+<>{}\[\]\\_]"),
        "bars": share(r"[|]"),
        "calls": share(r"[!?]"),
        "upper": share(r"\p{Lu}"),
        "digits": share(r"[0-9]"),
        "stops": share(r"[.,;:]"),
    }


Rule = tuple[tuple[int, bool, float], ...]
_STEP = re.compile(r"(If|Else) \(feature (\d+) (<=|>) (\S+)\)")


def paths(tree_text: str) -> set[Rule]:
    """Conjunctions of (statistic, is greater, threshold) that lead from the root of a printed tree to each node."""
    found: set[Rule] = set()
    trail: list[tuple[int, tuple[int, bool, float]]] = []
    for line in tree_text.splitlines():
        if m := _STEP.search(line):
            depth = len(line) - len(line.lstrip())
            trail = [x for x in trail if x[0] < depth] + [(depth, (int(m[2]), m[3] == ">", float(m[4])))]
            found.add(tuple(x[1] for x in trail))
    return found


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, text: Column) -> Column:
        """Probability of label 1 as a column."""
        stats = list(statistics(text).values())
        holder = F.array(*stats)  # each statistic is computed once a row
        return F.transform(F.array(holder), self._sum)[0]

    def _sum(self, held: Column) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(_holds(rule, lambda i: held[i]), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _holds(rule: Rule, value) -> Column:
    out = F.lit(True)
    for i, greater, limit in rule:
        out = out & ((value(i) > F.lit(limit)) if greater else (value(i) <= F.lit(limit)))
    return out


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams | None = None) -> RuleEnsemble:
    """Learns from the labelled rows that aren't held out."""
    params = params or QualityParams()
    known = table_columns(labels, "doc_id", "quality").filter(~held_out("doc_id") & F.col("quality").isin(0, 1))
    sample = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.sample_rows), "quality-labels")
    names = list(statistics(F.lit("")))
    rows = (
        table_columns(docs, "doc_id", "text")
        .join(F.broadcast(sample), "doc_id")  # sample_rows rows at most
        .select("doc_id", F.col("quality").cast("double").alias("label"), *[c.alias(n) for n, c in statistics(F.col("text")).items()])
    )
    rows = materialize(rows.orderBy(F.xxhash64("doc_id"), "doc_id").coalesce(1), "quality-sample")  # the same rows in the same order give the same model
    classes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        share = next(iter(classes), 0.5)
        return RuleEnsemble(30.0 if share == 1 else -30.0 if share == 0 else 0.0, ())
    points = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("label", "features").cache()
    forest = RandomForestClassifier(numTrees=params.n_trees, maxDepth=params.depth, maxBins=64, subsamplingRate=0.7, featureSubsetStrategy="0.6", minInstancesPerNode=5, seed=params.seed).fit(points)
    points.unpersist()
    rules = sorted(set().union(*[paths(t.toDebugString) for t in forest.trees]))
    if not rules:
        return RuleEnsemble(0.0, ())
    # each rule as a 0/1 column
    flags = rows.select("label", *[F.when(_holds(r, lambda i: F.col(names[i])), 1.0).otherwise(0.0).alias(f"r{k}") for k, r in enumerate(rules)])
    points = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="features").transform(flags).select("label", "features").cache()
    model = LogisticRegression(elasticNetParam=1.0, regParam=params.lasso, maxIter=60, standardization=False).fit(points)
    points.unpersist()
    weights = model.coefficients.toArray()
    return RuleEnsemble(float(model.intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9))


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def scores(docs: DataFrame, labels: DataFrame, params: QualityParams | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    params = params or QualityParams()
    model = fit(docs, labels, params)
    scored = table_columns(docs, "doc_id", "text").select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= params.threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, params: QualityParams | None = None) -> DataFrame:
    """Documents that the classifier accepts, all columns kept."""
    params = params or QualityParams()
    return docs.filter(fit(docs, labels, params).score(F.col("text")) >= params.threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
