"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lecturelake.llm._spark import materialize, spread_join


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id that links reach) for every id in ``links`` (a, b).

    Labels fall to the smallest of the neighbours', then to their label's own label, until none changes; a
    chain of n links takes about log n rounds. Nothing is gathered per component: rounds are joins and minima.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(both.filter("a <> b").distinct(), "component-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "component-labels")
    while True:
        near = spread_join(edges, labels.withColumnRenamed("id", "b"), ["b"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, F.col("id") == F.col("a")).select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        lower = materialize(lower, "component-lower")
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("next"))
        step = spread_join(lower, jump, ["component"], "left").select("id", "was", F.least("component", F.coalesce("next", "component")).alias("component"))
        step = materialize(step, "component-step")
        labels = step.select("id", "component")
        if step.filter("was <> component").isEmpty():
            return labels
