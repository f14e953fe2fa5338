"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every end of an edge (a, b): comp is the smallest id reachable.

    Each round gives a vertex the smallest label among its neighbours and itself, then the label of that label. Both
    steps are equi-joins and sums by key; only one count a round reaches the driver. Each round is written out, so a lost
    executor costs one round.
    """
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("near")).union(edges.select(F.col("b"), F.col("a")))
    both = materialize(both.distinct(), "edges")
    labels = materialize(both.groupBy("id").agg(F.least(F.col("id"), F.min("near")).alias("comp")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("id", "near"), "near").groupBy("id").agg(F.min("comp").alias("best"))
        step = labels.join(seen, "id").select("id", "comp", F.least("comp", "best").alias("next"))
        step = materialize(step, "step")
        jump = step.select(F.col("id").alias("next"), F.col("next").alias("further"))
        after = materialize(
            step.join(jump, "next").select("id", "comp", F.least("next", "further").alias("new")), "labels"
        )
        labels = after.select("id", F.col("new").alias("comp"))
        if after.filter("new < comp").isEmpty():
            return labels
