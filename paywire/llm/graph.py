"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywire.llm.common import saved, scratch


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """node, label: the smallest node that each end of an edge (long columns a, b) can reach.

    A round lets each node point to the first of itself and its neighbours, follows
    the pointers twice more, renames both ends of every edge to where they lead and
    drops edges within one name; the rest is the next round's graph.  Rounds go by the
    nodes' own order first, so stars around their smallest node take one round, then by
    an order drawn anew, in which chains are short: at least every second node goes.
    What a round leaves is written, so a lost executor costs one round.
    """
    spark = edges.sparkSession
    with scratch(spark) as tables:
        left = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{label}-edges")
        steps: list[DataFrame] = []
        while not left.isEmpty():
            drawn = F.xxhash64 if steps else (lambda *_: F.lit(0).cast("long"))

            def place(node: Column) -> Column:
                return F.struct(drawn(node, F.lit(len(steps))).alias("order"), node.alias("node"))

            both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min(place(F.col("b"))).alias("first"))
            up = first = least.select(F.col("a").alias("node"), F.least(place(F.col("a")), "first")["node"].alias("up"))
            for _ in range(2):
                above = first.select(F.col("node").alias("up"), F.col("up").alias("above"))
                up = up.join(above, "up").select("node", F.col("above").alias("up"))
            steps.append(saved(up, f"{label}-step"))
            names = [steps[-1].select(F.col("node").alias(x), F.col("up").alias(f"{x}_up")) for x in ("a", "b")]
            ends = left.join(names[0], "a").join(names[1], "b").where("a_up != b_up")
            left = saved(ends.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), f"{label}-edges")
        if not steps:
            return spark.createDataFrame([], "node long, label long")
        labels = steps[0].select("node", F.col("up").alias("label"))
        for step in steps[1:]:
            labels = labels.join(step.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        if len(steps) > 1:  # a drawn order names a component by any of its nodes
            labels = saved(labels, f"{label}-names")
            labels = labels.join(labels.groupBy("label").agg(F.min("node").alias("smallest")), "label").select("node", F.col("smallest").alias("label"))
        found = saved(labels, f"{label}-labels")
        tables.keep_last()
        return found
