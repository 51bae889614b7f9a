"""Connected components by minimum labels with pointer jumping.

Every step joins and aggregates by key with partial aggregation, and its result
is a written table; nothing is collected but one count of changed labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of edges (a, b); component is its smallest id.

    First each node keeps one edge, to its smallest neighbour, and only that forest
    goes through the rounds.  Of the other edges those are left that join two of its
    trees, once per pair of trees."""
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # written once: all that follows must come from one evaluation of the edges
    ends = written(ends.filter("a <> b").distinct(), "links")
    ids = ends.select(F.col("a").alias("id")).union(ends.select("b")).distinct()
    trees = ids.join(_rounds(ends.groupBy("b").agg(F.min("a").alias("a"))), "id", "left")
    trees = written(trees.select("id", F.coalesce("component", "id").alias("component")), "trees")
    named = trees.withColumnRenamed("component", "c")
    over = ends.join(named.withColumnRenamed("id", "a"), "a").select("b", F.col("c").alias("x")).join(named.withColumnRenamed("id", "b"), "b")
    over = written(over.filter("x <> c").select(F.least("x", "c").alias("a"), F.greatest("x", "c").alias("b")).distinct(), "links")
    if not over.limit(1).count():
        return trees
    joined = _rounds(over).toDF("component", "whole")
    return trees.join(joined, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))


def _rounds(edges: DataFrame) -> DataFrame:
    """components of distinct edges (a, b) by rounds over all of them."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "edges")
    table = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("c")), "labels")
    labels = table
    while True:
        near = (both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("c").alias("m"))
                .withColumnRenamed("a", "id"))
        hooked = labels.join(near, "id").select("id", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        up = labels.select(F.col("id").alias("c"), F.col("c").alias("above"))
        nxt = written(hooked.join(up, "c", "left").select("id", "old", F.least("c", F.coalesce("above", "c")).alias("c")), "labels")
        changed = nxt.filter("old <> c").limit(1).count()
        discard(table)  # the round before
        table, labels = nxt, nxt.select("id", "c")
        if not changed:
            discard(both)
            return labels.withColumnRenamed("c", "component")
