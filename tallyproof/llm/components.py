"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyproof.llm.common import checkpointed


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (a, b: long). Self-links and repeats may occur.

    Each step is grouped sums and joins on the node, cut by a checkpoint; the number of steps grows with the logarithm
    of a component's size. The driver sees counts and one checksum.
    """
    current = checkpointed(edges.selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct())
    before = None
    while (state := _state(current)) != before:
        before = state
        both = current.filter("u <> v").unionByName(current.filter("u <> v").selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("low", "u"))
        large = both.join(least, "u").filter("v > u").selectExpr("v as u", "low as v").distinct()
        # Each u of the large step points down only; its smallest neighbour takes the others.
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").selectExpr("case when v = low then u else v end as u", "low as v")
        current = checkpointed(small.unionByName(current.filter("u = v")).distinct())
    pairs = current.selectExpr("u as node", "v as component").unionByName(current.selectExpr("v as node", "v as component"))
    return pairs.groupBy("node").agg(F.min("component").alias("component"))
