"""Connected components of a link table, by joins and minimums only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cartlight.llm.scratch import Scratch


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable.

    Alternating large-star and small-star steps: each node's neighbours are hung on the smallest of them. The
    minimum is combined in the map tasks, written and joined back, so that adaptive execution splits a hot node's neighbours.
    Self links give a component of their own; null ends are ignored. Empty input gives an empty table.
    """
    edges = scratch.keep(
        links.filter("a is not null and b is not null")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    alone = edges.filter("u = v")
    now, mark = edges, None
    while True:
        both = now.filter("u <> v")
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        low = scratch.keep(low, "low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = scratch.keep(large, "large")
        least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("low")), "least")
        joined = large.join(least, "u")
        small = joined.select(
            F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v")
        ).unionByName(least.select("u", F.col("low").alias("v"))).filter("u <> v").distinct()
        after = scratch.keep(small, "star")
        found = after.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))
        ).first()
        scratch.drop(low, large, least, now if now is not edges else None)
        now = after
        if tuple(found) == mark:
            break
        mark = tuple(found)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("component").alias("node"), "component")
    single = alone.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return scratch.keep(
        stars.unionByName(roots).unionByName(single).groupBy("node").agg(F.min("component").alias("component")),
        "components",
    )
