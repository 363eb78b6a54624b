"""Connected components of a link table, entirely as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnspark.llm.tables import stored


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))
    ).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """Smallest member of each component: ``node``, ``root`` for every node with a link.

    ``links`` has two bigint columns ``a`` and ``b``; order, repeats and loops do not matter.
    Alternating star contraction: each round hooks the larger neighbours of every node to its
    smallest neighbour, then the smaller ones. Every edge table is at most as long as the links
    and every step is an aggregation with map-side combine followed by a join on a unique key,
    so hubs need no list of their neighbours. Each round's table is written to shared storage.
    """
    edges = stored(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    before = _signature(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        lowest = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        lowest = lowest.select("w", F.least("w", "m").alias("m"))
        large = (
            both.where("v > u").join(lowest, F.col("u") == F.col("w")).select(
                F.col("v").alias("a"), F.col("m").alias("b")
            )
        ).where("a <> b").distinct()
        small_min = large.groupBy(F.col("a").alias("w")).agg(F.min("b").alias("m"))
        hooked = large.join(small_min, F.col("a") == F.col("w"))
        small = hooked.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(
            small_min.select(F.col("w").alias("a"), F.col("m").alias("b"))
        )
        edges = stored(small.where("a <> b").distinct(), "links")
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select("b", "b").distinct().toDF("node", "root"))
