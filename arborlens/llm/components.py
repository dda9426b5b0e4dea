"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.llm.common import cut, forget


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every endpoint of ``edges(a, b)``; component is the smallest node reachable.

    Alternates large-star and small-star steps, so the number of rounds grows with the logarithm of
    a component's diameter. Each step aggregates a minimum per node (combined map-side, so hubs don't
    meet in one task) and joins it back; adaptive execution splits a hub's rows in that join. Every
    round is written to the shared folder; nothing but a count and a checksum reaches the driver.

    Nulls, loops and repeated edges are ignored; no edges give no rows.
    """
    e = (
        edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .where(edges["a"].isNotNull() & edges["b"].isNotNull())
        .distinct()
    )
    e = cut(e)
    seen = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of u moves to the smallest neighbour of u.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        # Small star: u and its smaller neighbours move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        new = cut(small)
        forget(e)
        e = new
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (now["n"], now["s"]) == seen:
            break
        seen = (now["n"], now["s"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
