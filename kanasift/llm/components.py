"""Connected components of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_written, join_by_key, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: each vertex hands its smallest neighbour (or itself) to its larger (or smaller) neighbours."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("__m"), F.count("*").alias("__n")).withColumn("__m", F.least("u", "__m"))
    total = edges.count()
    counts = least.select("u", "__n")
    out = join_by_key(edges, least.select("u", "__m"), "u", counts, total)
    if large:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("__m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("__m").alias("v")).unionByName(least.select("u", F.col("__m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u long, root long) for each vertex of edges (u long, v long): root is the smallest vertex reachable.

    Rounds end when nothing changes, after about log(longest chain) of them; each is a table in the shared
    folder. Self-links are dropped, repeated links count once, no links give no rows.
    """
    edges = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = sign(edges)
    for _ in range(most_rounds):
        if not now[0]:
            break
        before, old = now, edges
        grown = written(_star(edges, True), "links")
        edges = written(_star(grown, False), "links")
        now = sign(edges)
        drop_written(old)
        drop_written(grown)
        if now == before:
            break
    else:
        raise RuntimeError(f"links don't settle in {most_rounds} rounds")
    roots = edges.select("u", F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
