"""Connected components by alternating large-star and small-star, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of u to the smallest node among u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of u, and u itself, to the smallest of them (edges have u > v)."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).cast("string")).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (node, component): the smallest node reachable from each node that has an edge.

    Edges are undirected, of any type that has an order; nulls, loops and repeats are ignored; no edges give no rows. Every round
    is a table in the shared folder, so a lost executor costs one round at most, and is deleted once the next is there. Minima are
    pre-aggregated before each shuffle and a hub is a sort-merge join key that adaptive execution splits.
    """
    now = Stored(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(f"{src} is not null and {dst} is not null and u > v")
        .distinct(),
        "edges",
    )
    known = _summary(now.df)
    while known[0]:
        after = Stored(_small_star(_large_star(now.df).distinct()).distinct(), "edges")
        now.drop()
        before, known, now = known, _summary(after.df), after
        if before == known:
            break
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
