"""Connected components of a table of links, with the smallest node as name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.llm.shared import stored


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """One star step: links neighbours of each node to the smallest of them and the node."""
    if larger:
        near = pairs.union(pairs.select("b", "a"))
    else:
        near = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = near.join(least, "a")
    if larger:
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    to_all = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return to_all.where("a <> b").distinct()


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) with a > b that connect the same nodes by shorter ways: one step of each star."""
    return stored(_star(_star(links.where("a <> b").select("a", "b"), True), False), "links")


def least_neighbour(links: DataFrame) -> DataFrame:
    """(node, component): nodes with equal values are connected; connected ones may still differ."""
    both = links.select(F.col("a").alias("node"), "b").union(links.select("b", "b"))
    return both.groupBy("node").agg(F.min("b").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of the (a, b) links; component is its smallest node.

    Alternates the large-star and small-star steps, which keep every table about as long as
    the links, until nothing changes. Nulls and loops link nothing. A node with very many links
    is pre-aggregated (minimum) before the shuffle.
    """
    sign = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
    pairs = contracted(links)
    before = sign(pairs)
    while before[0]:
        pairs = contracted(pairs)
        now = sign(pairs)
        if now == before:
            break
        before = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select("b", "b").distinct())
