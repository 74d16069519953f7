"""Connected components as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import through_table


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node that has an edge, by large-star and small-star rounds.

    Each round links nodes to the smallest node of their neighbourhood, so paths shrink by halves. Self-links, repeated
    and reversed links count once; no links give an empty result.
    """
    now = through_table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("p"), F.col("m"), "u")
        new = small.select(F.col("p").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        now = through_table(new, "links")
        last, state = state, _state(now)
        if state == last:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def forest(parents: DataFrame) -> DataFrame:
    """node, component (its tree's smallest node) for (node, parent) rows with one parent per node and no cycles, by pointer jumping: each round halves the way to the root."""
    edge = through_table(parents.select("node", "parent"), "parents")
    if edge.isEmpty():
        return edge.select("node", F.col("parent").alias("component"))
    while True:
        up = edge.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        new = through_table(edge.join(up, "parent", "left").select("node", F.coalesce("_up", "parent").alias("parent"), F.col("_up").isNotNull().alias("_moved")), "parents")
        edge = new.drop("_moved")
        if new.where("_moved").isEmpty():
            break
    low = edge.groupBy("parent").agg(F.min("node").alias("m")).select("parent", F.least("parent", "m").alias("component"))
    return edge.join(low, "parent").select("node", "component").unionByName(low.select(F.col("parent").alias("node"), "component"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) after links (a, b) between their nodes or new ones: only the components that links touch are worked on."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    tops = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = through_table(components(tops), "tops")
    moved = labels.join(top.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return moved.unionByName(top.join(labels.select("node"), "node", "left_anti"))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
