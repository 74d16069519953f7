"""Pairs of regions within a set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Items of a set that make a block; a task compares the items of two blocks at most.
BLOCK = 4096


def block_pairs(items: DataFrame, by: str, ident: list[str], block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """items for the first and for the second side of all pairs within sets, with the key columns _first and _second that both sides join on besides `by`.

    A set of more than `block` items is dealt out in blocks by a hash of ident: an item goes to each block of the other side,
    and every ordered pair of items meets under one key. Sets without such a size keep one key. Items without a set have no pairs.
    """
    n = items.groupBy(by).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    dealt = items.join(n, by).withColumn("_own", F.pmod(F.xxhash64(*ident), F.col("_n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    return dealt.withColumn("_second", every).withColumnRenamed("_own", "_first").drop("_n"), dealt.withColumn("_first", every).withColumnRenamed("_own", "_second").drop("_n")


def block_groups(items: DataFrame, by: str, ident: list[str], weight: Column, block: int = BLOCK, most: int = 1 << 20) -> DataFrame:
    """items with _low, _high, the blocks of their group, and _own, their block: a set's items once for every unordered pair of blocks that holds theirs.

    A set has one block for `block` items or a weight of `most` (an item weighs no more than that). Two items of a set meet in
    one group, that of their blocks; a group of two blocks pairs only items of different ones. Items without a set have no group.
    """
    parts = F.greatest(F.count("*") / block, F.sum(F.least(weight, F.lit(most))) / most, F.lit(1))
    n = items.groupBy(by).agg(F.ceil(parts).cast("int").alias("_n"))
    dealt = items.join(n, by).withColumn("_own", F.pmod(F.xxhash64(*ident), F.col("_n")).cast("int")).withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return dealt.withColumns({"_low": F.least("_own", "_x"), "_high": F.greatest("_own", "_x")}).drop("_n", "_x")


def within_sets(items: DataFrame, order: list[str], keep: list[str], by: str = "set_id", block: int = BLOCK) -> DataFrame:
    """Every unordered pair of a set once, as columns a_* and b_*, the smaller by `order` first. An equi-join on the set and its blocks; the comparison is its residual."""
    first, second = block_pairs(items, by, order, block)
    a = first.select(F.col(by), "_first", "_second", *(F.col(c).alias(f"a_{c}") for c in keep), F.struct(*order).alias("_a"))
    b = second.select(F.col(by), "_first", "_second", *(F.col(c).alias(f"b_{c}") for c in keep), F.struct(*order).alias("_b"))
    return a.join(b, [by, "_first", "_second"]).where(F.col("_a") < F.col("_b")).drop("_a", "_b", "_first", "_second")


def with_hits(pairs: DataFrame, hits: DataFrame, key: list[str]) -> DataFrame:
    """Pairs with their hits; a pair without any keeps one row of nulls."""
    return pairs.join(hits, key, "left")


def without_hits(pairs: DataFrame, hits: DataFrame, key: list[str]) -> DataFrame:
    return pairs.join(hits, key, "left_anti")


def with_both(pairs: DataFrame, hits: DataFrame, evidence: DataFrame, key: list[str]) -> DataFrame:
    """Pairs with a body hit and with the other evidence too."""
    return pairs.join(hits, key, "left_semi").join(evidence, key, "left_semi")
