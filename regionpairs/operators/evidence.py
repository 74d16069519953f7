"""Evidence per set-size bin: hits, components, extra copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionpairs.operators.regions import set_sizes


def hits_per_bin(regions: DataFrame, hit_regions: DataFrame) -> DataFrame:
    """Per size bin: distinct coordinates, those in a hit, their share. hit_regions: set_id, chrom, start, stop; each coordinate counts once per bin."""
    at = ["chrom", "start", "stop"]
    hit = hit_regions.select("set_id", *at).distinct().withColumn("hit", F.lit(True))
    all_ = regions.join(set_sizes(regions).select("set_id", "bin"), "set_id").join(hit, ["set_id", *at], "left")
    once = all_.groupBy("bin", *at).agg(F.max(F.coalesce("hit", F.lit(False))).alias("hit"))
    return once.groupBy("bin").agg(F.count("*").alias("regions"), F.count_if("hit").alias("hit_regions")).withColumn("share", F.col("hit_regions") / F.col("regions"))


def components(links: DataFrame) -> DataFrame:
    """set_id, member, component (its smallest member) of members with a link (set_id, a, b), by large-star and small-star rounds.

    Each round links members to the smallest one of their neighbourhood, so that paths shrink by halves whatever the order
    of their members. It is checkpointed to the shared folder (spark.checkpoint.dir); rounds end when no link changes.
    """
    from regionpairs.plans.shared import through_table

    ends = through_table(links.select("set_id", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    now, alone = ends.where("u > v"), ends.where("u = v").select("set_id", F.col("u").alias("member"), F.col("u").alias("component"))
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select("set_id", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("set_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, ["set_id", "u"]).select("set_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("set_id", "u").agg(F.min("v").alias("m"))
        small = large.join(low, ["set_id", "u"]).select("set_id", F.col("v").alias("u"), F.col("m").alias("v"))
        now = through_table(small.unionByName(low.select("set_id", "u", F.col("m").alias("v"))).where("u > v").distinct(), "labels")
        last, state = state, _state(now)
        if state == last:
            break
    found = now.select("set_id", F.col("u").alias("member"), F.col("v").alias("component"))
    roots = now.select("set_id", F.col("v").alias("member"), F.col("v").alias("component")).distinct()
    return found.unionByName(roots).unionByName(alone.join(ends.where("u > v").select("set_id", F.explode(F.array("u", "v")).alias("member")), ["set_id", "member"], "left_anti"))


def _state(links: DataFrame) -> tuple:
    """Number of links and a sum of their hashes; a link set that a round leaves as it is consists of stars."""
    return tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("set_id", "u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def extra_copies(labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members beyond the first of each component, by size bin."""
    per = labels.groupBy("set_id", "component").agg((F.count("*") - 1).alias("extra"))
    return per.join(sizes.select("set_id", "bin"), "set_id").groupBy("bin").agg(F.count("*").alias("components"), F.sum("extra").alias("extra_copies"))
