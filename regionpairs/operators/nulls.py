"""Null controls: reproducible samples and shifts, and what observed scores look like against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionpairs.operators import intervals
from regionpairs.plans.shared import through_table

#: Parts that a group's range of scores is cut into at a time.
PARTS = 1024
#: Hexadecimal digits of a hash that part a group into buckets, 4096 of them.
DIGITS = 3

def key_of(ident: Column, seed: int, rep: Column) -> Column:
    """A hash that orders rows the same way on every run and cluster."""
    return F.md5(F.concat_ws("|", ident.cast("string"), F.lit(str(seed)), rep.cast("string")))


def sample(df: DataFrame, ident: str, strata: list[str], n: int, replicates: int, seed: int = 1) -> DataFrame:
    """n rows per stratum and replicate, those with the smallest hash; each task keeps its own n smallest before any shuffle."""
    wide = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    wide = wide.withColumn("_h", key_of(F.col(ident), seed, F.col("rep")))
    w = Window.partitionBy(*strata, "rep").orderBy("_h", ident)
    return wide.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("_h")


def shift(df: DataFrame, ident: str, total: int, seed: int = 1) -> DataFrame:
    """Intervals moved to a hashed start on a chromosome of `total` bases, length kept."""
    h = F.conv(F.substring(key_of(F.col(ident), seed, F.lit(0)), 1, 8), 16, 10).cast("bigint")
    size = F.col("stop") - F.col("start")
    return df.withColumn("_s", h % (F.lit(total) - size)).withColumn("stop", F.col("_s") + size).withColumn("start", F.col("_s")).drop("_s")


def _spread(df: DataFrame, by: list[str], hash_: str, ident: list, value: Column, out: str) -> DataFrame:
    """Sum of value over the earlier rows of a group in the order of their hash (text of hexadecimal digits): within buckets of hashes first, then over one row per bucket, so that no task holds a group."""
    order = [hash_, *ident]
    df = df.withColumn("_b", F.substring(hash_, 1, DIGITS)).withColumn("_v", value).withColumn("_g", F.struct(*by))
    inner = df.withColumn("_in", F.sum("_v").over(Window.partitionBy("_g", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    carry = df.groupBy("_g", "_b").agg(F.sum("_v").alias("_s")).select("_g", "_b", F.sum("_s").over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return inner.join(carry, ["_g", "_b"]).withColumn(out, zero("_in") + zero("_c")).drop("_b", "_v", "_g", "_in", "_c")


def permute(df: DataFrame, ident: str, lengths: DataFrame, replicates: int = 1, seed: int = 1) -> DataFrame:
    """Disjoint intervals (chrom, start, stop, ident) and the gaps between them in a new order along each chromosome, `replicates` times: rep, chrom, ident, start, stop.

    Intervals and gaps (up to the chromosome's end; lengths: chrom, total) are ordered by a hash and laid end to end, so
    lengths are kept, shifted intervals never overlap and all lie on the chromosome. A chromosome without a total ends with
    its last interval. Positions are two-level prefix sums.
    """
    whole = df.select("chrom", "start", "stop")
    before = intervals.running(whole, ["chrom"], "start", ["start", "stop"], F.col("stop"), F.max, "_prev")
    gaps = before.select("chrom", F.coalesce("_prev", F.lit(0)).alias("a"), F.col("start").alias("b"))
    last = whole.groupBy("chrom").agg(F.max("stop").alias("a")).join(lengths.select("chrom", F.col("total").alias("b")), "chrom")
    gaps = gaps.unionByName(last).where("b > a")
    parts = df.select("chrom", F.col(ident).cast("string").alias("_id"), F.col(ident).alias("_own"), (F.col("stop") - F.col("start")).alias("_n"))
    none = F.lit(None).cast(df.schema[ident].dataType)
    parts = parts.unionByName(gaps.select("chrom", F.concat(F.lit("gap"), F.col("a").cast("string")).alias("_id"), none.alias("_own"), (F.col("b") - F.col("a")).alias("_n")))
    parts = parts.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    parts = parts.withColumn("_h", key_of(F.concat_ws("|", "chrom", "_id"), seed, F.col("rep")))
    laid = _spread(parts, ["chrom", "rep"], "_h", ["_id"], F.col("_n"), "start")
    return laid.where("_own is not null").select("rep", "chrom", F.col("_own").alias(ident), "start", (F.col("start") + F.col("_n")).alias("stop"))


def matched_sets(members: DataFrame, pool: DataFrame, ident: str, strata: list[str], replicates: int = 1, seed: int = 1) -> DataFrame:
    """Random sets with the observed sizes and strata: for every replicate and member (set_id, strata, ident) one row of the pool (strata, ident), as rep, set_id, strata, ident.

    Members of a stratum are numbered by hash, and so are the pool's rows for each replicate; equal numbers meet, so within a
    stratum no row of the pool is drawn twice before all are once. Members of a stratum that the pool lacks have none.
    """
    rep = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")
    one = F.lit(1)
    slots = members.select("set_id", *strata, F.col(ident).alias("_member")).withColumn("_h", key_of(F.concat_ws("|", F.lit("slot"), F.col("set_id").cast("string"), F.col("_member").cast("string")), seed, F.lit(0)))
    slots = _spread(slots, strata, "_h", ["set_id", "_member"], one, "_slot").select("set_id", *strata, "_slot", rep)
    size = pool.groupBy(*strata).agg(F.count("*").alias("_size"))
    slots = slots.join(size, strata).withColumn("_k", F.col("_slot") % F.col("_size"))
    drawn = pool.select(*strata, F.col(ident), rep).withColumn("_h", key_of(F.col(ident), seed, F.col("rep")))
    drawn = _spread(drawn, [*strata, "rep"], "_h", [ident], one, "_k").select(*strata, "rep", "_k", ident)
    return slots.join(drawn, [*strata, "rep", "_k"]).select("rep", "set_id", *strata, "_slot", ident).withColumnRenamed("_slot", "slot")


def quantiles(df: DataFrame, by: list[str], score: str, at=(0.9, 0.95, 0.99)) -> DataFrame:
    """by, n and the exact quantiles of score (nulls aside) as an array q in the order of `at`, interpolated between neighbours; groups without a score have no row.

    Distributed selection: scores are counted per value; a group's range is cut into parts, only those parts that hold a
    wanted rank are cut again, and ranks are looked up among what is left of them. So no buffer holds a group's scores.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    counts = df.select(group.alias("_g"), F.col(score).cast("double").alias("_v")).where("_v is not null").groupBy("_g", "_v").agg(F.count("*").alias("_c"))
    counts = through_table(counts, "counts")
    size = counts.groupBy("_g").agg(F.sum("_c").alias("n"))
    asked = size.select("_g", "n", F.posexplode(F.array(*(F.lit(float(p)) for p in at))).alias("_k", "_p")).withColumn("_at", (F.col("n") - 1) * F.col("_p"))
    ranks = asked.select("_g", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_rank")).distinct()
    rows = counts.withColumns({"_cell": F.lit(0).cast("bigint"), "_base": F.lit(0).cast("bigint")})
    for _ in range(2):
        span = rows.groupBy("_g", "_cell").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        wide = F.col("_hi") - F.col("_lo")
        part = F.when(wide > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / wide * PARTS), F.lit(PARTS - 1))).otherwise(0)
        rows = rows.join(span, ["_g", "_cell"]).withColumn("_part", part).drop("_lo", "_hi")
        own = Window.partitionBy("_g", "_cell").orderBy("_part")
        held = rows.groupBy("_g", "_cell", "_base", "_part").agg(F.sum("_c").alias("_s"))
        held = held.withColumn("_from", F.col("_base") + F.sum("_s").over(own) - F.col("_s"))
        hit = held.join(ranks, "_g").where("_rank >= _from and _rank < _from + _s").select("_g", "_cell", "_part", "_from").distinct()
        rows = rows.drop("_base").join(hit, ["_g", "_cell", "_part"])
        rows = rows.select("_g", (F.col("_cell") * PARTS + F.col("_part")).alias("_cell"), F.col("_from").alias("_base"), "_v", "_c")
    upto = rows.withColumn("_to", F.col("_base") + F.sum("_c").over(Window.partitionBy("_g", "_cell").orderBy("_v")))
    found = upto.join(ranks, "_g").where("_rank >= _to - _c and _rank < _to").select("_g", "_rank", "_v")
    side = lambda f, name: found.select("_g", F.col("_rank").alias(f), F.col("_v").alias(name))
    both = asked.withColumns({"_f": F.floor("_at"), "_e": F.ceil("_at")}).join(side("_f", "_low"), ["_g", "_f"]).join(side("_e", "_high"), ["_g", "_e"])
    value = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.col("_f"))
    out = both.groupBy("_g", "n").agg(F.array_sort(F.collect_list(F.struct("_k", value.alias("q")))).alias("q"))
    return out.select(*(F.col(f"_g.{c}").alias(c) for c in by), "n", F.transform("q", lambda x: x["q"]).alias("q"))


def cutoffs(df: DataFrame, by: list[str], score: str, at=(0.9, 0.95, 0.99)) -> DataFrame:
    """Exact quantiles of null scores, a column each."""
    return quantiles(df, by, score, at).select(*by, "n", *(F.col("q")[k].alias(f"q{round(100 * x)}") for k, x in enumerate(at)))


def replicate_stats(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Number, mean, deviation and exact median of the scores of each group, nulls aside."""
    named = {c: f"_by_{c}" for c in by}
    stats = df.groupBy(*by).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev(score).alias("sd"))
    mid = quantiles(df, by, score, (0.5,)).select(*(F.col(c).alias(d) for c, d in named.items()), F.col("q")[0].alias("median"))
    same = F.lit(True)
    for c, d in named.items():
        same = same & F.col(c).eqNullSafe(F.col(d))
    return stats.join(mid, same, "left").select(*by, "n", "mean", "sd", "median")


def empirical_p(observed: DataFrame, null: DataFrame, by: list[str], score: str) -> DataFrame:
    """observed with (1 + nulls as high) / (1 + nulls) of its group.

    Nulls are counted per score first; the running count over distinct scores is taken in two levels, so no task needs a
    whole group's nulls.
    """
    step = 64
    counts = null.groupBy(*by, score).agg(F.count("*").alias("c")).withColumn("kind", F.lit(0))
    wanted = observed.select(*by, score).distinct().withColumn("c", F.lit(0).cast("bigint")).withColumn("kind", F.lit(1))
    both = counts.unionByName(wanted).withColumn("_bucket", F.floor(F.col(score) / step))
    inner = both.withColumn("_in", F.sum("c").over(Window.partitionBy(*by, "_bucket").orderBy(F.desc(score), "kind").rowsBetween(Window.unboundedPreceding, 0)))
    carry = both.groupBy(*by, "_bucket").agg(F.sum("c").alias("_c")).select(*by, "_bucket", F.sum("_c").over(Window.partitionBy(*by).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    high = inner.join(carry, [*by, "_bucket"]).where("kind = 1").select(*by, score, (F.col("_in") + F.coalesce("_carry", F.lit(0))).alias("as_high"))
    n = null.groupBy(*by).agg(F.count("*").alias("nulls"))
    out = observed.join(high, [*by, score]).join(n, by, "left").withColumn("nulls", F.coalesce("nulls", F.lit(0)))
    return out.withColumn("p", (1 + F.col("as_high")) / (1 + F.col("nulls")))


def against(observed: DataFrame, null: DataFrame, by: list[str]) -> DataFrame:
    """Observed and null summaries (by, n, mean, sd) of each group side by side, with the z score."""
    o, n = (df.select(*by, *(F.col(c).alias(f"{p}_{c}") for c in ("n", "mean", "sd"))) for df, p in ((observed, "obs"), (null, "null")))
    return o.join(n, by, "left").withColumn("z", F.try_divide(F.col("obs_mean") - F.col("null_mean"), F.col("null_sd")))


def permutation_test(counts: DataFrame, by: str, replicates: int) -> DataFrame:
    """by, observed, null_mean, null_sd, z and p = (1 + replicates as high) / (1 + replicates) from counts (by, rep, n), rep 0 being the observation; a group without a row in a replicate counts 0 there."""
    every = counts.select(by).distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    n = every.join(counts, [by, "rep"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    seen = n.where("rep = 0").select(by, F.col("n").alias("observed"))
    null = n.where("rep > 0").join(seen, by).groupBy(by, "observed").agg(F.avg("n").alias("null_mean"), F.stddev("n").alias("null_sd"), F.count_if(F.col("n") >= F.col("observed")).alias("as_high"))
    return null.select(by, "observed", "null_mean", "null_sd", F.try_divide(F.col("observed") - F.col("null_mean"), F.col("null_sd")).alias("z"), ((1 + F.col("as_high")) / (1 + replicates)).alias("p"))
