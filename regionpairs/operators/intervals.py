"""Interval joins by bins, merging and coverage. No step needs a whole chromosome in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionpairs.functions import columns as C

BIN = 1000
#: Positions per bucket of the two-level running aggregates.
BUCKET = 50_000


def overlaps(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """a's and b's rows (a_chrom, a_start, a_stop and b_*) that overlap: an equi-join on chromosome and bin; of the bins both span, the one with the later start counts."""
    bins = lambda df, p: df.where(f"{p}_start < {p}_stop").withColumn(f"_bin_{p}", F.explode(F.expr(f"sequence({p}_start div {width}, ({p}_stop - 1) div {width})")))
    met = bins(a, "a").join(bins(b, "b"), (F.col("a_chrom") == F.col("b_chrom")) & (F.col("_bin_a") == F.col("_bin_b")))
    return met.where(f"a_start < b_stop and b_start < a_stop and _bin_a = greatest(a_start, b_start) div {width}").drop("_bin_a", "_bin_b")


def prefixed(df: DataFrame, p: str, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{p}_{c}") for c in columns))


def straddles(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """Overlapping rows whose b crosses an edge of a, with how many edges."""
    met = overlaps(a, b, width)
    edge = lambda x: ((F.col("b_start") < F.col(x)) & (F.col("b_stop") > F.col(x))).cast("int")
    return met.withColumn("edges", edge("a_start") + edge("a_stop")).where("edges > 0")


def around(a: DataFrame, b: DataFrame, reach: int, width: int = BIN) -> DataFrame:
    """b rows that overlap a widened by reach on both sides but not a itself."""
    wide = a.withColumns({"in_start": F.col("a_start"), "in_stop": F.col("a_stop")}).withColumns({"a_start": F.greatest(F.col("a_start") - reach, F.lit(0)), "a_stop": F.col("a_stop") + reach})
    return overlaps(wide, b, width).where("b_stop <= in_start or b_start >= in_stop")


def levels(b: DataFrame, at: DataFrame, by: Sequence[str] = (), bucket: int = BUCKET) -> DataFrame:
    """For every position of at (chrom, pos) and group `by` that b has on its chromosome: starts (b rows that start before it), stops (those that stop at or before it), covered (bases of b rows before it, as often as they are covered).

    b's ends are counted per position and written once, then summed along the chromosome in two levels; so b's rows never
    meet those at a position, however many lie over it.
    """
    from regionpairs.plans.shared import through_table

    end = lambda c, s, t: F.struct(F.col(c).cast("bigint").alias("pos"), F.lit(s).alias("s"), F.lit(t).alias("t"))
    ends = b.where("b_start < b_stop").select(F.col("b_chrom").alias("chrom"), F.struct(F.lit(0).alias("_"), *by).alias("_by"), F.explode(F.array(end("b_start", 1, 0), end("b_stop", 0, 1))).alias("e"))
    ends = through_table(ends.where("chrom is not null").groupBy("chrom", "_by", "e.pos").agg(F.sum("e.s").alias("s"), F.sum("e.t").alias("t")), "ends")
    asked = at.select("chrom", "pos").distinct().join(ends.select("chrom", "_by").distinct(), "chrom").select("chrom", "_by", "pos", F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("t"), F.lit(True).alias("asked"))
    marks = ends.withColumn("asked", F.lit(False)).unionByName(asked).groupBy("chrom", "_by", "pos").agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.max("asked").alias("asked"))
    marks = marks.withColumns({"_s": F.col("s") * F.col("pos"), "_t": F.col("t") * F.col("pos"), "_bucket": F.expr(f"pos div {bucket}")})
    own = Window.partitionBy("chrom", "_by", "_bucket").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inner = marks.select("chrom", "_by", "pos", "_bucket", "asked", (F.sum("s").over(own) - F.col("s")).alias("s"), F.sum("t").over(own).alias("t"), (F.sum("_s").over(own) - F.col("_s")).alias("_s"), F.sum("_t").over(own).alias("_t")).where("asked")
    along = Window.partitionBy("chrom", "_by").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = marks.groupBy("chrom", "_by", "_bucket").agg(*(F.sum(c).alias(c) for c in ("s", "t", "_s", "_t"))).select("chrom", "_by", "_bucket", *(F.coalesce(F.sum(c).over(along), F.lit(0)).alias(f"c{c}") for c in ("s", "t", "_s", "_t")))
    met = inner.join(carry, ["chrom", "_by", "_bucket"])
    starts, stops = F.col("s") + F.col("cs"), F.col("t") + F.col("ct")
    covered = F.col("pos") * (starts - stops) - (F.col("_s") + F.col("c_s")) + (F.col("_t") + F.col("c_t"))
    return met.select("chrom", *(F.col(f"_by.{c}").alias(c) for c in by), "pos", starts.alias("starts"), stops.alias("stops"), covered.alias("covered"))


def _points(a: DataFrame, ident: list[str], *points) -> DataFrame:
    """ident, chrom, pos, s, t: a's rows at some positions, with the weights that starts and stops have there."""
    one = lambda pos, s, t: F.struct(pos.cast("bigint").alias("pos"), F.lit(s).alias("s"), F.lit(t).alias("t"))
    return a.where("a_start <= a_stop").select(*ident, F.col("a_chrom").alias("chrom"), F.explode(F.array(*(one(*p) for p in points))).alias("p")).select(*ident, "chrom", "p.pos", "p.s", "p.t")


def overlap_counts(a: DataFrame, b: DataFrame, ident: list[str], by: Sequence[str] = (), bucket: int = BUCKET) -> DataFrame:
    """ident (columns of a), by (columns of b), n, bases, edges: how many b rows overlap, on how many bases, and how many of a's edges they cross, where there are any.

    What overlaps is counted at a's ends (see levels), not paired: b rows that start before a's stop less those that stop at
    or before its start. There is a row for each of a's rows and each group on its chromosome, so groups should be few.
    """
    points = _points(a, ident, (F.col("a_start"), 0, -1), (F.col("a_stop"), 1, 0))
    met = points.join(levels(b, points, by, bucket), ["chrom", "pos"]).groupBy(*ident, *by)
    n = met.agg(
        F.sum(F.col("s") * F.col("starts") + F.col("t") * F.col("stops")).alias("n"), F.sum((F.col("s") + F.col("t")) * F.col("covered")).alias("bases"), F.sum(F.col("starts") - F.col("stops")).alias("edges")
    )
    return n.where("n > 0")


def around_counts(a: DataFrame, b: DataFrame, ident: list[str], reach: int, by: Sequence[str] = (), bucket: int = BUCKET) -> DataFrame:
    """ident, by, n: how many b rows around would pair with a's, counted as in overlap_counts: those that stop in the reach before a and those that start in the reach behind it."""
    low = F.greatest(F.col("a_start") - reach, F.lit(0))
    # before the chromosome's first position nothing lies
    up = F.when(F.col("a_start") >= low, 1).otherwise(0)
    points = _points(a, ident, (F.col("a_start"), 0, up), (low, 0, -up), (F.col("a_stop") + reach, 1, 0), (F.col("a_stop"), -1, 0))
    met = points.join(levels(b.where("b_stop > 0"), points, by, bucket), ["chrom", "pos"]).groupBy(*ident, *by)
    return met.agg(F.sum(F.col("s") * F.col("starts") + F.col("t") * F.col("stops")).alias("n")).where("n > 0")


def long_overlaps(a: DataFrame, b: DataFrame, ident: list[str], least: int, bucket: int = BUCKET) -> DataFrame:
    """ident of a's rows that overlap a b row on `least` bases or more: both shortened by one base less than that overlap at all."""
    short = lambda df, p: df.withColumn(f"{p}_stop", F.col(f"{p}_stop") - (least - 1)).where(f"{p}_start < {p}_stop")
    return overlap_counts(short(a, "a"), short(b, "b"), ident, bucket=bucket).select(*ident)


def within(a: DataFrame, b: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """chrom, n: pairs of which b starts before a and stops behind it.

    Two starts that differ part at their highest different bit: b's has 0 there and a's 1, and higher bits are equal. So for
    each bit b's rows with 0 and a's with 1 meet by their higher bits (a node), where only their stops are left to compare: by
    a running sum, in buckets and then over these. A row takes part at no node whose middle it can't lie on or near enough
    to, as a's shortest and b's longest row show; so it is in some log(length) nodes.
    """
    side = lambda df, p: df.select(F.col(f"{p}_chrom").alias("chrom"), F.col(f"{p}_start").cast("bigint").alias("start"), F.col(f"{p}_stop").cast("bigint").alias("stop")).where("chrom is not null").groupBy("chrom", "start", "stop").agg(F.count("*").alias("w"))
    small = side(a.where("a_start <= a_stop"), "a")
    least = a.where("a_start <= a_stop").agg(F.coalesce(F.min(F.col("a_stop") - F.col("a_start")), F.lit(0)).cast("bigint").alias("least"))
    most = b.where("b_start < b_stop").agg(F.coalesce(F.max(F.col("b_stop") - F.col("b_start")), F.lit(0)).cast("bigint").alias("most"), F.coalesce(F.min("b_start"), F.lit(0)).cast("bigint").alias("base"))
    size = F.broadcast(least.crossJoin(most))
    # positions from 0, both rows shortened by a's shortest
    moved = lambda df: df.crossJoin(size).withColumns({"start": F.col("start") - F.col("base"), "stop": F.col("stop") - F.col("base") - F.col("least")})
    node = lambda df: df.select("chrom", "k", F.expr("shiftright(start, k + 1)").alias("node"), F.col("stop").alias("at"), "v", "w")
    none = F.lit(0).cast("bigint")
    high = "cast(length(bin({})) as int) - 1"
    large = moved(side(b, "b")).where("start < stop - 1").withColumn("k", F.explode(F.expr(f"filter(sequence(0, {high.format('start ^ (stop - 1)')}), k -> shiftright(start, k) % 2 = 0)"))).withColumn("v", F.col("w")).withColumn("w", none)
    small = moved(small).where("start > 0").withColumn("k", F.explode(F.expr(f"filter(sequence(0, {high.format('start')}), k -> shiftright(start, k) % 2 = 1 and stop - shiftleft(shiftright(start, k), k) < most - least - 1)"))).withColumn("v", none)
    at = node(large).unionByName(node(small)).groupBy("chrom", "k", "node", "at").agg(F.sum("v").alias("v"), F.sum("w").alias("w"))
    key = ["chrom", "k", "node"]
    above = Window.partitionBy(*key, "_bucket").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("_bucket", F.expr(f"at div {bucket}"))
    held = at.withColumn("n", F.coalesce(F.sum("v").over(above), none) * F.col("w")).groupBy(*key, "_bucket").agg(*(F.sum(c).alias(c) for c in ("v", "w", "n")))
    higher = Window.partitionBy(*key).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumn("n", F.col("n") + F.coalesce(F.sum("v").over(higher), none) * F.col("w")).groupBy("chrom").agg(F.sum("n").alias("n"))


def edge_counts(a: DataFrame, b: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """chrom, edges (0, 1, 2), n: overlapping pairs by how many of a's edges b crosses. Counted, not paired: all pairs and crossed edges by levels, those that cross both by within."""
    points = _points(a, [], (F.col("a_start"), 0, -1), (F.col("a_stop"), 1, 0)).groupBy("chrom", "pos").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    met = points.join(levels(b, points, bucket=bucket), ["chrom", "pos"]).groupBy("chrom")
    n = met.agg(F.sum(F.col("s") * F.col("starts") + F.col("t") * F.col("stops")).alias("all"), F.sum((F.col("s") - F.col("t")) * (F.col("starts") - F.col("stops"))).alias("edges"))
    n = n.join(within(a, b, bucket).withColumnRenamed("n", "both"), "chrom", "left").withColumn("both", F.coalesce("both", F.lit(0)))
    one = lambda edges, n: F.struct(F.lit(edges).alias("edges"), n.alias("n"))
    cut = F.array(one(0, F.col("all") - F.col("edges") + F.col("both")), one(1, F.col("edges") - 2 * F.col("both")), one(2, F.col("both")))
    return n.select("chrom", F.explode(cut).alias("c")).select("chrom", "c.edges", "c.n").where("n > 0")


def running(df: DataFrame, by: list[str], pos: str, order: list, value: Column, agg, out: str, last: int = -1, bucket: int = BUCKET) -> DataFrame:
    """agg of value over all earlier rows of a group (last=0: this row too), in two levels: rows within a bucket of positions, then one row per bucket. agg: F.max, F.min or F.sum.

    A task holds the rows of one bucket, so it should be narrow where positions are dense."""
    joined = {F.max: F.greatest, F.min: F.least, F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}[agg]
    df = df.withColumn("_bucket", F.expr(f"`{pos}` div {bucket}")).withColumn("_value", value)
    inner = df.withColumn("_inner", agg("_value").over(Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)))
    carry = df.groupBy(*by, "_bucket").agg(agg("_value").alias("_v")).select(*by, "_bucket", agg("_v").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    return inner.join(carry, [*by, "_bucket"]).withColumn(out, joined(F.col("_inner"), F.col("_carry"))).drop("_bucket", "_value", "_inner", "_carry")


def nearest(a: DataFrame, b: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a with the nearest end of a b row at or before its start (up) and the nearest start at or after its stop (down), null where there is none.

    a's rows travel whole, so repeated ones keep their number.
    """
    at = a.select(F.struct(*(F.col(f"`{c}`") for c in a.columns)).alias("row"))
    none = F.lit(None).cast(at.schema["row"].dataType)
    ends = lambda pos: b.select("chrom", F.col(pos).alias("pos"), F.lit(0).alias("what"), none.alias("row"), F.lit(None).cast("bigint").alias("up"))
    up = ends("stop").unionByName(at.select("row.chrom", F.col("row.start").alias("pos"), F.lit(1).alias("what"), "row", F.lit(None).cast("bigint").alias("up")))
    up = running(up.drop("up"), ["chrom"], "pos", ["pos", "what"], F.when(F.col("what") == 0, F.col("pos")), F.max, "up", bucket=bucket).where("what = 1")
    # downwards: the same with positions mirrored
    down = ends("start").unionByName(up.select("chrom", F.col("row.stop").alias("pos"), "what", "row", "up")).withColumn("back", -F.col("pos"))
    down = running(down, ["chrom"], "back", ["back", "what"], F.when(F.col("what") == 0, F.col("pos")), F.min, "down", bucket=bucket).where("what = 1")
    return down.select("row.*", "up", "down")


def merge(df: DataFrame, by: list[str], bucket: int = BUCKET) -> DataFrame:
    """by, start, stop, n: maximal runs of overlapping or touching intervals."""
    df = df.where("start < stop").select(*by, "start", "stop")
    order = ["start", "stop"]
    reach = running(df, by, "start", order, F.col("stop"), F.max, "_reach", bucket=bucket)
    flagged = reach.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), 1).otherwise(0))
    # equal rows never start an island twice: the second one finds the first's reach
    island = running(flagged, by, "start", [*order, F.desc("_new")], F.col("_new"), F.sum, "_island", last=0, bucket=bucket)
    return island.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n")).drop("_island")


def covered(a: DataFrame, b: DataFrame, ident: list[str], width: int = BIN) -> DataFrame:
    """Bases of each a row under the union of b rows: overlaps of merged b are disjoint, so their lengths add up."""
    whole = merge(b.select(F.col("b_chrom").alias("chrom"), F.col("b_start").alias("start"), F.col("b_stop").alias("stop")), ["chrom"])
    met = overlaps(a, whole.select(F.col("chrom").alias("b_chrom"), F.col("start").alias("b_start"), F.col("stop").alias("b_stop")), width)
    n = met.groupBy(*ident).agg(F.sum(C.overlap(F.col("a_start"), F.col("a_stop"), F.col("b_start"), F.col("b_stop"))).alias("covered"))
    return a.join(n, ident, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def enrichment(counts: DataFrame) -> DataFrame:
    """From (cls, n11, n10, n01, n00): observed/expected, its log2, odds ratio and chi-square of the 2x2 table.

    By zero the first three are as in floating-point numbers: 0 / 0 is NaN, other counts / 0 infinite, log2 of 0 -infinite.
    """
    over = lambda a, b: F.when(b != 0, F.try_divide(a, b)).when(a == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    n = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    row, col = F.col("n11") + F.col("n10"), F.col("n11") + F.col("n01")
    expected = row * col / n
    det = F.col("n11").cast("double") * F.col("n00") - F.col("n10").cast("double") * F.col("n01")
    chi = F.try_divide(n * det * det, row.cast("double") * (n - row) * col * (n - col))
    return counts.withColumns({"ratio": over(F.col("n11"), expected), "odds": over(F.col("n11").cast("double") * F.col("n00"), F.col("n10").cast("double") * F.col("n01")), "chi2": chi}).withColumn("log2_ratio", F.when(F.col("ratio") == 0, F.lit(float("-inf"))).otherwise(F.log2("ratio")))
