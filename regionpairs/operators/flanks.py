"""Flanks: windows beside regions, clipped at the set's neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionpairs.operators.pairs import within_sets

WIDTH = 2500
CLASSES = ("LL", "RR", "LR", "RL")
#: Positions per bucket in which neighbours are looked for.
BUCKET = 1_000_000


def build(regions: DataFrame, width: int = WIDTH, lengths: DataFrame | None = None, bucket: int = BUCKET) -> DataFrame:
    """set_id, region_id, chrom, side, start, stop, clipped: LEFT up to the furthest end of earlier regions of the set, RIGHT up to the next region's start.

    Empty flanks give no row. lengths (chrom, total) clips at chromosome ends where given. Neighbours are looked for among
    the regions that start in one bucket of positions, then one row per bucket carries the furthest end and the first start
    on to the others; so no task holds a large set's chromosome, and a set within one bucket costs one window.
    """
    group = ["set_id", "chrom", "_bucket"]
    w = Window.partitionBy(*group).orderBy("start", "stop", "region_id")
    own = regions.select("set_id", "region_id", "chrom", "start", "stop", F.expr(f"start div {bucket}").alias("_bucket"))
    near = own.select("*", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.lead("start").over(w).alias("_after"))
    v = Window.partitionBy("_set", "_chrom").orderBy("_at")
    ends = own.groupBy(*(F.col(c).alias(d) for c, d in zip(group, ("_set", "_chrom", "_at")))).agg(F.max("stop").alias("_stop"), F.min("start").alias("_start"))
    ends = ends.select("_set", "_chrom", "_at", F.max("_stop").over(v.rowsBetween(Window.unboundedPreceding, -1)).alias("_far"), F.lead("_start").over(v).alias("_next"))
    met = F.col("set_id").eqNullSafe(F.col("_set")) & F.col("chrom").eqNullSafe(F.col("_chrom")) & F.col("_bucket").eqNullSafe(F.col("_at"))
    near = near.join(ends, met).select("set_id", "region_id", "chrom", "start", "stop", F.greatest("_before", "_far").alias("before"), F.coalesce("_after", "_next").alias("after"))
    if lengths is not None:
        near = near.join(lengths, "chrom", "left").withColumn("after", F.least("after", "total"))
    left = F.struct(F.lit("LEFT").alias("side"), F.greatest(F.lit(0), F.col("start") - width, F.coalesce("before", F.lit(0))).alias("start"), F.col("start").alias("stop"))
    right = F.struct(F.lit("RIGHT").alias("side"), F.col("stop").alias("start"), F.least(F.col("stop") + width, F.coalesce("after", F.col("stop") + width)).alias("stop"))
    wide = near.select("set_id", "region_id", "chrom", F.explode(F.array(left, right)).alias("f"))
    return wide.select("set_id", "region_id", "chrom", "f.side", "f.start", "f.stop", (F.col("f.stop") - F.col("f.start") < width).alias("clipped")).where("start < stop")


def _sides(flanks: DataFrame, p: str) -> DataFrame:
    """One row per region: its chromosome and its flanks as structs L and R, null where it has none."""
    at = F.struct("start", "stop", "clipped")
    side = lambda name: F.max(F.when(F.col("side") == name, at)).alias(f"{p}_{name[0]}")
    return flanks.groupBy("set_id", F.col("region_id").alias(f"{p}_region_id")).agg(F.max("chrom").alias(f"{p}_chrom"), side("LEFT"), side("RIGHT"))


def _dropped() -> Column:
    """Facing flanks (a's right, b's left) that overlap while neither is clipped."""
    met = (F.col("a_chrom") == F.col("b_chrom")) & (F.col("a_R.start") < F.col("b_L.stop")) & (F.col("b_L.start") < F.col("a_R.stop"))
    return F.coalesce(met & ~F.col("a_R.clipped") & ~F.col("b_L.clipped"), F.lit(False))


def _comparable(x: str, y: str, min_length: int) -> Column:
    """Whether a's flank x and b's flank y are compared (see by_class); null where one of them is missing."""
    f, g = F.col(f"a_{x}"), F.col(f"b_{y}")
    long = (f["stop"] - f["start"] >= min_length) & (g["stop"] - g["start"] >= min_length)
    apart = (F.col("a_chrom") != F.col("b_chrom")) | (f["stop"] <= g["start"]) | (g["stop"] <= f["start"])
    return long & apart if (x, y) == ("L", "R") else long & apart & ~F.col("dropped")


def facing_dropped(pairs: DataFrame, flanks: DataFrame) -> DataFrame:
    """pairs (set_id, a_region_id, b_region_id, a the one before) with facing_dropped: whether their facing flanks overlap while neither is clipped, so that both are dropped for the pair.

    A region between the two clips one of them, so nothing is dropped then.
    """
    met = pairs.join(_sides(flanks, "a"), ["set_id", "a_region_id"], "left").join(_sides(flanks, "b"), ["set_id", "b_region_id"], "left")
    return met.select(*pairs.columns, _dropped().alias("facing_dropped"))


def by_class(pairs: DataFrame, flanks: DataFrame, min_length: int = 10) -> DataFrame:
    """Comparable flanks of pairs (set_id, a_region_id, b_region_id): class LL, RR, LR or RL, a's side first.

    Flanks shorter than min_length, comparisons of overlapping intervals (a flank with itself) and facing flanks that are
    dropped for their pair (see facing_dropped) are left out. A pair meets each region's flanks as one row.
    """
    both = pairs.select("set_id", "a_region_id", "b_region_id").join(_sides(flanks, "a"), ["set_id", "a_region_id"]).join(_sides(flanks, "b"), ["set_id", "b_region_id"])

    def one(x, y):
        f, g = F.col(f"a_{x}"), F.col(f"b_{y}")
        return F.when(_comparable(x, y, min_length), F.struct(F.lit(x + y).alias("cls"), f["start"].alias("a_from"), f["stop"].alias("a_to"), g["start"].alias("b_from"), g["stop"].alias("b_to")))

    every = F.array_compact(F.array(*(one(x, y) for x, y in CLASSES)))
    return both.withColumn("dropped", _dropped()).select("set_id", "a_region_id", "b_region_id", "a_chrom", "b_chrom", F.explode(every).alias("f")).select("set_id", "a_region_id", "b_region_id", "a_chrom", "b_chrom", "f.*")


def breakdown(comparisons: DataFrame, key: list[str]) -> DataFrame:
    """Counts per class; double: LL and RR, or LR and RL; single: something but not double."""
    n = comparisons.groupBy(*key).agg(*(F.count_if(F.col("cls") == c).alias(c) for c in CLASSES))
    double = ((F.col("LL") > 0) & (F.col("RR") > 0)) | ((F.col("LR") > 0) & (F.col("RL") > 0))
    return n.withColumn("double", double).withColumn("single", ~double)


def pair_classes(regions: DataFrame, flanks: DataFrame, order: list[str], min_length: int = 10) -> DataFrame:
    """set_id, a_region_id, b_region_id, LL, RR, LR, RL: every pair of a set's regions on one chromosome, the smaller by `order` first, with whether by_class compares these flanks.

    Flanks meet their regions before these are paired, so no table of pairs is joined or shuffled.
    """
    own = regions.join(_sides(flanks, "x").withColumnRenamed("x_region_id", "region_id"), ["set_id", "region_id"])
    own = own.select("set_id", *order, F.struct("set_id", "chrom").alias("key"), F.struct("x_chrom", "x_L", "x_R").alias("fl"))
    two = within_sets(own, order, ["region_id", "fl"], by="key")
    two = two.select(F.col("key.set_id").alias("set_id"), "a_region_id", "b_region_id", *(F.col(f"{p}_fl.x_{c}").alias(f"{p}_{c}") for p in "ab" for c in ("chrom", "L", "R")))
    return two.withColumn("dropped", _dropped()).select("set_id", "a_region_id", "b_region_id", *(F.coalesce(_comparable(*c, min_length), F.lit(False)).alias(c) for c in CLASSES))


def pair_breakdown(classes: DataFrame) -> DataFrame:
    """As breakdown by pair, of pair_classes: one row and one sum a pair, pairs without a comparison left out."""
    n = classes.where("LL or RR or LR or RL").groupBy("set_id", "a_region_id", "b_region_id").agg(*(F.count_if(c).alias(c) for c in CLASSES))
    double = ((F.col("LL") > 0) & (F.col("RR") > 0)) | ((F.col("LR") > 0) & (F.col("RL") > 0))
    return n.withColumn("double", double).withColumn("single", ~double)


def chunks(sequences: DataFrame, key: list[str], size: int = 64) -> DataFrame:
    """A sequence table as (key, chunk, part), each sequence cut in one walk from its start to its end. One without letters has one empty chunk, a null one a null chunk."""
    parts = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return sequences.select(*key, F.posexplode(F.when(F.length("seq") > 0, parts).otherwise(F.array("seq"))).alias("chunk", "part"))


def extract(intervals: DataFrame, parts: DataFrame, key: list[str], ident: list[str], size: int = 64) -> DataFrame:
    """The sequence under each interval (ident, key, start, stop), from chunks: an equi-join on the chunk numbers it spans."""
    wide = intervals.where("start < stop").select(*dict.fromkeys([*ident, *key]), "start", "stop", F.explode(F.expr(f"sequence(start div {size}, (stop - 1) div {size})")).alias("chunk"))
    met = wide.withColumn("chunk", F.col("chunk").cast("int")).join(parts, [*key, "chunk"])
    at = F.expr(f"greatest(start - chunk * {size}, 0)")
    till = F.expr(f"least(stop - chunk * {size}, {size})")
    piece = F.col("part").substr((at + 1).cast("int"), (till - at).cast("int"))
    return met.groupBy(*ident, "start", "stop").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("p")))), lambda x: x["p"]), "").alias("seq"))


def hits(regions: DataFrame, letters: DataFrame, pairs: DataFrame, width: int, min_score: int | None = None, max_e: float | None = None, k: int = 10, masked: bool = False) -> DataFrame:
    """set_id, a_region_id, b_region_id, cls of every comparison of a pair with a segment of min_score or more, or of an e-value of at most max_e: LL, RR, LR, RL of its flanks, B of the bodies.

    letters: chrom, seq. Each flank and body is cut from the chromosome's chunks once, written once, masked if asked for
    (low complexity gives no seeds) and searched once within its set; the hits of what no comparison asks for are left out.
    """
    from regionpairs.operators import similarity
    from regionpairs.plans.shared import through_table

    around = build(regions, width)
    code = lambda letter: F.when(letter == "L", 1).otherwise(2)
    asked = by_class(pairs, around).select("set_id", "a_region_id", "b_region_id", "cls", (F.col("a_region_id") * 4 + code(F.substring("cls", 1, 1))).alias("a"), (F.col("b_region_id") * 4 + code(F.substring("cls", 2, 1))).alias("b"))
    bodies = pairs.select("set_id", "a_region_id", "b_region_id", F.lit("B").alias("cls"), (F.col("a_region_id") * 4).alias("a"), (F.col("b_region_id") * 4).alias("b"))
    asked = through_table(asked.unionByName(bodies), "asked")
    spans = around.select("set_id", "chrom", "start", "stop", (F.col("region_id") * 4 + code(F.substring("side", 1, 1))).alias("member")).unionByName(regions.select("set_id", "chrom", "start", "stop", (F.col("region_id") * 4).alias("member")))
    seqs = through_table(extract(spans, chunks(letters, ["chrom"]), ["chrom"], ["set_id", "member"]).select("set_id", "member", "seq"), "members")
    if masked:
        diagonals = similarity.seeds(similarity.masked(seqs), k, asked=asked.select("set_id", "a", "b"))
        found = similarity.with_e_values(similarity.segments(diagonals, seqs), max_e)
    else:
        found = similarity.search(seqs, k, max_e)
    if min_score is not None:
        found = found.where(F.col("score") >= min_score)
    return asked.join(found.select("set_id", "a", "b").distinct(), ["set_id", "a", "b"]).select("set_id", "a_region_id", "b_region_id", "cls")


def hit_breakdown(found: DataFrame) -> DataFrame:
    """Per pair with a hit: whether LL, RR, LR, RL and the bodies have one, double (LL and RR, or LR and RL), single (another flank hit), both (a body hit and a double one)."""
    has = lambda c: (F.count_if(F.col("cls") == c) > 0)
    n = found.groupBy("set_id", "a_region_id", "b_region_id").agg(*(has(c).alias(c) for c in ("LL", "RR", "LR", "RL")), has("B").alias("body"))
    double = (F.col("LL") & F.col("RR")) | (F.col("LR") & F.col("RL"))
    return n.withColumn("double", double).withColumn("single", ~double & (F.col("LL") | F.col("RR") | F.col("LR") | F.col("RL"))).withColumn("both", F.col("body") & F.col("double"))
