"""Checks on alignment blocks: rescoring and column metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionpairs import schemas
from regionpairs.functions import columns as C


def matrix(spark) -> DataFrame:
    """x, y, s for all 16 pairs: a table of fixed size, so it is broadcast."""
    rows = {(x, y): s for x, y, s in schemas.MATRIX} | {(y, x): s for x, y, s in schemas.MATRIX}
    return spark.createDataFrame([(x, y, s) for (x, y), s in sorted(rows.items())], "x string, y string, s int")


def metrics(blocks: DataFrame, key: list[str]) -> DataFrame:
    """From aligned texts t and q (`-` for gaps): score, matches, columns without a gap, all columns, gap runs. Two empty texts have no row.

    Columns are exploded and joined with the score table; a gap run starts where the column before has no gap in that text.
    """
    cols = blocks.select(*key, F.posexplode(F.arrays_zip(F.split(F.upper("t"), "").alias("x"), F.split(F.upper("q"), "").alias("y"))).alias("i", "c"), F.col("t").alias("_t"), F.col("q").alias("_q"))
    cols = cols.where("c.x <> '' or c.y <> ''")
    before = lambda c: F.when(F.col("i") > 0, F.expr(f"substring(`{c}`, i, 1)")).otherwise("")
    cols = cols.select(*key, F.col("c.x").alias("x"), F.col("c.y").alias("y"), before("_t").alias("px"), before("_q").alias("py"))
    scored = cols.join(F.broadcast(matrix(blocks.sparkSession)), ["x", "y"], "left")
    gap = (F.col("x") == "-") | (F.col("y") == "-")
    opens = ((F.col("x") == "-") & (F.col("px") != "-")).cast("int") + ((F.col("y") == "-") & (F.col("py") != "-")).cast("int")
    got = scored.groupBy(*key).agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("subst"), F.sum(((F.col("x") == F.col("y")) & ~gap).cast("int")).alias("matches"), F.sum((~gap).cast("int")).alias("aligned"), F.count("*").alias("columns"), F.sum(opens).alias("gap_runs"), F.sum(gap.cast("int")).alias("gap_columns")
    )
    return got.withColumn("score", F.col("subst") - schemas.GAP_OPEN * F.col("gap_runs") - schemas.GAP_EXTEND * F.col("gap_columns")).drop("subst")


def ratios(df: DataFrame, t_size: str, q_size: str) -> DataFrame:
    """identity (matches of columns without a gap), coverage (columns without a gap of the shorter side's letters) and continuity (columns without a gap of all) from metrics' columns; null by zero."""
    over = lambda a, b: F.try_divide(a.cast("double"), b)
    aligned = F.col("aligned")
    return df.withColumns({"identity": over(F.col("matches"), aligned), "coverage": over(aligned, F.least(t_size, q_size)), "continuity": over(aligned, F.col("columns"))})


def script_totals(df: DataFrame, script: str) -> DataFrame:
    """Letters per operation of an edit script."""
    ops = C.edit_script(F.col(script))
    total = lambda op: F.aggregate(F.filter(ops, lambda o: o["op"] == op), F.lit(0), lambda z, o: z + o["len"])
    return df.withColumns({"m": total("m"), "i": total("i"), "d": total("d")})


def on_plus(df: DataFrame) -> DataFrame:
    """Start on the plus strand of a side given with start, size, strand, total."""
    return df.withColumn("plus_start", F.when(F.col("strand") == "-", C.other_strand(F.col("start"), F.col("size"), F.col("total"))).otherwise(F.col("start")))
