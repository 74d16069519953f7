"""Regions and the sets that hold them. A region is (set_id, chrom, start, stop, region_id), 0-based and half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionpairs.functions import columns as C

AT = ("chrom", "start", "stop")


def parse_headers(df: DataFrame, header: str) -> DataFrame:
    """chrom, start, stop, label, gene, grp from `>chrom:start-stop label=... ` headers."""
    at, attrs = C.coordinates(F.col(header)), C.attributes(F.col(header))
    return df.withColumns({"chrom": at["chrom"], "start": at["start"], "stop": at["stop"], "label": attrs["label"]}).withColumns({"gene": C.gene_of(F.col("label")), "grp": C.group_of(F.col("label"))})


def set_sizes(regions: DataFrame) -> DataFrame:
    """Distinct coordinates per set and the set's size bin."""
    return regions.groupBy("set_id").agg(F.countDistinct(*AT).alias("n")).withColumn("bin", C.size_bin(F.col("n")))


def bin_counts(regions: DataFrame) -> DataFrame:
    return set_sizes(regions).groupBy("bin").agg(F.count("*").alias("sets"), F.sum("n").alias("memberships"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"))


def union_cohorts(observed: DataFrame, null: DataFrame) -> DataFrame:
    return observed.withColumn("cohort", F.lit("observed")).unionByName(null.withColumn("cohort", F.lit("null")), allowMissingColumns=True)


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*AT).intersect(b.select(*AT))


def only_first(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*AT).exceptAll(b.select(*AT))


def composition(df: DataFrame, seq: Column) -> DataFrame:
    """Length, GC count and soft-masked (lower-case) count of each sequence."""
    return df.withColumns({"length": F.length(seq), "gc": F.regexp_count(seq, F.lit("[GCgc]")), "masked": F.regexp_count(seq, F.lit("[acgt]"))})


def five_numbers(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Count, mean and exact quartiles per group that has a value; see nulls.quantiles."""
    from regionpairs.operators import nulls

    mean = df.groupBy(F.struct(*by).alias("_g")).agg(F.avg(x).alias("mean"))
    got = nulls.quantiles(df, by, x, (0.0, 0.25, 0.5, 0.75, 1.0)).withColumn("_g", F.struct(*by)).drop(*by)
    return got.join(mean, "_g").select(*(F.col(f"_g.{c}").alias(c) for c in by), "n", "mean", *(F.col("q")[k].alias(f"q{k}") for k in range(5)))
