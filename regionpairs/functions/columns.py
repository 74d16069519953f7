"""Row expressions: coordinates, labels, strands, ratios, edit scripts, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Match and mismatch score of the local search, its scale and K for e-values.
MATCH, MISMATCH, LAMBDA, K = 2, -3, 0.63373, 0.41
COORD = r"([^:\s_>]+)[:_](\d+)-(\d+)"


def coordinates(text: Column) -> Column:
    """chrom, start, stop of `chrom:start-stop` or `chrom_start-stop`; nulls where it doesn't parse."""
    part = lambda k: F.regexp_extract(text, COORD, k)
    return F.struct(F.nullif(part(1), F.lit("")).alias("chrom"), part(2).try_cast("bigint").alias("start"), part(3).try_cast("bigint").alias("stop"))


def region_name(chrom: Column, start: Column, stop: Column, sep: str = ":") -> Column:
    return F.concat(chrom, F.lit(sep), start.cast("string"), F.lit("-"), stop.cast("string"))


def attributes(header: Column) -> Column:
    """The key=value tokens after a header's id."""
    return F.str_to_map(F.regexp_replace(header, r"^\S+\s*", ""), F.lit(" "), F.lit("="))


def gene_of(label: Column) -> Column:
    return F.split(label, "_", 2)[0]


def group_of(label: Column) -> Column:
    return F.get(F.split(label, "_", 2), F.lit(1))


def legacy_label(first: Column, second: Column) -> Column:
    """First file name without its last four characters, then the second: the comparison label of old result folders."""
    return F.concat(first.substr(F.lit(1), F.length(first) - 4), F.lit("_"), second)


def parent_folder(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def other_strand(start: Column, size: Column, total: Column) -> Column:
    return total - start - size


def local_offset(pos: Column, region_start: Column) -> Column:
    """Chromosome position to position within a region."""
    return pos - region_start


def genomic(start: Column, size: Column, strand: Column, region_start: Column, region_size: Column) -> Column:
    """Chromosome start of an alignment side that is given on its own strand within a region."""
    return region_start + F.when(strand == "-", other_strand(start, size, region_size)).otherwise(start)


def gap(start_a: Column, stop_a: Column, start_b: Column, stop_b: Column) -> Column:
    return F.greatest(F.greatest(start_a, start_b) - F.least(stop_a, stop_b), F.lit(0))


def overlap(start_a: Column, stop_a: Column, start_b: Column, stop_b: Column) -> Column:
    return F.greatest(F.least(stop_a, stop_b) - F.greatest(start_a, start_b), F.lit(0))


def ratio(text: Column) -> Column:
    """n, d and n / d of `n/d (p%)`."""
    n, d = (F.regexp_extract(text, r"(\d+)/(\d+)", k).try_cast("int") for k in (1, 2))
    return F.struct(n.alias("n"), d.alias("d"), F.try_divide(n, d).alias("value"))


def edit_script(text: Column) -> Column:
    """Array of len, op from `23m1d13m`."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+[a-zA-Z])"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, r"\d+", 0).cast("int").alias("len"), F.regexp_extract(x, r"[a-zA-Z]", 0).alias("op")))


def e_value(score: Column, m: Column, n: Column, scale: Column | None = None) -> Column:
    """Karlin-Altschul expectation of an ungapped segment score, without length adjustment; scale: lambda, else that of uniform bases."""
    return F.lit(K) * m * n * F.exp(-(F.lit(LAMBDA) if scale is None else scale) * score)


def karlin_lambda(match: Column, steps: int = 60) -> Column:
    """The scale of scores: the positive root of match e^(2x) + (1 - match) e^(-3x) = 1, where match is the probability that two random letters are equal.

    By bisection within the row, between 0 and where the first term alone is 1. Null where the expected score isn't
    negative (match of 0.6 or more) or match isn't positive: there is no root.
    """
    over = lambda x: match * F.exp(MATCH * x) + (1 - match) * F.exp(MISMATCH * x) > 1
    mid = lambda z: (z["lo"] + z["hi"]) / 2
    start = F.struct(F.lit(0.0).alias("lo"), (-F.ln(match) / MATCH).alias("hi"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda z, _: F.when(over(mid(z)), F.struct(z["lo"].alias("lo"), mid(z).alias("hi"))).otherwise(F.struct(mid(z).alias("lo"), z["hi"].alias("hi"))))
    return F.when((match > 0) & (match * MATCH + (1 - match) * MISMATCH < -1e-12), mid(end))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - unit-cost global alignment distance / longer length; 1 for two empty strings."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / most)


def size_bin(n: Column) -> Column:
    return F.when(n >= 5, "5+").otherwise(n.cast("string"))
