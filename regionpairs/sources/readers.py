"""Readers of sequence trees, alignment reports, hit tables and BED files, all through Spark's own file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionpairs import schemas
from regionpairs.functions import columns as C
from regionpairs.operators.flanks import chunks


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path and whole content of matching files at any depth; hidden ones aside."""
    df = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return df.select(F.col("_metadata.file_path").alias("src_path"), F.col("_metadata.file_name").alias("_name"), "value").where(~F.col("_name").startswith("."))


def discover_sets(spark: SparkSession, root: str, glob: str = "*.fa") -> DataFrame:
    """set_id and path of each folder right below root that holds a matching file at any depth, from the files' names alone; Spark's readers see files only, so a folder without one isn't a set."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=glob).load(root).select("path")
    return files.where(~F.element_at(F.split("path", "/"), -1).startswith(".")).select(*_set_and_path("path", root)).distinct()


def _set_and_path(path: str, root: str):
    name = root.rstrip("/").split("/")[-1]
    below = F.regexp_replace(F.col(path), rf"^.*?/{name}/", "")
    set_id = F.split(below, "/")[0]
    return set_id.alias("set_id"), F.concat(F.regexp_extract(F.col(path), rf"^(.*?/{name}/)", 1), set_id).alias("path")


def read_sequences(spark: SparkSession, root: str, glob: str = "*.fa", cohort: str = "observed") -> DataFrame:
    """One row per record of the sequence files below root, in schemas.SEQUENCE; lower case is kept, it marks repeats.

    A header is `>chrom:start-stop key=value ...`; set_id is the label or set, else the folder. Coordinates that don't
    parse are null. Empty files give no row.
    """
    records = _files(spark, root, glob).select("src_path", F.explode(F.filter(F.split("value", "(?m)^>"), lambda x: F.length(F.trim(x)) > 0)).alias("r"))
    header = F.regexp_extract("r", r"^([^\r\n]*)", 1)
    attrs = C.attributes(header)
    at = C.coordinates(header)
    folder, _ = _set_and_path("src_path", root)
    label = F.coalesce(attrs["label"], attrs["set"], folder)
    return records.select(
        F.lit(cohort).alias("cohort"), label.alias("set_id"), C.gene_of(label).alias("gene"), C.group_of(label).alias("grp"),
        F.when(attrs["side"].isNotNull(), "flank").otherwise("body").alias("kind"), at["chrom"].alias("chrom"), at["start"].alias("start"), at["stop"].alias("stop"),
        F.coalesce(attrs["side"], attrs["role"]).alias("side"), attrs["pair"].alias("pair_label"), F.regexp_replace(F.regexp_replace("r", r"^[^\r\n]*", ""), r"\s", "").alias("seq"), "src_path",
    )


def read_genome(spark: SparkSession, path: str, size: int = 1 << 16) -> DataFrame:
    """chrom, chunk, part: large sequence files with a record per chromosome as a table of chunks, for flanks.extract; case is kept.

    Records, not files, are Spark's rows, so chromosomes of one file are dealt out to tasks. A record without letters has one empty chunk.
    """
    records = spark.read.text(path, lineSep=">", recursiveFileLookup=True).where(F.length(F.trim("value")) > 0)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
    return chunks(records.select(F.regexp_extract("value", r"^(\S+)", 1).alias("chrom"), seq.alias("seq")), ["chrom"], size)


def bad_records(df: DataFrame, by: str, needed: list[str]) -> DataFrame:
    """by, rows, bad: how many rows lack one of the needed values, such as coordinates that don't parse; nothing is dropped unseen."""
    bad = F.lit(False)
    for c in needed:
        bad = bad | F.col(c).isNull()
    return df.groupBy(by).agg(F.count("*").alias("rows"), F.count_if(bad).alias("bad"))


def read_alignments(spark: SparkSession, root: str, glob: str = "*.maf") -> tuple[DataFrame, DataFrame]:
    """(runs, blocks) of alignment reports: a run per file with its comment lines and their `key=value` pairs as params (of a repeated key the first), and its alignment blocks, none for a run without a hit.

    The pair is the folder named a__b above the file; set_id the one above that. Starts are on the stated strand.
    """
    files = _files(spark, root, glob).select("src_path", "value", F.regexp_extract("src_path", r"([^/]+)/([^/]+__[^/]+)/", 1).alias("set_id"), F.regexp_extract("src_path", r"/([^/]+__[^/]+)/", 1).alias("pair_id"))
    runs = files.select("set_id", "pair_id", F.regexp_extract_all("value", F.lit(r"(?m)^#+\s?([^\r\n]*)"), F.lit(1)).alias("comments"), "src_path")
    pair = lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("value"))
    given = F.transform(F.filter("comments", lambda x: F.instr(x, "=") > 1), pair)
    first = lambda x, i: F.array_position(F.transform(given, lambda e: e["key"]), x["key"]) == i + 1
    runs = runs.withColumn("params", F.map_from_entries(F.filter(given, first)))
    # the comments right before an `a` line describe its block
    blocks = files.select("set_id", "pair_id", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?m)((?:^#[^\n]*\n)*^a [^\n]*\n(?:^s [^\n]*(?:\n|$)){2})"), F.lit(1))).alias("block", "text"))
    row = lambda k: F.element_at(F.regexp_extract_all("text", F.lit(r"(?m)^s\s+([^\n]*)"), F.lit(1)), k)
    side = lambda k: (lambda x: F.struct(x[0].alias("src"), x[1].cast("bigint").alias("start"), x[2].cast("bigint").alias("size"), x[3].alias("strand"), x[4].cast("bigint").alias("total"), x[5].alias("text")))(F.split(F.trim(row(k)), r"\s+"))
    named = lambda key: F.regexp_extract("text", rf"(?m)^#\s*{key}=([^\n]*)", 1)
    return runs, blocks.select(
        "set_id", "pair_id", "block", F.regexp_extract("text", r"(?m)^a score=(-?\d+)", 1).try_cast("bigint").alias("score"), side(1).alias("t"), side(2).alias("q"),
        C.ratio(named("identity")).alias("identity"), C.ratio(named("coverage")).alias("coverage"), C.ratio(named("continuity")).alias("continuity"), F.trim(named("cigar")).alias("cigar"),
    )


def read_hits(spark: SparkSession, root: str) -> DataFrame:
    """set_id, comparison and the ten columns of headerless tab-separated hit files `<set>/<folder>/<comparison>`; empty files vanish."""
    df = spark.read.csv(root, sep="\t", schema=schemas.HIT, recursiveFileLookup=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")
    path = F.col("_metadata.file_path")
    return df.select(C.parent_folder(F.regexp_replace(path, "/[^/]*$", "")).alias("set_id"), F.element_at(F.split(path, "/"), -1).alias("comparison"), *df.columns)


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """BED: chrom, start, stop, name, score, strand, missing columns null; comment and track lines aside. Rows that don't parse are kept with nulls; see bad_records."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|browser)|^\s*$"))
    part = lambda k: F.get(F.split("value", "\t"), F.lit(k))
    kinds = [x.split() for x in schemas.BED.split(", ")]
    return lines.select(*(part(k).try_cast(t).alias(n) for k, (n, t) in enumerate(kinds)))
