"""The driver tables as regions, intervals, sequences and cohorts; each view also as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionpairs.functions import columns as C

CHROMOSOME = 1_001_000  # longer than any view interval's end


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def regions(spark: SparkSession, d: str) -> DataFrame:
    start = F.expr("(event_id * 7919) % 1000000")
    return table(spark, d, "events").select(F.col("user_id").alias("set_id"), F.col("event_type").alias("chrom"), start.alias("start"), (start + 200 + F.floor("value")).alias("stop"), F.col("event_id").alias("region_id"))


IV = "iv AS (SELECT user_id AS set_id, event_type AS chrom, (event_id * 7919) % 1000000 AS start, (event_id * 7919) % 1000000 + 200 + CAST(floor(value) AS BIGINT) AS stop, event_id AS region_id FROM events)"


def annotations(spark: SparkSession, d: str) -> DataFrame:
    start = F.expr("(l_partkey * l_suppkey * 131 + l_linenumber * 7919) % 1000000")
    chrom = F.expr("CASE l_returnflag WHEN 'A' THEN 'click' WHEN 'N' THEN 'view' ELSE 'error' END")
    return table(spark, d, "lineitem").select(chrom.alias("chrom"), start.alias("start"), (start + F.expr("CAST(l_quantity AS BIGINT) * 10")).alias("stop"), F.col("l_linestatus").alias("cls")).distinct()


def classes(spark: SparkSession, d: str) -> DataFrame:
    """The annotations' classes, without their positions."""
    return table(spark, d, "lineitem").select(F.col("l_linestatus").alias("cls")).distinct()


TE = """te AS (SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 'click' WHEN 'N' THEN 'view' ELSE 'error' END AS chrom, (l_partkey * l_suppkey * 131 + l_linenumber * 7919) % 1000000 AS start,
 (l_partkey * l_suppkey * 131 + l_linenumber * 7919) % 1000000 + CAST(l_quantity AS BIGINT) * 10 AS stop, l_linestatus AS cls FROM lineitem)"""


def letters(text: str) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(F.col(text), F.lit(""))), "[^ACGT]+", "")


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """The letters ACGT of whole conversation turns, however few; a conversation is a set."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("set_id"), F.col("turn").alias("member"), letters("text").alias("seq"))


SQ = "sq AS (SELECT conv_id AS set_id, turn AS member, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS seq FROM conversations)"


def genome(spark: SparkSession, d: str) -> DataFrame:
    """The letters ACGT of whole documents, each a chromosome; copies of an id are one. What is sorted by id is letters, not texts."""
    own = table(spark, d, "documents").select(F.col("doc_id").alias("set_id"), letters("text").alias("seq"))
    return own.groupBy("set_id").agg(F.min("seq").alias("seq")).withColumn("chrom", F.concat(F.lit("d"), F.col("set_id").cast("string")))


def sites_of(genome: DataFrame) -> DataFrame:
    """Regions of 100 letters, one in every 200 of a document; a document is a set."""
    k = F.explode(F.expr("sequence(0L, length(seq) div 200 - 1)")).alias("k")
    start = F.col("k") * 200 + 50
    return genome.where("length(seq) >= 200").select("set_id", "chrom", k).select("set_id", "chrom", start.alias("start"), (start + 100).alias("stop"), (F.col("set_id") * 100_000 + F.col("k")).alias("region_id"))


GENOME = "gn AS (SELECT doc_id AS set_id, 'd' || doc_id AS chrom, min(regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g')) AS seq FROM documents GROUP BY doc_id)"
SITES = "iv AS (SELECT set_id, chrom, k * 200 + 50 AS start, k * 200 + 150 AS stop, set_id * 100000 + k AS region_id FROM (SELECT set_id, chrom, unnest(range(0, length(seq) // 200)) AS k FROM gn))"


def order_regions(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as regions, an order being a set: sets of one to seven."""
    start = F.expr("(l_partkey * 7919 + l_suppkey * 131) % 1000000")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("set_id"), F.col("l_returnflag").alias("chrom"), start.alias("start"), (start + F.expr("CAST(l_quantity AS BIGINT) * 10")).alias("stop"), F.col("l_linenumber").alias("region_id"), (F.col("l_discount") >= 0.05).alias("hit"))


ORDERS = "iv AS (SELECT l_orderkey AS set_id, l_returnflag AS chrom, (l_partkey * 7919 + l_suppkey * 131) % 1000000 AS start, (l_partkey * 7919 + l_suppkey * 131) % 1000000 + CAST(l_quantity AS BIGINT) * 10 AS stop, l_linenumber AS region_id, l_discount >= 0.05 AS hit FROM lineitem)"


def headers(spark: SparkSession, d: str) -> DataFrame:
    iv = regions(spark, d)
    return iv.select("region_id", F.concat(F.lit(">"), C.region_name(F.col("chrom"), F.col("start"), F.col("stop")), F.lit(" label=gene"), F.col("set_id").cast("string"), F.when(F.col("region_id") % 3 > 0, F.concat(F.lit("_"), F.col("chrom"))).otherwise(""), F.lit(" role=LEFT")).alias("header"))


def cohorts(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents: quality splits observed and null, language groups, source is the replicate, length the score."""
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("grp"), F.col("source").alias("replicate"), F.col("n_chars").alias("score"))
    return table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "observed").otherwise("null").alias("cohort")).join(docs, "doc_id")


CO = "co AS (SELECT l.doc_id, CASE WHEN quality = 1 THEN 'observed' ELSE 'null' END AS cohort, lang AS grp, source AS replicate, n_chars AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def motifs(spark: SparkSession, d: str) -> DataFrame:
    """Words of whole turns, grouped by their first two letters."""
    w = F.explode(F.split(F.lower("text"), r"[^a-z]+"))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("set_id"), F.col("turn").alias("member"), w.alias("w")).where("length(w) >= 2").withColumn("w", F.substring("w", 1, 2))


MO = "mo AS (SELECT DISTINCT set_id, member, substr(w, 1, 2) AS w FROM (SELECT conv_id AS set_id, turn AS member, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM conversations) WHERE length(w) >= 2)"


def motif_groups(spark: SparkSession, d: str) -> DataFrame:
    """A mapping table of motifs (words of turns) to groups: a word's first letter and its last one, so most words are in two."""
    w = table(spark, d, "conversations").select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("w")).where("length(w) >= 2").distinct()
    return w.select("w", F.explode(F.array(F.concat(F.lit("starts "), F.substring("w", 1, 1)), F.concat(F.lit("ends "), F.expr("right(w, 1)")))).alias("grp"))


def words(spark: SparkSession, d: str) -> DataFrame:
    w = F.explode(F.split(F.lower("text"), r"[^a-z]+"))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("set_id"), F.col("turn").alias("member"), w.alias("w")).where("length(w) >= 2")


WD = "wd AS (SELECT DISTINCT set_id, member, w FROM (SELECT conv_id AS set_id, turn AS member, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM conversations) WHERE length(w) >= 2)"


def islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of overlapping or touching regions: disjoint intervals, named by their start."""
    from regionpairs.operators import intervals

    return intervals.merge(regions(spark, d), ["chrom"]).select("chrom", "start", "stop", F.col("start").alias("island"))


ISLANDS = """i1 AS (SELECT chrom, start, stop, max(stop) OVER (PARTITION BY chrom ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
i2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, stop, reach NULLS FIRST ROWS UNBOUNDED PRECEDING) AS run FROM i1),
il AS (SELECT chrom, min(start) AS start, max(stop) AS stop, min(start) AS island FROM i2 GROUP BY chrom, run)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    """The sequences with the role of their turn, which stands for a chromosome, and a name of their own."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("set_id"), F.col("turn").alias("member"), F.coalesce("role", F.lit("")).alias("chrom"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("name"), letters("text").alias("seq"))


TURNS = "tn AS (SELECT conv_id AS set_id, turn AS member, coalesce(role, '') AS chrom, conv_id || ':' || turn AS name, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS seq FROM conversations)"


def documents(spark: SparkSession, d: str) -> DataFrame:
    """The letters ACGT of whole documents, five neighbouring ids a set."""
    return genome(spark, d).select(F.expr("set_id div 5").alias("set_id"), F.col("set_id").alias("member"), "seq")


DOCUMENTS = "sq AS (SELECT set_id // 5 AS set_id, set_id AS member, seq FROM gn)"
