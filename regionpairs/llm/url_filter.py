"""Operator 3: URL filter by host-suffix and path-prefix expressions.

Every URL is expanded into the expressions that some rule could equal: its host and parent domains, by the rules' depths,
each with the path's prefixes of the rules' path lengths. An equi-join on the first 32 bits of the expression's SHA-256
finds candidates, the full digest confirms them, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The production rules: verdict, host, path prefix.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """host and path of each URL: both empty for null and where no :// stands."""
    rest = F.when(F.locate("://", F.col(url)) > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    return pages.withColumn("_rest", F.coalesce(rest, F.lit(""))).withColumn("host", F.translate(host, UPPER, LOW)).withColumn("path", F.regexp_extract(F.expr("substring(_rest, length(host) + 1)"), r"^([^?#]*)", 1)).drop("_rest")


def digest(host: Column, path: Column) -> Column:
    # the host's length keeps host and path apart
    return F.sha2(F.concat_ws("\n", F.length(host).cast("string"), host, path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages.

    Null, empty and scheme-less URLs have no host, so no rule and the default verdict; repeated rows are kept; of rules of
    one length the longer host, then "block" wins. Rules may be many: they are joined, not held in tasks. A rule with an
    empty host never fits.
    """
    rules = rules.where(F.col("rule_host") != "").select("verdict", F.translate("rule_host", UPPER, LOW).alias("rule_host"), "rule_path").distinct()
    shape = rules.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("depth"), F.array_sort(F.collect_set(F.length("rule_path"))).alias("lengths")).first()
    urls = parts(pages.select(F.col("page_id"), F.col("url")).withColumn("_row", F.monotonically_increasing_id()))
    if shape.depth is None:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(shape.depth))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    prefixes = F.transform(F.filter(F.array(*(F.lit(n) for n in shape.lengths)), lambda n: n <= F.length("path")), lambda n: F.expr("path").substr(F.lit(1), n))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    wide = urls.select("page_id", "_row", "host", "path", F.explode_outer(F.when(F.col("host") != "", pairs)).alias("e")).withColumn("_full", digest(F.col("e.h"), F.col("e.p")))
    keyed = rules.withColumn("_rfull", digest(F.col("rule_host"), F.col("rule_path")))
    short = lambda c: F.substring(c, 1, 8)
    met = wide.withColumn("_short", short("_full")).join(keyed.withColumn("_rshort", short("_rfull")), F.col("_short") == F.col("_rshort"), "left")
    sure = F.when(F.col("_full") == F.col("_rfull"), F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), F.col("verdict").alias("v"), F.concat("rule_host", "rule_path").alias("rule")))
    best = met.groupBy("_row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(sure).alias("b"))
    return best.select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce(F.col("b.v"), F.lit(default)).alias("verdict"))


ORACLE = f"""
WITH rules(verdict, rh, rp) AS (VALUES {', '.join(str(r) for r in RULES)}),
a AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT r, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT r, page_id, translate(h, '{UPPER}', '{LOW}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT c.*, rules.verdict AS v, rh || rp AS rule, length(rh) + length(rp) AS n, length(rh) AS hn
      FROM c LEFT JOIN rules ON (c.host = rh OR ends_with(c.host, '.' || rh)) AND starts_with(c.path, rp)),
e AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n DESC NULLS LAST, hn DESC, v DESC) AS k FROM d)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM e WHERE k = 1
"""
