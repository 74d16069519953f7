import os

import oracle
import pytest

from regionpairs.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, con, name):
    assert oracle.compare(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SF_DIR, con) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())


def test_enrichment_of_a_class_without_overlap(spark, tmp_path):
    """A class that overlaps no region has a row, as in the SQL."""
    day = "timestamp'2024-01-01'"
    spark.sql(f"SELECT id AS event_id, id % 3 AS user_id, 'click' AS event_type, {day} AS ts, cast(id * 7 % 100 AS double) AS value FROM range(1, 20)").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("SELECT 1L AS l_partkey, id AS l_suppkey, 0L AS l_linenumber, CASE WHEN id < 400 THEN 'A' ELSE 'N' END AS l_returnflag, 20.0D AS l_quantity, CASE WHEN id < 400 THEN 'F' ELSE 'O' END AS l_linestatus FROM range(800)").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = registry.QUERIES["te_enrichment"](spark, str(tmp_path))
    cur = oracle.connect(str(tmp_path)).execute(registry.ORACLE_SQL["te_enrichment"])
    # NaN equals NaN as text
    assert repr(oracle.rows_of(df.columns, df.collect())) == repr(oracle.rows_of([c[0] for c in cur.description], cur.fetchall()))
    assert {(r.cls, r.n11) for r in df.collect()} >= {("O", 0)}
