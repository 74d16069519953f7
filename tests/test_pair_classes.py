"""Classes of pairs whose regions bring their flanks along are those of joined pairs."""

import random

from pyspark.sql import functions as F

from regionpairs.operators import flanks, pairs
from regionpairs.plans import registry

ORDER = ["chrom", "start", "stop", "region_id"]


def _regions(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 2, None]), rnd.choice(["c", "d"]), s := rnd.randrange(900), s + rnd.randrange(1, 60), k // 2 if k < 20 else k) for k in range(90)]
    rows += rows[40:50]  # equal rows
    return spark.createDataFrame(rows, "set_id bigint, chrom string, start bigint, stop bigint, region_id bigint")


def test_breakdown_of_pair_classes(spark):
    iv = _regions(spark)
    fl, key = flanks.build(iv, 40), ["set_id", "a_region_id", "b_region_id"]
    two = pairs.within_sets(iv.withColumn("key", F.struct("set_id", "chrom")), ORDER, ORDER, by="key").withColumn("set_id", F.col("key.set_id")).where("set_id is not null")
    by_class = flanks.by_class(two, fl).select(*key, "cls").collect()
    want = {}
    for r in by_class:
        n = want.setdefault(tuple(r)[:3], dict.fromkeys(flanks.CLASSES, 0))
        n[r.cls] += 1
    got = flanks.pair_breakdown(flanks.pair_classes(iv, fl, ORDER)).collect()
    assert len(got) == len(want) and {tuple(r)[:3]: {c: r[c] for c in flanks.CLASSES} for r in got} == want
    assert all(r.double == ((r.LL > 0 and r.RR > 0) or (r.LR > 0 and r.RL > 0)) and r.single != r.double for r in got)
    again = flanks.breakdown(flanks.by_class(two, fl), key).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def _plan(spark, name):
    return registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_flank_breakdown_sums_once(spark):
    """One sum over pairs, after the join that makes them; no pivot."""
    plan = _plan(spark, "flank_breakdown")
    assert "pivotfirst" not in plan.lower() and plan.splitlines()[0].lstrip().startswith(("Aggregate", "Project"))


def test_hit_and_double_flank_joins_no_pairs(spark):
    """Pairs are made by the last join."""
    plan = _plan(spark, "hit_and_double_flank")
    top = next(line for line in plan.splitlines() if "Join" in line)
    assert "LeftSemi" not in top and "_first" in top
