"""What overlaps, counted at ends instead of paired: equal to brute force, and no slower where all lies over each other."""

import random
import time

import pytest

from regionpairs.operators import intervals
from regionpairs.plans import registry


def _rows(seed, n, m):
    rnd = random.Random(seed)
    chrom = lambda: rnd.choice(["c", "d", None])
    a = [(k % 70, chrom(), s := rnd.randrange(60), s + rnd.randrange(0, 40)) for k in range(n)]
    b = [(chrom(), s := rnd.randrange(90), s + rnd.randrange(0, 50), rnd.choice(["x", "y", None])) for _ in range(m)]
    return a, b


def _tables(spark, a, b):
    return spark.createDataFrame(a, "a_region_id bigint, a_chrom string, a_start bigint, a_stop bigint"), spark.createDataFrame(b, "b_chrom string, b_start bigint, b_stop bigint, b_cls string")


def _pairs(a, b):
    return [(r, t) for r in a for t in b if r[1] is not None and r[1] == t[0] and t[1] < t[2]]


@pytest.mark.parametrize("bucket", [7, 50_000])
def test_counts_are_those_of_pairs(spark, bucket):
    a, b = _rows(1, 90, 120)
    x, y = _tables(spark, a, b)
    want, near, cut, long = {}, {}, {}, set()
    for (k, c, s, e), (_, ts, te, cls) in _pairs(a, b):
        if s < te and ts < e:
            n = want.setdefault((k, cls), [0, 0, 0])
            edges = (ts < s < te) + (ts < e < te)
            n[0], n[1], n[2] = n[0] + 1, n[1] + min(e, te) - max(s, ts), n[2] + edges
            cut[c, edges] = cut.get((c, edges), 0) + 1
            if min(e, te) - max(s, ts) >= 12:
                long.add(k)
        if ts < e + 15 and te > max(s - 15, 0) and (te <= s or ts >= e):
            near[k, cls] = near.get((k, cls), 0) + 1
    got = intervals.overlap_counts(x, y, ["a_region_id"], ["b_cls"], bucket).collect()
    assert len(got) == len(want) and {(r.a_region_id, r.b_cls): [r.n, r.bases, r.edges] for r in got} == want
    assert {(r.a_region_id, r.b_cls): r.n for r in intervals.around_counts(x, y, ["a_region_id"], 15, ["b_cls"], bucket).collect()} == near
    assert {(r.chrom, r.edges): r.n for r in intervals.edge_counts(x, y, bucket).collect()} == cut
    assert {r.a_region_id for r in intervals.long_overlaps(x, y, ["a_region_id"], 12, bucket).collect()} == long


@pytest.mark.parametrize("least", [0, 1, 9])
def test_within(spark, least):
    """b around a, also with positions below 0 and where a's shortest row is long."""
    rnd = random.Random(least)
    a = [(k, rnd.choice("cd"), s := rnd.randrange(-50, 300), s + least + rnd.randrange(0, 20)) for k in range(80)]
    b = [(rnd.choice("cd"), s := rnd.randrange(-60, 300), s + rnd.choice([1, 5, 30, 250]), "x") for _ in range(80)]
    want = {}
    for (_, c, s, e), (_, ts, te, _) in _pairs(a, b):
        want[c] = want.get(c, 0) + (ts < s and te > e)
    got = {r.chrom: r.n for r in intervals.within(*_tables(spark, a, b), 16).collect()}
    assert {c: n for c, n in got.items() if n} == {c: n for c, n in want.items() if n}


N, AT, LONG = 60_000, 7919, 300


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """60,000 regions at one place and 38,000 annotations over it: over a billion pairs."""
    d = tmp_path_factory.mktemp("dense")
    spark.sql(f"SELECT 1 + id * 1000000 AS event_id, id div 4 AS user_id, 'click' AS event_type, timestamp'2024-01-01' AS ts, {LONG - 200}.0D AS value FROM range({N})").coalesce(2).write.parquet(f"{d}/events.parquet")
    back = pow(131, -1, 1_000_000)
    spark.sql(
        f"SELECT ((r + 1000000) * {back}L) % 1000000 AS l_partkey, 1L AS l_suppkey, 1 AS l_linenumber, 'A' AS l_returnflag, cast(q AS double) AS l_quantity, if(q % 2 = 0, 'F', 'O') AS l_linestatus FROM (SELECT id - 480 AS r FROM range(760)), (SELECT id + 1 AS q FROM range(50))"
    ).coalesce(2).write.parquet(f"{d}/lineitem.parquet")
    return str(d), [(s := AT + r, s + q * 10, "F" if q % 2 == 0 else "O") for r in range(-480, 280) for q in range(1, 51)]


def _run(spark, dense, name):
    began = time.time()
    rows = registry.QUERIES[name](spark, dense[0]).collect()
    assert time.time() - began < 60
    return rows


def test_neighbourhood_of_dense_regions(spark, dense):
    want = {c: sum(t[2] == c and (t[1] <= AT or t[0] >= AT + LONG) for t in dense[1]) for c in "FO"}
    rows = _run(spark, dense, "neighbourhood")
    assert len(rows) == 2 * N and {(r.cls, r.n) for r in rows} == set(want.items())


def test_split_fractions_of_dense_regions(spark, dense):
    over = [(s < AT < e) + (s < AT + LONG < e) for s, e, _ in dense[1] if s < AT + LONG and AT < e]
    got = {(r.chrom, r.category): r.n for r in _run(spark, dense, "split_fractions")}
    assert got == {(None, None): N * len(over), ("click", None): N * len(over)} | {("click", c): N * over.count(k) for k, c in enumerate(("inside", "one edge", "both edges"))}


def test_boundary_split_of_dense_regions(spark, dense):
    want = {c: sum((s < AT < e) + (s < AT + LONG < e) for s, e, x in dense[1] if x == c) for c in "FO"}
    rows = _run(spark, dense, "boundary_split")
    assert len(rows) == 2 * N and {(r.cls, r.edges) for r in rows} == set(want.items())


def test_enrichment_of_dense_regions(spark, dense):
    assert {(r.cls, r.n11, r.n10, r.n01, r.n00) for r in _run(spark, dense, "te_enrichment")} == {(c, N, 0, 0, 0) for c in "FO"}


def test_shifted_overlaps_of_dense_regions(spark, dense, monkeypatch):
    """Regions that the control leaves at one place."""
    monkeypatch.setattr(registry.nulls, "shift", lambda df, *_: df)
    want = {c: [min(e, AT + LONG) - max(s, AT) for s, e, x in dense[1] if x == c and s < AT + LONG and AT < e] for c in "FO"}
    assert {(r.cls, r.n, r.regions, r.bases) for r in _run(spark, dense, "shifted_overlaps")} == {(c, N * len(w), N, N * sum(w)) for c, w in want.items()}


def test_overlap_join_of_dense_regions(spark, dense):
    want = {c: [min(e, AT + LONG) - max(s, AT) for s, e, x in dense[1] if x == c and s < AT + LONG and AT < e] for c in "FO"}
    rows = _run(spark, dense, "overlap_join")
    assert len(rows) == 2 * N and {(r.cls, r.n, r.bases) for r in rows} == {(c, len(w), sum(w)) for c, w in want.items()}


def test_hits_of_dense_regions(spark, dense):
    assert [(r.bin, r.regions, r.hit_regions) for r in _run(spark, dense, "hits_per_bin")] == [("1", 1, 1)]
