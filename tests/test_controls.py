"""Controls, quantiles, minima and masks against brute force on small inputs."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionpairs.functions import columns as C
from regionpairs.operators import flanks, nulls, regions, similarity


@pytest.mark.parametrize("parts", [2, 1024])
def test_quantiles(spark, monkeypatch, parts):
    monkeypatch.setattr(nulls, "PARTS", parts)
    rnd = random.Random(1)
    rows = [("even", 1, float(rnd.randrange(50))) for _ in range(300)] + [("far", 1, x) for x in (1e12, -1e12, 0.1, 0.2, 0.3, 0.30000001)] + [("one", 2, 7.0)] + [(None, None, float(k)) for k in range(7)]
    rows += [("same", 1, 3.0)] * 20 + [("even", 1, None), ("null", 1, None)] + [("tail", 1, rnd.paretovariate(0.5)) for _ in range(500)]
    at = (0.0, 0.1, 0.5, 0.9, 0.99, 1.0)
    df = spark.createDataFrame([(*r, "x") for r in rows], "g string, h int, x double, q string")
    got = {(r.g, r.h): (r.n, r.q) for r in nulls.quantiles(df, ["g", "h"], "x", at).collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        own = [x for *k, x in rows if tuple(k) == key and x is not None]
        if own:
            want[key] = (len(own), pytest.approx([float(np.quantile(own, p)) for p in at], rel=1e-9))
    assert got == want
    every = nulls.quantiles(df, [], "x", (0.5,)).first()
    assert every.q[0] == pytest.approx(np.median([x for *_, x in rows if x is not None]))
    assert nulls.quantiles(df.limit(0), ["g"], "x").count() == 0
    stats = {r.g: r for r in nulls.replicate_stats(df, ["g"], "x").collect()}
    assert stats["null"].n == 0 and stats["null"].median is None and stats[None].median == 3.0
    five = {r.g: r for r in regions.five_numbers(df, ["g"], "x").collect()}
    assert (five[None].n, five[None].mean, five[None].q0, five[None].q4) == (7, 3.0, 0.0, 6.0) and "null" not in five


def test_permuted_intervals(spark):
    rnd, rows = random.Random(2), []
    for c in "xy":
        at = 0
        for k in range(60):
            at += rnd.choice([0, 0, 5, 40])
            n = rnd.randrange(1, 30)
            rows.append((c, at, at + n, k))
            at += n
    df = spark.createDataFrame(rows, "chrom string, start bigint, stop bigint, k int")
    total = max(r[2] for r in rows) + 7
    got = nulls.permute(df, "k", spark.createDataFrame([("x", total)], "chrom string, total bigint"), 3).collect()
    size = {(c, k): b - a for c, a, b, k in rows}
    assert len(got) == 3 * len(rows) and all(r.stop - r.start == size[r.chrom, r.k] for r in got)
    for rep, c in itertools.product((1, 2, 3), "xy"):
        own = sorted((r.start, r.stop) for r in got if (r.rep, r.chrom) == (rep, c))
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(own)) and own[0][0] >= 0 and own[-1][1] <= (total if c == "x" else max(r[2] for r in rows if r[0] == "y"))
    order = lambda rep: [r.k for r in sorted((r for r in got if r.rep == rep and r.chrom == "x"), key=lambda r: r.start)]
    assert order(1) != order(2) != order(3) != sorted(order(3))


def test_matched_sets(spark):
    rnd = random.Random(3)
    members = [(rnd.randrange(12), rnd.choice("xyz"), k) for k in range(80)]
    pool = [("x", k) for k in range(1000, 1100)] + [("y", k) for k in range(2000, 2005)]
    got = nulls.matched_sets(spark.createDataFrame(members, "set_id int, chrom string, k int"), spark.createDataFrame(pool, "chrom string, k int"), "k", ["chrom"], 2).collect()
    want = Counter((s, c) for s, c, _ in members if c != "z")  # the pool has no z
    for rep in (1, 2):
        own = [r for r in got if r.rep == rep]
        assert Counter((r.set_id, r.chrom) for r in own) == want
        x = [r.k for r in own if r.chrom == "x"]
        assert len(set(x)) == len(x) and set(x) <= set(range(1000, 1100))
        drawn = Counter(r.k for r in own if r.chrom == "y")
        assert set(drawn) == set(range(2000, 2005)) and max(drawn.values()) - min(drawn.values()) <= 1
    assert {(r.set_id, r.slot, r.k) for r in got if r.rep == 1} != {(r.set_id, r.slot, r.k) for r in got if r.rep == 2}


def test_permutation_test(spark):
    counts = [("a", 0, 10), ("a", 1, 3), ("a", 2, 12), ("b", 0, 5), ("c", 1, 4)]
    got = {r.cls: r for r in nulls.permutation_test(spark.createDataFrame(counts, "cls string, rep int, n bigint"), "cls", 3).collect()}
    assert (got["a"].observed, got["a"].null_mean, got["a"].p) == (10, 5.0, 0.5)
    assert (got["b"].null_mean, got["b"].z, got["b"].p) == (0.0, None, 0.25) and (got["c"].observed, got["c"].p) == (0, 1.0)


def perfect(seq, level, width):
    """Perfect intervals by the definition: score above level, and no stretch within scores higher."""
    tri = [seq[i : i + 3].upper() for i in range(len(seq) - 2)]
    score = {}
    for i in range(len(tri)):
        for e in range(i + 1, min(i + width - 2, len(tri))):
            score[i, e] = sum(c * (c - 1) / 2 for c in Counter(tri[i : e + 1]).values()) / (e - i)
    out = set()
    for (i, e), x in score.items():
        if x > level and all(score[a, b] <= x for a in range(i, e) for b in range(a + 1, e + 1)):
            out |= set(range(i, e + 3))
    return "".join("N" if k in out else c for k, c in enumerate(seq))


def test_dust_against_its_definition(spark, monkeypatch):
    rnd = random.Random(4)
    some = ["", "A", "AC", "A" * 30, "ACGT" * 4 + "A" * 12 + "CGTTGCA", "acac" * 6 + "GATTC", "N" * 9 + "ACG", "é" * 12 + "ACGT"]
    some += ["".join(rnd.choices("ACGT", weights=[5, 1, 1, 1], k=rnd.randrange(50))) for _ in range(20)]
    for level, width in ((2.0, 64), (1.0, 12)):
        df = spark.createDataFrame([(1, k, s) for k, s in enumerate(some)] + [(2, 0, None)], "set_id int, member int, seq string")
        got = {(r.set_id, r.member): r.seq for r in similarity.dusted(df, level, width).collect()}
        assert got == {(1, k): perfect(s, level, width) for k, s in enumerate(some)} | {(2, 0): None}
    monkeypatch.setattr(similarity, "PIECE", 7)
    assert [similarity._dust(s, 1.0, 12) for s in some] == [perfect(s, 1.0, 12) for s in some]


def test_minhash_recall(spark):
    """0.9 or more of the pairs that the exact join finds, and no others."""
    rnd = random.Random(5)
    seqs = []
    for s in range(12):
        base = rnd.choices("ACGT", k=300)
        for m in range(6):
            seqs.append((s, m, "".join(rnd.choice("ACGT") if rnd.random() < 0.02 * m else x for x in base)))
    df = spark.createDataFrame([*seqs, (99, 1, "ACG"), (99, 2, None)], "set_id int, member int, seq string")
    exact = {(r.set_id, r.a, r.b): r.jaccard for r in similarity.word_jaccard(df, 8).collect() if r.jaccard >= 0.4}
    got = {(r.set_id, r.a, r.b): r.jaccard for r in similarity.minhash_links(df, 8, 0.4).collect()}
    assert set(got) <= set(exact) and all(got[k] == pytest.approx(exact[k]) for k in got) and len(got) >= 0.9 * len(exact) > 30


def test_scale_of_scores(spark):
    rows = [(0.25,), (0.3,), (0.55,), (0.05,), (0.6,), (1.0,), (0.0,), (None,)]
    got = {r.m: r.x for r in spark.createDataFrame(rows, "m double").select("m", C.karlin_lambda(F.col("m")).alias("x")).collect()}
    assert got[0.25] == pytest.approx(0.63373, abs=5e-6) and [got[m] for m in (0.6, 1.0, 0.0, None)] == [None] * 4
    for m in (0.3, 0.55, 0.05):
        assert m * math.exp(2 * got[m]) + (1 - m) * math.exp(-3 * got[m]) == pytest.approx(1, abs=1e-9) and got[m] > 0
    seqs = spark.createDataFrame([("u", 1, "ACGT" * 5), ("u", 2, "acgt"), ("g", 1, "G" * 9 + "N"), ("e", 1, "")], "set_id string, member int, seq string")
    scales = {r.set_id: (r.letters, r.scale) for r in similarity.score_scales(seqs).collect()}
    assert scales["u"][0] == 24 and scales["u"][1] == pytest.approx(0.63373, abs=5e-6) and scales["g"] == (9, None) and scales["e"] == (0, None)


def test_shared_words_give_the_same_seeds(spark):
    rnd = random.Random(6)
    seqs = [(s, m, "".join(rnd.choices("ACGT", k=60)) + "ACGTTGCATGCAA") for s in "pq" for m in range(4)]
    df = spark.createDataFrame(seqs, "set_id string, member int, seq string")
    named = df.withColumn("name", F.concat_ws(":", "set_id", F.col("member").cast("string")))
    shared = similarity.seeds_in(named.select("set_id", "member", "name"), similarity.spots(named.select("name", "seq"), ["name"]), "name")
    assert sorted(map(tuple, shared.collect())) == sorted(map(tuple, similarity.seeds(df).select(shared.columns).collect()))


def test_masked_flank_hits(spark):
    """A low-complexity copy is a hit without masking and none with it; an e-value cuts as a score does."""
    rnd = random.Random(7)
    piece = lambda n: "".join(rnd.choices("ACGT", k=n))
    low, body = "AC" * 30, piece(40)
    seq = piece(50) + low + body + piece(200) + low + body[::-1] + piece(60)
    r = spark.createDataFrame([(1, "c", 110, 150, 1), (1, "c", 410, 450, 2)], "set_id bigint, chrom string, start bigint, stop bigint, region_id bigint")
    letters = spark.createDataFrame([("c", seq)], "chrom string, seq string")
    two = spark.createDataFrame([(1, 1, 2)], "set_id bigint, a_region_id bigint, b_region_id bigint")
    found = lambda **k: {x.cls for x in flanks.hits(r, letters, two, width=60, **k).collect()}
    assert "LL" in found(max_e=1e-4) and "LL" in found(min_score=60) and "LL" not in found(max_e=1e-4, masked=True)
