"""Values measured on the corpus that the toolkit is modelled on, and small cases worked out by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from regionpairs.functions import columns as C
from regionpairs.operators import alignments, evidence, flanks, intervals, nulls, pairs, regions, similarity

T, Q = "AGGGCACGTGCTCAGCTTGACTTCTGAGATACTTCTT", "AGGACACGCGCTCCGCTTGACCT-TGACATTGTTCCT"


def test_gapped_alignment_rescores(spark):
    r = alignments.metrics(spark.createDataFrame([(1, T, Q)], "id int, t string, q string"), ["id"]).first()
    assert (r.score, r.matches, r.aligned, r.columns) == (1633, 28, 36, 37)


def test_column_functions(spark):
    df = spark.createDataFrame([("chr3L:14936376-14936760 label=A_sm role=LEFT", "23m1d13m", "28/36 (77.8%)", "ACGTacgt")], "h string, cigar string, r string, s string")
    r = alignments.script_totals(df, "cigar").withColumn("at", C.coordinates(df.h)).withColumn("v", C.ratio(df.r)).withColumn("rc", C.reverse_complement(df.s)).withColumn("twice", C.reverse_complement(C.reverse_complement(df.s))).first()
    assert (r.m, r.i, r.d) == (36, 0, 1) and tuple(r.at) == ("chr3L", 14936376, 14936760)
    assert (r.v.n, r.v.d) == (28, 36) and r.rc == "acgtACGT" and r.twice == r.s
    plus = alignments.on_plus(spark.createDataFrame([(334, 36, "-", 374), (5, 3, "+", 9)], "start int, size int, strand string, total int")).collect()
    assert [x.plus_start for x in plus] == [4, 5]
    odd = spark.createDataFrame([("nothing here",), (None,), ("",)], "h string")
    assert {tuple(x.c) for x in odd.select(C.coordinates(odd.h).alias("c")).collect()} == {(None, None, None)}


def test_alignment_sides_on_the_chromosome(spark):
    rows = [(21, 37, "+", 19340770, 200), (334, 36, "-", 19343988, 374)]
    df = spark.createDataFrame(rows, "start bigint, size bigint, strand string, at bigint, total bigint")
    got = df.select(C.genomic(df.start, df["size"], df.strand, df.at, df.total).alias("g"), "at").withColumn("back", C.local_offset(F.col("g"), F.col("at"))).collect()
    assert [(r.g, r.back) for r in got] == [(19340791, 21), (19343992, 4)]


def test_flank_windows(spark):
    rows = [("Abd-B", "chr3R", 16920234, 16921056, 1), ("Abd-B", "chr3R", 16921371, 16921858, 2), ("sm", "chr3R", 9393661, 9394054, 3), ("sm", "chr3R", 9394057, 9394430, 4), ("n", "c", 100, 900, 5), ("n", "c", 200, 300, 6), ("n", "c", 950, 990, 7)]
    r = spark.createDataFrame(rows, "set_id string, chrom string, start bigint, stop bigint, region_id bigint")
    got = {(x.region_id, x.side): (x.start, x.stop, x.clipped) for x in flanks.build(r).collect()}
    assert got[1, "LEFT"] == (16917734, 16920234, False) and got[1, "RIGHT"] == (16921056, 16921371, True)
    assert got[2, "LEFT"] == (16921056, 16921371, True) and got[2, "RIGHT"] == (16921858, 16924358, False)
    assert got[4, "LEFT"] == (9394054, 9394057, True)
    assert (6, "LEFT") not in got and got[7, "LEFT"] == (900, 950, True) and got[5, "LEFT"] == (0, 100, True) and (5, "RIGHT") not in got
    same = pairs.within_sets(r, ["chrom", "start", "stop", "region_id"], ["chrom", "start", "stop", "region_id"])
    n = {x.set_id: x["count"] for x in same.groupBy("set_id").count().collect()}
    assert n == {"Abd-B": 1, "sm": 1, "n": 3}
    classes = flanks.by_class(same, flanks.build(r)).where("set_id = 'Abd-B'").collect()
    assert "RL" not in {x.cls for x in classes} and {x.cls for x in classes} == {"LL", "RR", "LR"}
    long = flanks.build(r, lengths=spark.createDataFrame([("c", 1000)], "chrom string, total bigint"))
    assert long.where("region_id = 7 and side = 'RIGHT'").first().stop == 1000


def test_facing_flanks(spark):
    """Both facing flanks go only if neither is clipped: not beside a close neighbour, nor with a third region between."""
    spots = {"far": [(16878885, 16879147), (16882506, 16882728)], "near": [(0, 100), (2599, 2700)], "edge": [(0, 100), (2600, 2700)], "apart": [(0, 100), (5100, 5200)], "third": [(0, 100), (1000, 1100), (3300, 3400)]}
    rows = [(s, "c", a, b, 10 * k + j) for k, (s, xs) in enumerate(spots.items()) for j, (a, b) in enumerate(xs)]
    r = spark.createDataFrame(rows, "set_id string, chrom string, start bigint, stop bigint, region_id bigint")
    two, around = pairs.within_sets(r, ["start", "region_id"], ["start", "stop", "region_id"]), flanks.build(r)
    got = {(x.set_id, x.a_start, x.b_start): x.facing_dropped for x in flanks.facing_dropped(two, around).collect()}
    assert got == {("far", 16878885, 16882506): True, ("near", 0, 2599): False, ("edge", 0, 2600): True, ("apart", 0, 5100): False, ("third", 0, 1000): False, ("third", 0, 3300): False, ("third", 1000, 3300): False}
    classes = {}
    for x in flanks.by_class(two, around).collect():
        classes.setdefault((x.set_id, x.a_region_id % 10, x.b_region_id % 10), set()).add(x.cls)
    assert classes["far", 0, 1] == {"LR"} and classes["apart", 0, 1] == {"RR", "RL"} and classes["third", 0, 2] == {"RR", "RL"}  # a region at 0 has no left flank


def test_flank_hits(spark):
    """Two regions whose left and right flanks are copies: LL and RR, so double; with a body copy, both."""
    rnd = random.Random(2)
    piece = lambda n: "".join(rnd.choices("ACGT", k=n))
    left, right, body = piece(60), piece(60), piece(40)
    seq = piece(50) + left + body + right + piece(150) + left + body.translate(str.maketrans("ACGT", "TGCA"))[::-1] + right + piece(50)
    r = spark.createDataFrame([(1, "c", 110, 150, 1), (1, "c", 420, 460, 2)], "set_id bigint, chrom string, start bigint, stop bigint, region_id bigint")
    two = pairs.within_sets(r, ["start"], ["region_id"])
    found = flanks.hits(r, spark.createDataFrame([("c", seq)], "chrom string, seq string"), two, width=60, min_score=60)
    assert sorted(x.cls for x in found.collect()) == ["B", "LL", "RR"]
    x = flanks.hit_breakdown(found).first()
    assert (x.LL, x.RR, x.LR, x.RL, x.body, x.double, x.single, x.both) == (True, True, False, False, True, True, False, True)


def test_masked_letters_seed_nothing(spark):
    rnd = random.Random(3)
    same = "".join(rnd.choices("ACGT", k=30))
    rows = [(1, 1, "A" * 80 + same), (1, 2, "A" * 80), (1, 3, same), (1, 4, "")]
    seqs = spark.createDataFrame(rows, "set_id int, member int, seq string")
    masked = {r.member: r.seq for r in similarity.masked(seqs).collect()}
    assert masked[2] == "N" * 80 and masked[3] == same and masked[4] == "" and set(masked[1][:64]) == {"N"}
    assert {(r.a, r.b) for r in similarity.seeds(seqs).collect()} >= {(1, 2), (1, 3)}
    assert {(r.a, r.b) for r in similarity.seeds(similarity.masked(seqs)).collect()} <= {(1, 3)}


def test_component_of_a_whole_set(spark):
    members = ["12467679", "12477322", "12502172", "12505525"]
    links = spark.createDataFrame([("FBgn0038056_sm", a, b) for a, b in itertools.combinations(members, 2)] + [("x", str(i), str(i + 1)) for i in range(10, 30)], "set_id string, a string, b string")
    got = evidence.components(links)
    assert {x.component for x in got.where("set_id = 'x'").collect()} == {"10"}
    sizes = spark.createDataFrame([("FBgn0038056_sm", "4"), ("x", "5+")], "set_id string, bin string")
    assert {tuple(x) for x in evidence.extra_copies(got, sizes).collect()} == {("4", 1, 3), ("5+", 1, 20)}


def test_component_of_a_long_chain(spark):
    """The chain 0, n - 1, n - 2, ..., 1 beside a shuffled one, a pair linked both ways and a member linked with itself."""
    n, rnd = 200, random.Random(4)
    mixed = rnd.sample(range(150), 150)
    chain = [0, *range(n - 1, 0, -1)]
    links = [("x", a, b) for a, b in itertools.pairwise(chain)] + [("y", a, b) for a, b in itertools.pairwise(mixed)] + [("z", 1, 2), ("z", 2, 1), ("z", 2, 2), ("z", 7, 7)]
    got = sorted(tuple(x) for x in evidence.components(spark.createDataFrame(links, "set_id string, a int, b int")).select("set_id", "member", "component").collect())
    assert got == [("x", k, 0) for k in range(n)] + [("y", k, 0) for k in range(150)] + [("z", 1, 1), ("z", 2, 1), ("z", 7, 7)]


def segment(a, b):
    """Best ungapped segment on every diagonal with a common 4-letter word, by trying all."""
    out = {}
    for diag in range(-len(b) + 1, len(a)):
        cols = [(i, a[i] == b[i - diag]) for i in range(max(0, diag), min(len(a), len(b) + diag))]
        if any(all(m for _, m in cols[k : k + 4]) for k in range(len(cols) - 3)):
            out[diag] = max(sum(2 if m else -3 for _, m in cols[i:j]) for i in range(len(cols)) for j in range(i + 1, len(cols) + 1))
    return out


def test_segments_match_brute_force(spark):
    rnd = random.Random(1)
    seqs = [("s", k, "".join(rnd.choices("ACGT", k=rnd.randrange(3, 40)))) for k in range(8)] + [("s", 20, ""), ("t", 1, "acgtacgta"), ("t", 2, "ACGTTCGTA")]
    df = spark.createDataFrame(seqs, "set_id string, member int, seq string")
    got = {(x.set_id, x.a, x.b, x.strand, x.diag): x for x in similarity.segments(similarity.seeds(df, 4), df).collect()}
    want = {}
    for (s, i, x), (t, j, y) in itertools.combinations(seqs, 2):
        if s == t:
            rc = y.upper()[::-1].translate(str.maketrans("ACGT", "TGCA"))
            for strand, z in (("+", y.upper()), ("-", rc)):
                want |= {(s, i, j, strand, d): v for d, v in segment(x.upper(), z).items()}
    assert {k: x.score for k, x in got.items()} == want
    of = {(s, m): q.upper() for s, m, q in seqs}
    for (s, a, b, strand, _), x in got.items():
        y = of[s, b] if strand == "+" else of[s, b][::-1].translate(str.maketrans("ACGT", "TGCA"))
        p, q = of[s, a][x.qstart : x.qend], y[x.sstart : x.send]
        assert x.sseq == q and sum(2 if m == n else -3 for m, n in zip(p, q)) == x.score and x.matches == sum(m == n for m, n in zip(p, q))


def test_seeds_find_a_copy_on_either_strand(spark):
    core = "ACGTTGCATGCCATTGACGATCGATTACG"
    rc = core[::-1].translate(str.maketrans("ACGT", "TGCA"))
    df = spark.createDataFrame([("s", 1, "TTTT" + core + "AA"), ("s", 2, "GG" + rc.lower() + "C")], "set_id string, member int, seq string")
    best = similarity.best_per_pair(similarity.segments(similarity.seeds(df), df), ["set_id", "a", "b"]).first()
    assert (best.strand, best.score, best.qstart, best.qend) == ("-", 2 * len(core), 4, 4 + len(core))


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_joins_match_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(intervals, "BUCKET", 70)
    rnd = random.Random(seed)
    make = lambda n, w: [(k, rnd.choice("xy"), s := rnd.randrange(600), s + rnd.randrange(0, w)) for k in range(n)]
    a, b = make(60, 50), make(70, 90)
    a += [(k + 100, *x[1:]) for k, x in enumerate(a[:5])]
    da = spark.createDataFrame(a, "a_id int, a_chrom string, a_start bigint, a_stop bigint")
    db = spark.createDataFrame(b, "b_id int, b_chrom string, b_start bigint, b_stop bigint")
    got = sorted((x.a_id, x.b_id) for x in intervals.overlaps(da, db, 32).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3])
    cov = {x.a_id: x.covered for x in intervals.covered(da, db, ["a_id"], 32).collect()}
    for k, c, s, e in a:
        assert cov[k] == len({p for p in range(s, e) for y in b if y[1] == c and y[2] <= p < y[3]})
    merged = intervals.merge(spark.createDataFrame([x[1:] for x in b], "chrom string, start bigint, stop bigint"), ["chrom"])
    again = intervals.merge(merged.select("chrom", "start", "stop"), ["chrom"])
    plain = lambda df: sorted((x.chrom, x.start, x.stop) for x in df.collect())
    assert plain(merged) == plain(again) and sum(x.n for x in merged.collect()) == sum(y[2] < y[3] for y in b)
    r = spark.createDataFrame([(c, s, e, k) for k, c, s, e in a], "chrom string, start bigint, stop bigint, region_id int")
    near = {x.region_id: (x.up, x.down) for x in intervals.nearest(r, spark.createDataFrame([x[1:] for x in b], "chrom string, start bigint, stop bigint")).collect()}
    for k, c, s, e in a:
        assert near[k] == (max((y[3] for y in b if y[1] == c and y[3] <= s), default=None), min((y[2] for y in b if y[1] == c and y[2] >= e), default=None))


def test_empirical_p_in_two_levels(spark):
    rnd = random.Random(3)
    null, obs = [("g", rnd.randrange(500)) for _ in range(200)], [(k, "g", rnd.randrange(520)) for k in range(50)] + [(99, "none", 5)]
    got = nulls.empirical_p(spark.createDataFrame(obs, "id int, g string, score bigint"), spark.createDataFrame(null, "g string, score bigint"), ["g"], "score")
    p = {x.id: x.p for x in got.collect()}
    for k, g, s in obs:
        n = [x for h, x in null if h == g]
        assert p[k] == pytest.approx((1 + sum(x >= s for x in n)) / (1 + len(n)))


def test_set_bins(spark):
    rows = [(f"s{n}_{k}", "c", 100 * i, 100 * i + 10) for n, sets in ((2, 217), (3, 104), (4, 52)) for k in range(sets) for i in range(n)] + [("s", "c", 5, 9)] * 2
    got = {x.bin: (x.sets, x.memberships, x.pairs) for x in regions.bin_counts(spark.createDataFrame(rows, "set_id string, chrom string, start bigint, stop bigint")).collect()}
    assert got == {"1": (1, 1, 0), "2": (217, 434, 217), "3": (104, 312, 312), "4": (52, 208, 312)}
