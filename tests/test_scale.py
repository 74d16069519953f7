"""Forms that keep hot sets, frequent words and long sequences apart give what the plain ones give."""

import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from regionpairs.operators import flanks, pairs, similarity


def test_chunks(spark):
    rows = [("a", "x" * 10), ("b", ""), ("c", None), ("d", "ab\ncd\r\nefé"), ("e", "y" * 8)]
    df = spark.createDataFrame(rows, "chrom string, seq string")
    got = sorted((r.chrom, r.chunk, r.part) for r in flanks.chunks(df, ["chrom"], 4).collect())
    assert got == sorted((c, k, s if s is None else s[4 * k : 4 * k + 4]) for c, s in rows for k in range(max(1, -(-len(s or "") // 4))))


def test_chunks_take_linear_time(spark):
    """Four times the letters in a row take at most some eight times as long (quadratic: sixteen), over 64-letter chunks."""
    took = []
    for n in (2_000_000, 2_000_000, 8_000_000):  # the first run compiles
        df = spark.range(1).select(F.lit("c").alias("chrom"), F.repeat(F.lit("ACGTTGCA"), n // 8).alias("seq"))
        began = time.time()
        r = flanks.chunks(df, ["chrom"]).agg(F.count("*"), F.sum(F.length("part"))).first()
        took.append(time.time() - began)
        assert tuple(r) == (n // 64, n)
    assert took[2] < 8 * took[1] + 2


@pytest.mark.parametrize("bucket", [7, 50, 10**6])
def test_flanks_in_buckets(spark, bucket):
    rnd = random.Random(1)
    rows = [(rnd.choice(["s", "t", None]), rnd.choice(["c", None]), s := rnd.randrange(400), s + rnd.randrange(1, 30), k) for k in range(150)]
    got = {(r.region_id, r.side): (r.start, r.stop) for r in flanks.build(spark.createDataFrame(rows, "set_id string, chrom string, start bigint, stop bigint, region_id bigint"), width=40, bucket=bucket).collect()}
    want = {}
    for s, c, a, b, k in rows:
        own = sorted((x[2], x[3], x[4]) for x in rows if x[:2] == (s, c))
        at = own.index((a, b, k))
        left = max([0, a - 40, *(x[1] for x in own[:at])])
        right = min([b + 40, *(x[0] for x in own[at + 1 : at + 2])])
        want |= {(k, "LEFT"): (left, a)} if left < a else {}
        want |= {(k, "RIGHT"): (b, right)} if b < right else {}
    assert got == want


def test_flanks_of_a_large_set_are_dealt_out(spark):
    """One set of many regions: the rows of a bucket, not of a set, are one window's."""
    rows = spark.range(200_000).select(F.lit("s").alias("set_id"), F.lit("c").alias("chrom"), (F.col("id") * 1000).alias("start"), (F.col("id") * 1000 + 100).alias("stop"), F.col("id").alias("region_id"))
    got = flanks.build(rows, width=2500)
    assert got.count() == 2 * 200_000 - 1  # the first starts at 0
    n = got.select(F.expr("start div 1000000").alias("b")).groupBy("b").count().agg(F.max("count")).first()[0]
    assert n <= 2100


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_pairs_in_blocks(spark, block):
    rows = [("s", k) for k in range(10)] + [("t", 1), ("t", 2), ("u", 5), (None, 1), (None, 2)]
    got = sorted((r.set_id, r.a_k, r.b_k) for r in pairs.within_sets(spark.createDataFrame(rows, "set_id string, k int"), ["k"], ["k"], block=block).collect())
    assert got == sorted((s, a, b) for s, a in rows for t, b in rows if s is not None and s == t and a < b)


def diagonals(x, y, k):
    return {i - j for i in range(len(x) - k + 1) for j in range(len(y) - k + 1) if x[i : i + k] == y[j : j + k] and "N" not in x[i : i + k]}


@pytest.mark.parametrize("block", [2, 1000])
def test_seeds_of_repeats(spark, block):
    rnd = random.Random(2)
    unit = "".join(rnd.choices("ACGT", k=7))
    some = ["A" * 40, "A" * 25 + "C" + "A" * 31, "AC" * 20, "CACA" * 8 + "T" + "AC" * 9, unit * 6, "G" + unit * 4 + "TT" + unit * 3, "ACGNACGTACGNNACGT" * 2, "", "AC", "ACT" * 9 + "AAT" * 5 + "ACT" * 4]
    some += ["".join(rnd.choices("AC", k=rnd.randrange(60))) for _ in range(6)]
    seqs = [("s", k, x) for k, x in enumerate(some)] + [("t", 1, "A" * 9), ("t", 2, "a" * 12)]
    got = {}
    for r in similarity.seeds(spark.createDataFrame(seqs, "set_id string, member int, seq string"), 4, block=block).collect():
        got.setdefault((r.set_id, r.a, r.b, r.strand), []).append(r.diag)
    want = {}
    for s, i, x in seqs:
        for t, j, y in seqs:
            if s == t and i < j:
                for strand, z in (("+", y.upper()), ("-", y.upper()[::-1].translate(str.maketrans("ACGT", "TGCA")))):
                    want[s, i, j, strand] = diagonals(x.upper(), z, 4)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}


def test_a_word_that_fills_two_sequences_is_one_row(spark):
    """Poly-A and a long repeat: as many runs as words, whatever the length; the diagonals are those of all places."""
    unit = "ACGTTGCATTGACCA"
    for seq, words in (("A" * 2000, 1), (unit * 100, len(unit))):
        df = spark.createDataFrame([("s", 1, seq), ("s", 2, seq)], "set_id string, member int, seq string")
        assert similarity.runs(df, 10).groupBy("member").count().agg(F.max("count")).first()[0] == words
        plus = [r.diag for r in similarity.seeds(df).where("strand = '+'").collect()]
        period = 1 if words == 1 else len(unit)
        assert sorted(plus) == [d for d in range(-len(seq) + 10, len(seq) - 9) if d % period == 0]


def test_seeds_of_asked_pairs(spark):
    df = spark.createDataFrame([("s", k, "ACGTACGTTGCA") for k in range(4)], "set_id string, member int, seq string")
    asked = spark.createDataFrame([("s", 1, 3), ("t", 0, 1)], "set_id string, a int, b int")
    assert {(r.a, r.b) for r in similarity.seeds(df, asked=asked).collect()} == {(1, 3)}


def test_segments_of_many_long_diagonals(spark):
    """Nine million columns of 5,981 diagonals: folded letter by letter they took minutes."""
    n = 3000
    df = spark.createDataFrame([("s", 1, "A" * n), ("s", 2, "A" * n)], "set_id string, member int, seq string")
    began = time.time()
    rows = similarity.segments(similarity.seeds(df), df).select("diag", "score", "qstart", "qend", "sstart", "matches").collect()
    assert time.time() - began < 15
    assert sorted(map(tuple, rows)) == [(d, 2 * (n - abs(d)), max(d, 0), min(n, n + d), max(-d, 0), n - abs(d)) for d in range(-n + 10, n - 9)]


@pytest.mark.parametrize("columns", [1, 50, 1 << 20])
def test_best_columns(monkeypatch, columns):
    """Many diagonals at a time give what a fold of each one gives, in steps of any size, of any letters, without columns too."""
    import pyarrow as pa

    def fold(x, y):
        run = since = best = lo = hi = 0
        for i, (p, q) in enumerate(zip(x, y)):
            v = 2 if p == q else -3
            run, since = (run + v, since) if run > 0 else (v, i)
            if run > best:
                best, lo, hi = run, since, i + 1
        return best, lo, hi

    monkeypatch.setattr(similarity, "COLUMNS", columns)
    rnd = random.Random(5)
    rows = [tuple("".join(rnd.choices(letters, k=n)) for _ in "xy") for letters in ("AC", "ACGT", "Aé😀") for n in range(40) for _ in range(4)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), *(pa.array(x) for x in zip(*rows))], names=["k", "x", "y"])
    got = next(similarity._best_columns([batch, batch]))
    assert got.schema.names == ["k", "y", "score", "lo", "hi"] and next(similarity._best_columns([batch.slice(0, 0)])).num_rows == 0
    assert list(zip(*(got.column(c).to_pylist() for c in ("score", "lo", "hi")))) == [fold(*r) for r in rows]


def test_words_of_long_sequences(spark):
    """Words are cut in one walk: cut one by one each took a walk from the sequence's start, minutes for these."""
    rnd = random.Random(7)
    x = "".join(rnd.choices("ACGT", k=500_000))
    y = x[:250_000] + "N" + x[250_000:].replace("AAAA", "AACA")
    df = spark.createDataFrame([("s", 1, x), ("s", 2, y.lower()), ("s", 3, None), ("s", 4, "ACG"), ("t", 1, "é" * 12), ("t", 2, "É" * 15 + "N")], "set_id string, member int, seq string")
    began = time.time()
    got = {(r.set_id, r.a, r.b): (r.shared, r.total) for r in similarity.word_jaccard(df, 10).collect()}
    assert time.time() - began < 30
    p, q = ({z[i : i + 10] for i in range(len(z) - 9)} for z in (x, y))
    assert got == {("s", 1, 2): (len(p & q), len(p | q)), ("t", 1, 2): (1, 2)}


@pytest.mark.parametrize("columns", [1, 200, 1 << 20])
def test_seeds_by_groups(monkeypatch, columns):
    """Groups that come in several batches, many or one a step, give the diagonals of each pair once more or less often, and no other; equal members aren't paired."""
    import pyarrow as pa

    monkeypatch.setattr(similarity, "COLUMNS", columns)
    rnd = random.Random(11)
    rows, want = [], set()
    for s in range(8):
        own = [(k, m, rnd.randrange(2) if s % 2 else -1, "".join(rnd.choices("ACGTNé" if s == 3 else "ACT", k=rnd.randrange(25)))) for k, m in enumerate(sorted(rnd.choices("abcdef", k=6)))]
        rows += [(s, m, k == 0, min(x[0] for x in own if x[1] == m) + 1, o, x) for k, m, o, x in own]
        for _, m, o, x in own:
            for _, n, p, y in own:
                for strand, z in (("+", y), ("-", y[::-1].translate(str.maketrans("ACGT", "TGCA")))):
                    want |= {(s, m, n, strand, d) for d in diagonals(x, z, 4) if m < n and (o < 0 or o != p)}
    kinds = [pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["set_id", "member", "_new", "_rank", "_own", "seq"])
    batches = [batch.slice(k, 5) for k in range(0, len(rows), 5)]
    got = [tuple(r.values()) for b in similarity._by_groups(iter(batches), lambda *x: similarity._seed_diagonals(*x, k=4)) for r in b.to_pylist()]
    assert set(got) == want
    assert list(similarity._by_groups(iter([]), None)) == []


def test_seeds_shuffle_sequences(spark):
    """What is sorted by set is a row a sequence; before, each of the 991 words of a sequence was one."""
    df = spark.range(4).select(F.lit("s").alias("set_id"), "id", F.repeat(F.lit("ACGTTGCAAC"), 100).alias("seq")).withColumnRenamed("id", "member")
    plan = similarity.seeds(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "kmer" not in plan and "Window" in plan


def test_control_scores_are_written_once(spark):
    """Observed and null scores are read several times: from a table, not by searching again."""
    from regionpairs.plans import registry

    files = registry._control_scores(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not [f for f in files if "conversations" in f]


def test_flank_hits_cut_letters_once(spark, monkeypatch):
    """The letters of documents are worked out once, not for regions, flanks and members each."""
    from regionpairs.plans import registry

    real, asked, seen = flanks.hits, [], []
    monkeypatch.setattr(registry.V, "genome", lambda *x, of=registry.V.genome: asked.append(of(*x)) or asked[-1])
    monkeypatch.setattr(flanks, "hits", lambda regions, letters, *x, **y: seen.extend([*regions.inputFiles(), *letters.inputFiles()]) or real(regions, letters, *x, **y))
    assert registry.flank_hits(spark, "/root/testdata/sf0.001").columns[:3] == ["set_id", "a_region_id", "b_region_id"]
    assert len(asked) == 1 and seen and not [f for f in seen if "documents" in f]


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_shared_words_in_blocks(spark, block):
    """Sets of any number of blocks give the same pairs; rows that repeat a member are one member."""
    rnd = random.Random(13)
    rows = [(s, m, "".join(rnd.choices("ACGTN", k=rnd.randrange(90)))) for s in "st" for m in (1, 1, 2, 3, 4, 5)] + [("s", None, "ACGTACGT"), (None, 1, "ACGTACGT"), ("s", 9, None)]
    got = {(r.set_id, r.a, r.b): (r.shared, r.total, round(r.containment, 9)) for r in similarity.word_jaccard(spark.createDataFrame(rows, "set_id string, member int, seq string"), 3, block=block).collect()}
    words = {(s, m): {x[i : i + 3] for t, n, x in rows if (t, n) == (s, m) and x for i in range(len(x) - 2)} for s, m, _ in rows if s and m}
    want = {(s, a, b): (len(x & y), len(x | y), round(len(x & y) / min(len(x), len(y)), 9)) for (s, a), x in words.items() for (t, b), y in words.items() if s == t and a < b and x & y}
    assert got == want


def test_shared_words_of_many_letters_and_members():
    """Group, word and member make one number, also where that many of each would not fit it."""
    import pyarrow as pa

    rnd = random.Random(19)
    pool = ["".join(rnd.choices([chr(0x4E00 + i) for i in range(640)], k=6)) for _ in range(2000)]
    seqs = ["", *rnd.choices(pool, k=9_500)]
    rows = pa.table({"set_id": ["s"] * len(seqs), "member": range(len(seqs)), "_new": [i == 0 for i in range(len(seqs))], "_rank": range(1, len(seqs) + 1), "_own": [-1] * len(seqs), "seq": seqs})
    got = [tuple(r.values()) for b in similarity._by_groups(rows.to_batches(), lambda *x: similarity._shared_words(*x, k=4)) for r in b.to_pylist()]
    holders = {}
    for i, x in enumerate(seqs):
        for w in {x[j : j + 4] for j in range(len(x) - 3)}:
            holders.setdefault(w, []).append(i)
    shared = collections.Counter((i, j) for own in holders.values() for n, j in enumerate(own) for i in own[:n])
    assert sorted(got) == sorted(("s", i, j, n, 3, 3) for (i, j), n in shared.items())


def test_documents_sorted_as_letters(spark):
    """What is sorted by id is the letters of documents; before, whole texts were, and letters cut after that."""
    from regionpairs.plans import views as V

    plan = V.genome(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert [x for x in plan if "Aggregate" in x] and not [x for x in plan if "Aggregate" in x and ("regexp_replace" in x or "text" in x)]
    texts = [None, "", "acgt", "xAx", "Ünder Gärten\n\tTT\u2028c", "😀a😀😀gßt", "N" * 50 + "c", "...", "AC" * 30]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", V.letters("text").alias("seq")).orderBy("k").collect()
    assert [r.seq for r in got] == ["".join(c for c in (t or "").upper() if c in "ACGT") for t in texts]


@pytest.mark.parametrize("block", [2, 4096])
def test_search_is_segments_of_seeds(spark, block):
    """Segments found where words meet are those of the diagonals joined with their sequences, of any letters, each once; so with a bound on e-values."""
    rnd = random.Random(17)
    rows = [(s, m, "".join(rnd.choices("ACGTé" if s == "u" else "AC", k=rnd.randrange(70)))) for s in "stu" for m in range(7)] + [("v", 1, "A" * 50), ("v", 2, "a" * 70), ("v", 3, None), (None, 1, "A" * 20)]
    df = spark.createDataFrame(rows, "set_id string, member int, seq string")
    want = similarity.segments(similarity.seeds(df, 5), df)
    got = similarity.search(df, 5, block=block)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    want = similarity.with_e_values(want, 1e-4)
    assert sorted(map(tuple, similarity.search(df, 5, 1e-4, block).collect())) == sorted(map(tuple, want.collect())) != []


def test_hits_join_no_sequences(spark):
    """The hits of turns, as extra_copies and others take them, need one join, for the sizes of sets; before, words and diagonals were joined, these with both sequences."""
    from regionpairs.plans import registry

    plan = registry._hits(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
