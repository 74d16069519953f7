import random
import re

import pytest

from regionpairs.llm import jaccard_join as J


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def shingles(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, pct):
    sets = [(d, shingles(t, k)) for d, t in rows]
    of = {d: d for d, _ in sets}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= pct * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                of[hi] = lo
    return sorted((d, len(s), root(d)) for d, s in sets)


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["The", "É", "a,b"]
    passage = rnd.choices(vocab, k=30)
    out = []
    for _ in range(14):
        base = rnd.choices(vocab, k=rnd.choice([2, 3, 12, 40, 120]))
        if rnd.random() < 0.5:
            base = base + passage
        out.append(base)
        for _ in range(rnd.randrange(0, 9)):
            near = list(rnd.choice(out))
            for _ in range(rnd.randrange(0, 4)):
                near[rnd.randrange(len(near))] = rnd.choice(vocab)
            out.append(near)
    rows = [" ".join(x) for x in out] + ["", None, "  \n", "one", "One", "one two", passage and " ".join(passage)]
    rnd.shuffle(rows)
    return [(100 + 3 * i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed, k, pct, common, below, sent, block", [(1, 3, 90, 100, 2048, 9**9, 3), (2, 3, 90, 2, 2048, 9**9, 2048), (3, 5, 80, 3, 4, 9**9, 2), (4, 2, 60, 1, 2, 0, 4)])
def test_components_match_brute_force(spark, monkeypatch, seed, k, pct, common, below, sent, block):
    monkeypatch.setattr(J, "SENT", sent)
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "COMMON", common)
    monkeypatch.setattr(J, "ALL_BELOW", below)
    monkeypatch.setattr(J, "NEAREST", 1)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, key string")
    got = sorted(tuple(r) for r in J.link(docs, k, pct).collect())
    assert got == brute(rows, k, pct)


def test_empty_table_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (7, "a b c d")], "doc_id long, text string")
    assert sorted(((r.doc_id or -1), r.n_shingles, r.component_id) for r in J.link(docs, 3, 90).collect()) == [(-1, 2, None), (1, 2, 1), (1, 2, 1), (7, 2, 1)]
    twins = spark.createDataFrame([(1, "a b c d"), (1, "x y z u v"), (2, "a b c d"), (3, "x y z u v"), (4, "word " * 50_000)], "doc_id long, text string")
    got = sorted(tuple(r) for r in J.link(twins, 3, 90).collect())
    # one text counts for all rows of an id
    assert got in ([(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 3, 3), (4, 1, 4)], [(1, 3, 1), (1, 3, 1), (2, 2, 2), (3, 3, 1), (4, 1, 4)])
    assert J.link(docs.limit(0), 3, 90).count() == 0
    assert sorted(r.doc_id for r in J.one_of_each(docs.where("doc_id is not null"), 3, 90).collect()) == [1, 1]


def test_one_of_each_with_clashing_names(spark):
    """Helper names of any kind in the documents, and the order of their columns."""
    text = "one two three four five six seven"
    df = spark.createDataFrame([("x", 1, text, 0, 5, "a.b"), ("y", 2, text, 1, 6, "c"), ("z", None, text, 2, 7, "d")], "_extra string, doc_id long, text string, component_id int, n_shingles int, `key.x` string")
    got = jaccard_join.one_of_each(df)
    assert got.columns == df.columns and sorted(r["_extra"] for r in got.collect()) == ["x", "z"]
