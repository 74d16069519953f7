import hashlib
import random

import pytest

from regionpairs.llm import line_dedup as L


def brute(rows, min_words):
    """Every run with an earlier copy, by comparing all positions."""
    docs = sorted({(d, t or "") for d, t in rows}, key=lambda x: x[0])
    seqs = [(d, t, [x for x in t.encode().split(b"\n") if x.strip()]) for d, t in docs]
    pos = [(k, i) for k, (_, _, s) in enumerate(seqs) for i in range(len(s))]
    out = {}
    for k, (d, t, s) in enumerate(seqs):
        gone = set()
        for i in range(len(s)):
            best = 0
            for k2, i2 in pos:
                if (k2, i2) < (k, i):
                    n, s2 = 0, seqs[k2][2]
                    while i + n < len(s) and i2 + n < len(s2) and s[i + n] == s2[i2 + n]:
                        n += 1
                    best = max(best, n)
            if sum(len(x.split()) for x in s[i : i + best]) >= min_words:
                gone |= set(range(i, i + best))
        left, n = [], 0
        for x in t.encode().split(b"\n"):
            if x.strip():
                n += 1
                if n - 1 in gone:
                    continue
            left.append(x)
        left = b"\n".join(left)
        out[d, t] = (len(s), len(gone), sum(len(s[i].split()) for i in gone), len(left), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("seed, min_words", [(1, 1), (2, 4), (3, 7)])
def test_runs_match_brute_force(spark, seed, min_words):
    rnd = random.Random(seed)
    pool = ["a", "b c", "d e f", "x y z w v", "é", "b c ", ""]
    rows = [(10 * k - 30, "\n".join(rnd.choices(pool, k=rnd.randrange(0, 14)))) for k in range(16)]
    rows += [(500, None), (501, ""), (502, "\n".join(["q r"] * 21)), (503, rows[3][1]), (504, "\n\n".join(["x y z w v", "d e f"])), (504, "\n\n".join(["x y z w v", "d e f"]))]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, i int, words int")
    want = brute(rows, min_words)
    got = sorted(tuple(r) for r in L.report(docs, min_words).collect())
    assert got == sorted((d, *want[d, t or ""]) for d, t in rows)


def test_dedup_keeps_columns_and_drops_what_is_empty(spark):
    docs = spark.createDataFrame([(1, "one two three\nfour five", "en", 23), (2, "one two three", "en", 13), (3, "new line\none two three", "de", 22), (4, None, "en", 0), (5, "", "en", 0)], "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: tuple(r)[1:] for r in L.dedup(docs, 3).collect()}
    assert got == {1: ("one two three\nfour five", "en", 23), 3: ("new line", "de", 8), 4: (None, "en", 0), 5: ("", "en", 0)}
    assert L.dedup(docs.limit(0), 3).count() == 0


def test_null_ids_clashing_names_and_long_texts(spark):
    long = "\n".join(f"line number {k} of many lines" for k in range(20_000))
    rows = [(None, long, 1, 2, "p"), (7, long, 1, 2, "q"), (7, "other words here\nand there", 3, 4, "r"), (None, "other words here\nand there", 5, 6, "s"), (9, "own", 0, 0, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a int, spans int, `x.y` string")
    got = L.dedup(docs, 4)
    assert got.columns == docs.columns
    assert sorted((r.a, r.text) for r in got.collect()) == sorted((r[2], r[1]) for r in rows if r[4] in "pst")
    assert {(r.doc_id, r.n_lines, r.n_cut) for r in L.report(docs, 4).collect()} == {(None, 20_000, 0), (7, 20_000, 20_000), (None, 2, 0), (7, 2, 2), (9, 1, 0)}
