import math
import random
import re
import zlib
from collections import Counter

import pytest

from regionpairs.llm import brown_lm, quality, toxicity, url_filter


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def corpus(n, seed):
    rnd = random.Random(seed)
    langs = [["the", "a", "dog", "cat", "runs", "Sees", "x1"], ["der", "die", "hund", "katze", "läuft", "sieht", "y1"]]
    return [(i, " ".join(rnd.choice(langs[i % 2]) if rnd.random() < 0.9 else f"r{rnd.randrange(300)}" for _ in range(rnd.randrange(0, 60)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "\n\t "), (0, "the dog")]


@pytest.mark.parametrize("frequent, held", [(5, 8), (50, 60), (0, 0)])
def test_brown_scores(spark, frequent, held):
    rows = corpus(150, 1)
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double")
    got = [r.asDict() for r in brown_lm.score(docs, frequent, held, classes=4).collect()]
    assert len(got) == len(rows)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    out = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter()
    for d, t in rows:
        if not out(d):
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    want = {}
    for d, t in rows:
        w = [*words(t), None]
        want.setdefault(d, []).append((out(d), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    for d in want:
        mine = sorted((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got if r["doc_id"] == d)
        assert [x[:4] for x in mine] == [x[:4] for x in sorted(want[d])]
        assert [x[4] for x in mine] == pytest.approx([x[4] for x in sorted(want[d])])
    if frequent == 50:  # held-out texts are likelier than under the base
        assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def test_brown_model_is_a_distribution(spark):
    """Summed over all known words and the unknown ones of each ending, the probability of a token after the start is 1."""
    rows = corpus(150, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table, m = brown_lm.fit(docs, 20, 25, 4)
    units = brown_lm.Units(m["frequent"], m["own"])
    total = 0.0
    for r in table.collect():
        w = bytes(r.word)
        u = 0 if w == brown_lm.END else units([w])[0]
        p = 10 ** (m["trans"][m["classes"][0], m["classes"][u]] + m["within"][u])
        if u >= units.base and u < units.n:
            assert r.ending == brown_lm.ending(w) == u - units.base
            p *= (r.c - m["discount"]) / m["ending_n"][u - units.base]
        total += p
    for e in range(brown_lm.ENDINGS):
        u = units.base + e
        total += 10 ** (m["trans"][m["classes"][0], m["classes"][u]] + m["within"][u] + m["unknown"][e])
    assert total == pytest.approx(1, abs=1e-6)


def test_brown_spelling_is_a_distribution():
    """Over all words of an ending, the spelling's probabilities sum to that ending's share; the shares sum to 1."""
    import itertools

    import numpy as np

    symbol, share = np.ones(256, np.int64), np.zeros(256)
    symbol[[*b" ab"]], share[[*b" ab"]] = [0, 2, 3], 1
    share[[*b"cd"]] = 0.5  # of one symbol
    n = np.zeros((4, 4, 4))
    for w in ("ab", "abc", "b", "dab", "bb", "cc", "a"):
        g = [0, 0, *symbol[[*w.encode()]], 0]
        for k in range(len(g) - 2):
            n[tuple(g[k : k + 3])] += 3
    m = brown_lm.Spelling(symbol, share, n)
    shares = m.ending_shares()
    assert shares.sum() == pytest.approx(1)
    words = [bytes(w) for k in range(1, 9) for w in itertools.product(b"abcd", repeat=k)]
    q = 10 ** m.logs(words)
    found = np.bincount([brown_lm.ending(w) for w in words], weights=q, minlength=brown_lm.ENDINGS)
    assert found.sum() > 0.97 and (found <= shares + 1e-9).all() and abs(found - shares).sum() < 0.04
    for w, x in zip(words[:100], q):
        g = [0, 0, *symbol[[*w]], 0]
        assert x == pytest.approx(math.prod(m.p[tuple(g[k : k + 3])] for k in range(len(g) - 2)) * math.prod(share[[*w]]))


@pytest.mark.parametrize("frequent, held", [(5, 8), (50, 0), (0, 400)])
def test_brown_score_token_by_token(spark, frequent, held):
    rows = corpus(150, 6) + [(None, "the dog qqq läuftx"), (None, "word " * 3000 + "the " * 40_000), (900, "zzz zzz r1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    scored = brown_lm.score(docs, frequent, held, classes=4).collect()
    table, m = brown_lm.fit(docs, frequent, held, classes=4)
    counts = {bytes(r.word): r.c for r in table.collect()}
    units = brown_lm.Units(m["frequent"], m["own"])
    assert m["ending_n"].sum() == sum(c for w, c in counts.items() if w != brown_lm.END and units.is_ending(units([w])[0]))

    def expected(t):
        total, last = 0.0, 0
        for w in [*(lower(t).encode().split()), brown_lm.END]:
            u = 0 if w == brown_lm.END else int(units([w])[0])
            total += m["trans"][m["classes"][last], m["classes"][u]] + m["within"][u]
            if units.is_ending(u):
                c = counts.get(w, 0)
                total += math.log10((c - m["discount"]) / m["ending_n"][u - units.base]) if c else brown_lm.unknown_words([w], m)[0]
            last = u
        return total

    want = sorted((-1 if d is None else d, round(float(expected(t)), 3)) for d, t in rows)
    got = sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 3)) for r in scored)
    assert [d for d, _ in got] == [d for d, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want], abs=0.01)


def test_exchange_finds_the_best_move():
    import numpy as np

    rnd = np.random.default_rng(1)
    counts = rnd.integers(0, 9, (12, 12))

    def value(of, k):
        pair = np.zeros((k, k))
        for a in range(12):
            for b in range(12):
                pair[of[a], of[b]] += counts[a, b]
        h = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return h(pair) - h(pair.sum(0)) - h(pair.sum(1))

    of = brown_lm.exchange(counts, 4, 20)
    assert of[0] == 0 and (of[1:] > 0).all()
    best = value(of, 4)
    for u in range(1, 12):
        for c in range(1, 4):
            other = of.copy()
            other[u] = c
            assert value(other, 4) <= best + 1e-6


def test_gains_of_moves():
    import numpy as np

    rnd, n, k = np.random.default_rng(3), 30, 6
    counts, of = rnd.integers(0, 4, (n, n)), np.concatenate([[0], rnd.integers(1, k, n - 1)])
    of[[1, 2, 3, 4, 5]] = [1, 2, 3, 4, 5]

    def pairs(of):
        member = np.eye(k)[of]
        return member.T @ counts @ member

    own, m = np.diag(counts).astype(float), np.arange(n)
    a, b = (counts @ np.eye(k)[of]), (counts.T @ np.eye(k)[of])
    a[m, of] -= own
    b[m, of] -= own
    got = brown_lm.gains(a, b, own, of, pairs(of))
    for u in range(1, n):
        for c in range(1, k):
            other = of.copy()
            other[u] = c
            assert got[u, c] == pytest.approx(brown_lm.information(pairs(other)) - brown_lm.information(pairs(of)), abs=1e-6)


@pytest.mark.parametrize("split", [1 << 20, 7])
def test_brown_clusters_words_beyond_the_frequent(spark, monkeypatch, split):
    """Words of one kind get a class of their own whatever their ending, though only three words are in the first exchange."""
    monkeypatch.setattr(brown_lm, "SPLIT", split)
    rnd = random.Random(9)
    nouns, verbs = [f"n{i}{e}" for i, e in enumerate("abcdefghij" * 4)], [f"v{i}{e}" for i, e in enumerate("abcdefghij" * 4)]
    rows = [(i, " ".join(f"{rnd.choice(['the', 'a', 'my'])} {rnd.choice(nouns)} {rnd.choice(verbs)}" for _ in range(12))) for i in range(200)]
    _, m = brown_lm.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 50, 4, tolerance=0)
    find = brown_lm.Units(m["frequent"], m["own"])
    units = {w: int(find([w.encode()])[0]) for w in nouns + verbs}
    assert sorted(m["frequent"]) == sorted(brown_lm.hashes([b"a", b"my", b"the"])) and len(m["own"]) == 80 and not set(units.values()) & set(range(find.n))
    # no single move gains any more
    train = [w for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 1 for w in ["", *t.split()]] + [""]
    u = [int(find([w.encode()])[0]) if w else 0 for w in train]
    of, k = m["classes"].astype(int), int(m["classes"].max()) + 1

    def value(of):
        import numpy as np

        pair = np.zeros((k, k))
        for (x, y), n in Counter(zip(u, u[1:])).items():
            pair[of[x], of[y]] += n
        return brown_lm.information(pair)

    best = value(of)
    for x in rnd.sample(sorted(set(u) - {0}), 12):
        for c in range(1, k):
            other = of.copy()
            other[x] = c
            assert value(other) <= best + 1e-3
    assert len({of[units[w]] for w in nouns}) == 1 and len({of[units[w]] for w in verbs}) == 1


def test_brown_on_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert brown_lm.score(docs.limit(0)).count() == 0
    only_held_out = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = brown_lm.score(spark.createDataFrame([(only_held_out, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0)
    assert r.base_score == pytest.approx(0)


def test_quality_estimate_against_plain_em():
    """Document by document, with dictionaries: the same prior, tables and posteriors as over counted patterns."""
    import numpy as np

    rnd = random.Random(12)
    k = len(quality.LABELLERS)
    docs = []
    for _ in range(400):
        good = rnd.random() < 0.75
        docs.append(tuple((1 if good else -1) * (1 if rnd.random() < 0.8 else -1) if rnd.random() < 0.7 else 0 for _ in range(k)))
    prior, table = quality.estimate(sorted(Counter(docs).items()), rounds=20)
    start = {(-1, 0): 0.4, (-1, 1): 0.01, (1, 0): 0.6, (1, 1): 0.99}
    t, pr = [dict(start) for _ in range(k)], 0.8
    weight = 0.001 * len(docs) + 1

    def posterior(v):
        p = [1 - pr, pr]
        for j, x in enumerate(v):
            if x:
                p = [p[c] * t[j][x, c] for c in (0, 1)]
        return p[1] / (p[0] + p[1])

    for _ in range(20):
        good = [posterior(v) for v in docs]
        pr = min(0.99, max(0.01, (sum(good) + 1) / (len(docs) + 2)))
        new = []
        for j in range(k):
            n = {(x, c): weight * start[x, c] + sum((g if c else 1 - g) for v, g in zip(docs, good) if v[j] == x) for x in (-1, 1) for c in (0, 1)}
            new.append({(x, c): n[x, c] / (n[-1, c] + n[1, c]) for x, c in n})
        t = new
    assert prior == pytest.approx(pr)
    for j in range(k):
        for x in (-1, 1):
            assert list(table[j][x + 1]) == pytest.approx([t[j][x, 0], t[j][x, 1]])
    got = quality._posterior(np.array(docs) + 1, prior, table)
    assert list(got) == pytest.approx([posterior(v) for v in docs])


def test_quality_of_null_ids_and_long_texts(spark):
    rows = [(None, "the river and the garden of stone " * 50), (None, None), (1, "%%% &&& " * 60_000), (1, "of the and " * 40_000), (2, "")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, votes string")
    got = quality.score(docs).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == [-1, -1, 1, 1, 2] and all(0 <= r.score <= 1 for r in got)
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(docs).count() == sum(r.keep for r in got)


def test_quality(spark):
    rnd = random.Random(4)
    good = lambda: " ".join(rnd.choices(["the", "of", "and", "house", "river", "walked", "slowly", "in", "garden", "a", "bright", "morning", "was", "stone"], k=90)) + " " + " ".join(f"word{rnd.randrange(900)}" for _ in range(90))
    bad = [lambda: " ".join(f"w{rnd.randrange(99)}%%%&&&" for _ in range(80)), lambda: " ".join(["SHOUT!!", "LOUD!!", "NOW!!", f"N{rnd.randrange(99)}!!"] * 30), lambda: " ".join([f"same{rnd.randrange(9)}"] * 200)]
    rows = [(i, good(), 1) for i in range(240)] + [(1000 + i, bad[i % 3](), 0) for i in range(60)]
    docs = spark.createDataFrame([*rows, (5000, None, 1), (5001, "", 1), (0, rows[0][1], 1)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in quality.score(docs).collect()}
    assert sum(got[d].keep for d, _, y in rows if y) >= 238
    assert sum(got[d].keep for d, _, y in rows if not y) <= 2
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.where("doc_id between 0 and 239").count() >= 239
    assert quality.score(docs.limit(0)).count() == 0


def test_toxicity(spark):
    rnd = random.Random(5)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnopqrst"] + ["the", "you", "not", "said"]
    text = lambda: [rnd.choice(words).replace("w", rnd.choice(["", "s", "t"])) for _ in range(rnd.randrange(10, 60))]
    rows = []
    for i in range(700):
        t, toxic = text(), int(rnd.random() < 0.3)
        for _ in range(3 * toxic):
            t.insert(rnd.randrange(len(t)), rnd.choice(["scumbag", "moronic", "zorplex", "zorplium", "zorplet", "zorplok", "zorplas", "zorplun", "zorplik"]))
        rows.append((i, " ".join(t) + ".", toxic))
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in rows] + [(9000, None, "x"), (9001, "", "x"), (None, "you zorplex " * 20_000, "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(d, 1, y) for d, _, y in rows] + [(3, 1, rows[3][2]), (None, 1, 1), (77777, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    held = [(got[d].predicted, y) for d, _, y in rows if got[d].held_out]
    assert len(held) > 80 and sum(p == y for p, y in held) >= 0.97 * len(held)
    assert got[9000].predicted == 0 and 0 <= got[9001].score <= 1 and got[None].held_out is False and got[None].predicted == 1
    assert {r.predicted for r in toxicity.score(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.score(docs.limit(0), labels).count() == 0


LEX = lambda: toxicity.Lexicon({"idiot": 5.0}, {"zorpl": 4.0})


@pytest.mark.parametrize(
    "text, events",
    [
        ("what an idiot.", {"insult": 1}), ("You are an Idiot! Fine.", {"targeted insult": 1}), ("he is not an idiot", {"negated insult": 1}), ("that is not really such a big idiot", {"negated insult": 1}),
        ('she said "idiot" and left', {"reported insult": 1}), ('he said: "you idiot"', {"reported insult": 1}), ("he said you are an idiot", {"reported insult": 1}), ("I said you are an idiot", {"targeted insult": 1}),
        ('he said "go" and you idiot went', {"targeted insult": 1}), ("he said so. You idiot", {"targeted insult": 1}), ("I will kill you", {"targeted threat": 1}), ("I won't kill you", {"negated threat": 1}), ("I can’t kill you", {"negated threat": 1}),
        ("you didn't kill him", {"negated threat": 1}), ("she wrote that they will hurt him", {"reported threat": 1}), ("kill the process", {}), ("beat the eggs", {}), ("you kill the process", {}), ("a zorplok; nidiot skillet", {"insult": 1}), ("", {}),
    ],
)
def test_grammar(text, events):
    assert dict(toxicity.matches(text, LEX())[0]) == events


def test_grammar_against_a_plain_reading():
    """Random clauses, read word by word with plain variables."""
    rnd, lex = random.Random(7), LEX()
    vocab = ["idiot", "zorplum", "kill", "töten", "dich", "you", "him", "i", "not", "won't", "said", '"', "the", "tree", "walks", "we"]
    for _ in range(4000):
        words = rnd.choices(vocab, k=rnd.randrange(1, 14))
        want: Counter = Counter()
        scope, told, quoted, own, target = 0, False, False, False, False
        for k, w in enumerate(words):
            after = any(x in ("you", "him", "dich") for x in words[k + 1 :])
            near = any(x in ("you", "him", "dich") for x in words[k + 1 : k + 4])
            bad = "insult" if w in ("idiot", "zorplum") else "threat" if (w == "kill" and near) or (w == "töten" and (near or "dich" in words[:k])) else None
            if bad:
                want[("negated " if scope else "reported " if told else "targeted " if target or after or bad == "threat" else "") + bad] += 1
            scope = toxicity.SCOPE if w in ("not", "won't") else max(0, scope - 1)
            if told:
                if w == '"':
                    told, quoted = not quoted, not quoted
            elif w == "said" and not own:
                told, quoted = True, False
            own = not told and w in ("i", "we")
            target = target or w in ("you", "him", "dich")
        assert toxicity.matches(" ".join(words), lex)[0] == want, words


def test_urls(spark):
    import duckdb

    urls = [None, "", "org/", "http://A.Org/x", "https://example.org/es/1", "https://x.Example.org/en/12?q#f", "http://notexample.org/es/", "http://com/fr/", "ftp://b.com/de/x", "http://b.com?/de/", "x://a.b.c.com/fr/#", "://org/", "http://example.org:80/es/", "http://example.org/en/2", "a://b://org/x", "http://ex.org"]
    pages = spark.createDataFrame([(i % 14, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = sorted(map(repr, (tuple(r) for r in url_filter.judge(pages, url_filter.rules_table(spark)).collect())))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [(i % 14, u) for i, u in enumerate(urls)])
    assert got == sorted(map(repr, con.execute(url_filter.ORACLE).fetchall()))
    assert url_filter.judge(pages.limit(0), url_filter.rules_table(spark)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, url_filter.rules_table(spark).limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("text", [
    "I will kill you", "we are going to hurt all of you", "Ich werde dich töten", "ich werde euch alle umbringen", "ich will dich schlagen", "je vais te tuer", "je vais vous détruire", "je vais tuer toi", "Te voy a matar",
    "os vamos a golpear", "te quiero destruir",
])
def test_threats_in_four_languages(text):
    assert dict(toxicity.matches(text, LEX())[0]) == {"targeted threat": 1}


@pytest.mark.parametrize("text", ["kill the process", "beat the eggs for her", "Ich will die Zeit töten", "Sie schlagen Eier", "je vais tuer le temps", "voy a matar el tiempo", "quemar la leña", "brûler du bois", "Te veo. Voy a matar el tiempo"])
def test_no_threats_in_four_languages(text):
    assert not toxicity.matches(text, LEX())[0]


@pytest.mark.parametrize("text, event", [("je ne vais pas te tuer", "negated"), ("ich werde dich nicht töten", "negated"), ("Sie sagte, sie werde dich töten", "reported"), ("dijo te voy a matar", "reported")])
def test_weakened_threats(text, event):
    assert dict(toxicity.matches(text, LEX())[0]) == {f"{event} threat": 1}


def plain_inputs(text):
    """The scorer's inputs, worked out letter by letter and word by word: {bucket: value}."""
    blob, x = text.encode(), Counter()
    if len(blob) > 1:
        pairs = Counter((((a * 256 + b) * 2654435761) % 2**32) >> 22 for a, b in zip(blob, blob[1:]))
        x.update({k: math.sqrt(n / (len(blob) - 1)) for k, n in pairs.items()})
    words, size = blob.split(), max(1, len(blob))
    n = max(1, len(words))
    letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in blob) + (not blob)
    capitals = sum(65 <= b <= 90 for b in blob) + (not blob)
    symbols = sum(33 <= b <= 126 and not chr(b).isalnum() and chr(b) not in ".,'\"-()" for b in blob) + (not blob)
    runs = [words[k : k + 400] for k in range(0, max(1, len(words)), 400)]
    lines = [x for x in blob.split(b"\n") if x.strip()]
    m = {
        "words": len(words), "symbols": symbols / size, "capitals": capitals / max(1, letters), "function_words": sum(w in quality.FUNCTION_WORDS for w in words) / n,
        "variety": sum(len(set(r)) / max(1, len(r)) for r in runs) / len(runs), "stutter": sum(a == b for a, b in zip(words, words[1:])) / n,
        "bare_tokens": sum(w in (b"|", b"-", b"*", b"#") for w in words) / n, "word_length": size / n, "lines": 1 - len(set(lines)) / max(1, len(lines)),
    }
    length = "few" if len(words) < 20 else "some" if len(words) < 60 else "many"
    for k, v in m.items():
        step = int(math.log2(v + 1)) if k == "words" else int(v) if k == "word_length" else int(min(0.999, v) * 20)
        x[zlib.crc32(f"{length} {k}={step}".encode()) % 1024] += 1
    return m, x


def test_quality_scorer_against_a_plain_one(spark):
    """Posterior labels, the trained scorer and what it keeps, with Python's numbers on dictionaries."""
    rnd = random.Random(9)
    texts = ["", None, "A", "!!!! #### $$$$ | | |", "the the the the", "x\n" * 90]
    texts += [" ".join(rnd.choices(["the", "of", "and", "tree", "walks", "BIG", "##", "|", "é"], weights=[3, 2, 2, 2, 2, *rnd.choice([(0, 0, 0, 1), (5, 9, 9, 0)])], k=rnd.randrange(1, 90))) for _ in range(70)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [plain_inputs(t or "") for t in texts]
    votes = [quality.votes(m) for m, _ in rows]
    prior, table = quality.estimate(sorted(Counter(votes).items()))
    y = []
    for v in votes:
        bad, good = 1 - prior, prior
        for j, x in enumerate(v):
            bad, good = bad * table[j][x + 1][0], good * table[j][x + 1][1]
        y.append(good / (bad + good))
    w, vw, b, vb, n = [0.0] * 1024, [0.0] * 1024, 0.0, 0.0, len(rows)
    used = sorted({k for _, x in rows for k in x})
    for _ in range(400):
        e = [1 / (1 + math.exp(-(sum(w[k] * a for k, a in x.items()) + b))) - t for (_, x), t in zip(rows, y)]
        grad = Counter()
        for (_, x), d in zip(rows, e):
            for k, a in x.items():
                grad[k] += a * d / n
        for k in used:
            vw[k] = 0.9 * vw[k] - 0.5 * (grad[k] + 1e-4 * w[k])
            w[k] += vw[k]
        vb = 0.9 * vb - 0.5 * sum(e) / n
        b += vb
    want = [1 / (1 + math.exp(-(sum(w[k] * a for k, a in x.items()) + b))) for _, x in rows]
    got = {r.doc_id: r for r in quality.score(docs).collect()}
    assert [got[k].score for k in range(n)] == pytest.approx(want, abs=1e-3) and [tuple(got[k].votes) for k in range(n)] == votes
    clear = [k for k in range(n) if abs(want[k] - 0.5) > 2e-3]
    assert {k for k in clear if got[k].keep} == {k for k in clear if want[k] >= 0.5} and 0 < sum(got[k].keep for k in clear) < len(clear)
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {k for k in range(n) if got[k].keep}
