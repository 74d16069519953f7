import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from regionpairs.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
ODD = ["", " ", "\n\n", "It's 'The'", "<|endoftext|>x <|ENDOFTEXT|>", "á H̱ İx", "  x\x85y\x1cz\x01 w", "naïve ÉtÉ ß", "ab" * 300, "가가", "!!!...'s've 123", "中文abc'll", "\U0001f600̀"]


def expected(text):
    ids = LIB.encode(text, add_special_tokens=False).ids
    return array("I", ids).tobytes(), LIB.decode(ids, skip_special_tokens=False).encode()


def random_texts(n, seed):
    rnd = random.Random(seed)
    parts = ["the", "and ", "'s", "'", "'ll", "x", "Z", "é", "́", "12", "!", "...", " ", "\n", " ", "<|endoftext|>", "中", "\U0001f600", "thinking", "qwrt", "ǅ", "İ"]
    return ["".join(rnd.choices(parts, k=rnd.randrange(1, 60))) for _ in range(n)]


def test_units_match_the_library():
    enc = bpe.Encoder(PATH)
    for some in (ODD, random_texts(3000, 1), random_texts(500, 1)):
        blobs = [t.encode() for t in some]
        flat, bounds = enc.encode(blobs)
        for t, ids, shown in zip(some, enc.ids(blobs), enc.decode(flat, bounds).to_pylist()):
            assert (ids, shown.encode()) == expected(t), repr(t)


@pytest.mark.parametrize("leaf", [1, 3, 7, 40])
def test_tree_of_unsplit_text(leaf):
    enc, rnd = bpe.Encoder(PATH), random.Random(leaf)
    some = ["".join(rnd.choices(["a", "b", "the", "ing", "'s", "'", "é", "́", "!", ".", "7", "中", "<|endoftext|>", "\U0001f600", "H̱"], k=80)) for _ in range(150)] + ["a" * 500, "the" * 200, "'" * 90]
    for t in some:
        got = enc.assemble([(p, x, enc.leaf(x) if p >= 0 else None) for p, x in enc.leaves(t, leaf)])
        assert got == expected(t)[0], repr(t)


@pytest.mark.parametrize("leaf", [1, 5, 40])
def test_tree_of_any_text(leaf):
    enc = bpe.Encoder(PATH)
    for t in [*ODD, *random_texts(600, leaf), "word and, " * 40 + "x" * 300 + " end."]:
        places, leaves = (list(x) for x in zip(*enc.leaves(t, leaf))) if t else ([], [])
        got = enc.assemble(list(zip(places, leaves, bpe.leaf_rows(enc, places, leaves))))
        assert got == expected(t)[0], repr(t)


def test_long_documents_go_through_the_tree(monkeypatch):
    import pyarrow.parquet as pq

    enc, joins, join = bpe.Encoder(PATH), [], bpe.Encoder.join
    monkeypatch.setattr(bpe.Encoder, "join", lambda self, a, b: joins.append(1) or join(self, a, b))
    long = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist() if t and len(t) > bpe.LEAF_CHARS]
    for t in long:
        places, leaves = zip(*enc.leaves(t, bpe.LEAF_CHARS))
        before = len(joins)
        assert enc.assemble(list(zip(places, leaves, bpe.leaf_rows(enc, list(places), list(leaves))))) == expected(t)[0]
        assert len(joins) - before == len(leaves) - 1 > 0
    assert long


def test_round_trip_of_documents(spark):
    rnd = random.Random(5)
    long = [" ".join(rnd.choices(["the", "of", "qwrtz", "it's", "\n", "x" * 50], k=400)), "ab'c" * 700, "word " * 300 + "zé" * 600 + "<|endoftext|>" + " end" * 90]
    rows = [(i, t, "x") for i, t in enumerate([*ODD, *random_texts(40, 3), *long, *long])] + [(999, None, "x"), (5, ODD[5], "x"), (None, long[0], "x"), (None, long[0], "x"), (None, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.round_trip(docs, PATH, leaf_chars=200).collect()
    known = lambda i: -1 if i is None else i
    assert sorted((known(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == sorted((known(i), *expected(t or "")) for i, t, _ in rows)
    assert bpe.digests(bpe.round_trip(docs.limit(0), PATH)).count() == 0
