import itertools
import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from regionpairs.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "\n", "  a", "a  b   c\n\n d\t", "it's we'll 'tis", "x" * 5000, "a <|endoftext|> b<|endoftext|>", "<|endoftext|>", "ünï cödé  x", "a  b", "a　　 b \u0085\n c", "1234 56,7.8 !! ..", "a\x1c b\x00 c", "日本 語\n\n\n文",
    "word " * 3000, "\r\n\r\n x \r", "é ́ a", " ", "   ",
]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def want_ids(lib, text):
    return [*lib.encode(text or "", add_special_tokens=False).ids, 0]


def check(lib, docs, sequences, capacity=1024):
    """Every id in one piece, ids as the library's, no gap or overlap; returns (padding, sequences)."""
    texts, pieces, padding = dict(docs), defaultdict(list), 0
    for s in sequences:
        ids, at = array("I", bytes(s.ids)), 0
        assert 0 < len(ids) <= capacity and s.padded_to == (len(ids) if len(ids) & (len(ids) - 1) == 0 else capacity)
        for p in s.pieces:
            assert p.offset == at and p.length > 0
            pieces[p.doc_id].append((p.start, ids[at : at + p.length].tolist(), p.doc_tokens))
            at += p.length
        assert at == len(ids)
        padding += s.padded_to - len(ids)
    assert len({s.sequence_id for s in sequences}) == len(sequences) and set(pieces) == set(texts)
    for i, t in docs:
        got = sorted(pieces[i])
        ids = want_ids(lib, t)
        assert [x for _, p, _ in got for x in p] == ids and {n for _, _, n in got} == {len(ids)}
        assert [s for s, _, _ in got] == list(itertools.accumulate((len(p) for _, p, _ in got[:-1]), initial=0))
    return padding


def test_encoder_is_the_library(lib):
    enc, rnd = packing.Encoder(PATH), random.Random(1)
    some = ODD + ["".join(rnd.choices(["a", "the", " ", "  ", "\n", ".", "'s", "é", " ", "9", "<|endoftext|>", " "], k=rnd.randrange(60))) for _ in range(2000)]
    for run in (some, some[::-1], [""], []):
        flat, bounds = enc.encode([t.encode() for t in run])
        assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [lib.encode(t, add_special_tokens=False).ids for t in run]


def test_closest_against_all_multisets():
    rnd = random.Random(2)
    for _ in range(400):
        counts = {rnd.randrange(1, 30): rnd.randrange(0, 4) for _ in range(rnd.randrange(0, 5))}
        room = rnd.randrange(0, 50)
        sums = {sum(x * n for x, n in zip(counts, ns)) for ns in itertools.product(*(range(n + 1) for n in counts.values()))}
        total, taken = packing.closest(counts, room)
        assert total == max(s for s in sums if s <= room) == sum(x * n for x, n in taken.items())
        assert all(n <= counts[x] for x, n in taken.items())


def test_pack(spark, lib):
    rnd = random.Random(3)
    docs = list(enumerate(ODD + [None] + [" ".join(rnd.choices(["of", "zqx", "thing\n", "é", "Word"], k=rnd.randrange(0, 900))) for _ in range(300)]))
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, ids string, start int")
    for frame, hold in ((df.repartition(3), 1 << 20), (df.coalesce(1), 5000)):
        got = packing.pack(frame, PATH, hold=hold).collect()
        assert check(lib, docs, got) == 0
        assert sum(s.padded_to < 1024 for s in got) <= 10 * frame.rdd.getNumPartitions()
    assert check(lib, docs, packing.pack(df.coalesce(1), PATH, capacity=64).collect(), 64) == 0
    rows = packing.digests(packing.pack(df.coalesce(2), PATH)).collect()
    for r in rows:
        ids = want_ids(lib, dict(docs)[r.doc_id])
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(array("I", ids[r.start : r.start + r.length]).tobytes())


def test_few_cuts(spark, lib):
    """Documents shorter than a window stay whole but for a few at a partition's end."""
    rnd = random.Random(4)
    docs = [(i, "a b" * rnd.randrange(1, 200)) for i in range(2000)]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), PATH).collect()
    assert check(lib, docs, got) == 0
    assert sum(len(s.pieces) for s in got) <= len(docs) + 12


def test_odd_tables(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, "")], "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id or 0, r.length, r.doc_tokens) for r in packing.digests(packing.pack(twice, PATH)).collect()) == [(0, 3, 3), (0, 3, 3), (1, 1, 1), (1, 1, 1)]
    with pytest.raises(ValueError):
        packing.pack(twice, PATH, capacity=1000)
