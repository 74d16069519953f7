import hashlib
import random
import re
import zlib
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from regionpairs.llm import decontaminate, media, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "a", "x" * 576, "RIFF BM GIF89a .snd", "ü" * 700, "long " * 9000, None, "a", "é" * 1_500_000]


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string")


def test_media_round_trip(spark):
    got = {r.doc_id: r for r in media.inspect(media.pack(docs_of(spark, TEXTS)), ["doc_id", "n_bytes", "declared"]).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        p = media.payload(b)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])), i
        assert r.offset == 0 and r.corrected == (r.sniffed != r.declared) and r.feature
    assert got[1].media_sha256 == got[7].media_sha256 and got[1].feature == got[7].feature
    assert media.inspect(media.pack(docs_of(spark, TEXTS).limit(0)), ["doc_id"]).count() == 0
    twice = spark.createDataFrame([(None, "a"), (None, "a"), (4, "b"), (4, "c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_bytes) for r in media.inspect(media.pack(twice), ["doc_id", "n_bytes"]).collect()) == [(0, 1), (0, 1), (4, 1), (4, 1)]


def test_media_is_carved_from_other_bytes():
    rnd = random.Random(1)
    for kind in media.STORED:
        file = media.store(media.payload(bytes(rnd.randrange(256) for _ in range(1000))), kind)
        blob = b"BM junk RIFF" + file + b".snd tail" + media.store(media.payload(b"x"), "image/png")
        assert media.sniff(blob)[0] == (kind, 12, len(file))
        assert media.sniff(blob)[-1][0] == "image/png"
        assert not [x for x in media.sniff(file[:-1]) if x[1] == 0]
    gif = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff!\xf9\x04\x01\0\0\0\0,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    assert media.sniff(b"zz" + gif + b"z") == [("image/gif", 2, len(gif))]
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04cd12\xff\x00" + b"34\xff\xd9"
    assert media.sniff(jpeg + b"..") == [("image/jpeg", 0, len(jpeg))]


def test_media_of_odd_blobs(spark):
    df = spark.createDataFrame([(1, "image/png", b""), (2, None, None), (3, "x", bytearray(b"BMBMRIFF"))], "doc_id long, declared string, media binary")
    assert {(r.sniffed, len(r.embedded)) for r in media.inspect(df, ["doc_id"]).collect()} == {(None, 0)}


def test_token_files(spark, tmp_path):
    lib, rnd = Tokenizer.from_file(PATH), random.Random(2)
    some = [" ".join(rnd.choices(["the", "of", "zqx", "thing", "\n", "é"], k=rnd.randrange(0, 90))) for _ in range(300)]
    some += [None, "", some[0], "w " * 5000]
    docs = docs_of(spark, some, start=-20)
    folder = token_files.write(docs, PATH, 1, to=str(tmp_path / "t"), shard_docs=64, segment_bytes=2000)
    want, start = {}, 0
    for i, t in enumerate(some):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want[i - 20] = (start, len(ids), zlib.crc32(array("I", ids).tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.digests(spark, folder).collect()}
    assert got == want
    assert token_files.lookup(spark, folder, 3) == [*lib.encode(some[23], add_special_tokens=False).ids, 1]
    empty = token_files.write(docs.limit(0), PATH, 1, to=str(tmp_path / "e"))
    assert token_files.digests(spark, empty).count() == 0


def brute(docs, items, window=10):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    pats = []
    for i, t in items:
        w = rx.findall(low(t))
        m = min(window, len(w))
        pats += [(i, tuple(w[k : k + m])) for k in range(len(w) - m + 1)] if m else []
    for d, t in docs:
        w = rx.findall(low(t))
        hit, got = set(), set()
        for i, p in pats:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    got.add(i)
        yield d, (len(w), len(hit), len(got), decontaminate.sha_of(got), bool(hit))


def test_decontamination(spark):
    rnd = random.Random(3)
    word = lambda n: " ".join(rnd.choices(["a", "b", "The", "c,d", "É", "x9", "-"], k=n))
    items = [(i, word(rnd.choice([1, 3, 4, 12, 15, 30]))) for i in range(12)] + [(100, None), (101, "--"), (102, "b"), (103, word(25)), (104, "zz zz zz zz zz zz zz zz zz zz zz")]
    items.append((105, items[3][1]))
    texts = [word(rnd.randrange(0, 60)) for _ in range(60)] + [None, "", word(700)] + [word(5) + " " + rnd.choice(items)[1] + " " + word(5) for _ in range(20) if True and items[0][1]] + ["zz " * 40]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = dict(brute(enumerate(texts), items))
    for some in ({}, {"block_words": 60}):
        got = {r.doc_id: tuple(r)[1:] for r in decontaminate.report(decontaminate.find(docs, bench, **some)).collect()}
        assert got == want
    assert decontaminate.find(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontaminate.report(decontaminate.find(docs, bench.limit(0))).collect()} == {0}


@pytest.mark.parametrize("some", [{}, {"block_words": 20}])
def test_decontamination_removes_rows_not_ids(spark, some):
    item = " ".join(f"k{i}" for i in range(30))
    rows = [(None, f"a {item} b"), (None, "clean"), (1, f"{item}"), (1, "clean twin"), (2, None), (3, ""), (4, "c " + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, item if k == 3 else f"other {k}") for k in range(8)], "item_id long, text string")
    left = decontaminate.remove(docs, bench, **some)
    assert left.columns == docs.columns
    assert sorted(map(repr, (tuple(r) for r in left.collect()))) == sorted(map(repr, [(None, "clean"), (1, "clean twin"), (2, None), (3, "")]))


def test_token_files_with_null_and_repeated_ids(spark, tmp_path):
    rnd = random.Random(8)
    text = lambda: " ".join(rnd.choices(["the", "of", "Zebra", "x1", "é", "中"], k=rnd.randrange(0, 60)))
    rows = [(None, text()) for _ in range(90)] + [(7, text()) for _ in range(150)] + [(7, "same")] * 40 + [(k, text()) for k in range(100)] + [(3, None), (8, "long " * 9000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, shard string").repartition(5)
    folder = token_files.write(docs, PATH, 1, to=str(tmp_path / "n"), shard_docs=32, segment_bytes=500)
    lib = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((-1 if i is None else i, len(ids), zlib.crc32(array("I", ids).tobytes())))
    got = sorted((r.start, r.n_tokens, -1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in token_files.digests(spark, folder).collect())
    assert sorted((d, n, c) for _, n, d, c in got) == sorted(want)
    at = 0
    for k, (start, n, d, _) in enumerate(got):
        assert start == at and (not k or d >= got[k - 1][2])
        at += n
    # all null ids or all copies of one id aren't one shard's
    per = token_files.segments(spark, folder).groupBy("shard").sum("n_docs").collect()
    assert max(r[1] for r in per) < 150


def test_few_documents_have_a_dictionary_of_their_own(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a few words"), (2, "")], "doc_id long, text string")
    folder = token_files.write(docs, PATH, 1, to=str(tmp_path / "f"))
    held = spark.read.parquet(f"{folder}/dictionary").first()
    assert len(held.dictionary) and {r.dict_hash for r in token_files.segments(spark, folder).collect()} == {held.dict_hash}
    assert token_files.lookup(spark, folder, 2) == [1]
