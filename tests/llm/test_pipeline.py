"""The pipeline against a brute-force version of each stage on the stage's own input."""

import random
from array import array

import public_tokenizers
import test_jaccard
import test_line_dedup
import test_ops_small
from tokenizers import Tokenizer

import corpus_pipeline as P
from regionpairs.llm import bpe, quality


def corpus():
    rnd = random.Random(11)
    vocab = ["the", "of", "and", "in", "a", "was", "to", "river", "stone", "garden"] + [f"word{i}" for i in range(500)]
    line = lambda n: " ".join(rnd.choices(vocab[:10], k=n // 2) + rnd.choices(vocab, k=n - n // 2))
    items = [(k, line(30)) for k in range(4)]
    shared = line(60)
    rows = [(k, "\n".join(line(rnd.randrange(15, 40)) for _ in range(4))) for k in range(120)]
    rows += [(200 + k, rows[k][1]) for k in range(10)]  # exact copies
    rows += [(300 + k, line(40) + "\n" + shared) for k in range(8)]  # a shared passage
    rows += [(400 + k, rows[20 + k][1].replace(" ", " x", 1).replace("\n", " ")) for k in range(10)]  # near copies, other line breaks
    rows += [(500 + k, line(20) + " " + items[k % 4][1] + " " + line(20)) for k in range(8)]  # leaks
    rows += [(600 + k, " ".join(f"w{rnd.randrange(99)}%%%&&&" for _ in range(80))) for k in range(15)]
    rows += [(700 + k, " ".join(["SHOUT!!", "LOUD!!", f"N{rnd.randrange(99)}!!"] * 40)) for k in range(15)]
    rows += [(800, None), (801, ""), (802, rows[0][1])]
    rnd.shuffle(rows)
    return rows, items


def test_stages(spark, tmp_path):
    rows, items = corpus()
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = docs.columns
    for name, stage in P.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/{name}")
        out = spark.read.parquet(f"{d}/{name}")
        if name == "quality":
            good = {r.doc_id for r in quality.score(docs).where("keep").collect()}
            assert {r.doc_id for r in out.collect()} == good
            assert not {i for i in good if 600 <= i < 800} and len([i for i, _ in rows if i < 600]) - len([i for i in good if i < 600]) <= 1
        if name == "line_dedup":
            want = test_line_dedup.brute(before, 10)
            left = {r.doc_id: r.text for r in out.collect()}
            for i, t in before:
                n, gone, _, size, _ = want[i, t or ""]
                assert (i not in left) == (gone > 0 and n == gone)
                if i in left:
                    assert len((left[i] or "").encode()) == size
            assert {r.doc_id: r.n_chars for r in out.collect()} == {i: len(t or "") for i, t in left.items()}
        if name == "near_duplicates":
            groups = test_jaccard.brute(before, 5, 80)
            assert {r.doc_id for r in out.collect()} == {root for _, _, root in groups}
        if name == "decontamination":
            hits = dict(test_ops_small.brute(before, items))
            assert {r.doc_id for r in out.collect()} == {i for i, h in hits.items() if not h[4]}
        if name == "bpe":
            lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
            for i, t in before:
                ids = lib.encode(t or "", add_special_tokens=False).ids
                assert got[i] == (len(ids), bpe.sha(array("I", ids).tobytes()), bpe.sha(lib.decode(ids, skip_special_tokens=False).encode()))
        else:
            assert out.columns == columns
        kept.append(out.count())
        docs = out
    assert kept == sorted(kept, reverse=True) and kept[0] > kept[1] > kept[2] > kept[3] == kept[4]
    assert P.run(spark, d).count() == kept[-1]


def test_edge_tables(spark, tmp_path):
    """Empty, null and repeated ids, very long texts and columns with clashing names go through every stage."""
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choices(["the", "of", "and", "river", "stone", "garden", "was", "in", *(f"word{i}" for i in range(300))], k=n))
    item = text(30)
    rows = [(k, text(80)) for k in range(30)] + [(None, text(90)), (None, text(20) + " " + item), (3, text(70)), (7, text(40_000)), (8, None), (9, "")]
    names = "doc_id long, text string, lang string, source string, n_chars long, a int, row int, node int, spans int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, 4) for i, t in rows], names)
    spark.createDataFrame([(1, item), (None, text(20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some in (docs, docs.limit(0)):
        now = some
        for name, stage in P.STAGES:
            now = P.through_table(stage(spark, now, str(tmp_path)), name)
            assert name == "bpe" or now.columns == docs.columns
        got = now.collect()
        assert all(len(r.ids_sha256) == 64 for r in got)
        if some is docs:
            ids = [r.doc_id for r in got]
            assert ids.count(None) == 1 and 7 in ids and len([i for i in ids if i == 3]) == 2
        else:
            assert not got
