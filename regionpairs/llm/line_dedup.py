"""Operator 8: line dedup by prefix doubling over line-ID sequences.

Documents are sequences of line IDs, one corpus of suffixes. Doubling names every run of 1, 2, 4, ... lines that occurs more
than once after its first occurrence: the suffixes that share a name at a length are the suffix array's interval with a
longest common prefix of that length or more. Going down the lengths again, each suffix leaves its interval for the deepest
one that also holds an earlier suffix, which gives its longest run with an earlier copy. Runs of min_words words or more
that have an earlier copy are deleted; the first copy stays.

Only lines that occur more than once take part, and at each length only runs that do, so the work shrinks from step to step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .common import slices, through_table, tidy

#: A run of fewer words stays, however often it occurs.
MIN_WORDS = 10


def _key() -> list:
    """a, b: what orders and names a document, its id and its text's hash."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("a"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("b")]


def lines(docs: DataFrame) -> DataFrame:
    """a, b, i (place among the lines that aren't blank), words, h (128-bit hash) of every such line."""
    return docs.select(*_key(), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_lines, "a long, b long, i int, words int, h binary")


@tidy
def _lines(batches):
    import numpy as np
    import pyarrow as pa
    import xxhash

    for batch in batches:
        for part in slices(batch):
            found = [[x for x in b.split(b"\n") if x.strip()] for b in part.column("text").cast(pa.binary()).to_pylist()]
            n = np.array([len(x) for x in found], np.int64)
            flat = [x for f in found for x in f]
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            a, b = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), n) for c in ("a", "b"))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(place.astype(np.int32)), pa.array([len(x.split()) for x in flat], pa.int32()), pa.array([xxhash.xxh3_128_digest(x) for x in flat], pa.binary())], ["a", "b", "i", "words", "h"])


def runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """a, b, i, size, words, first (place of the first copy): for every line where a run of min_words words or more starts that has an earlier copy, the longest such run."""
    here = F.struct("a", "b", "i")
    every = through_table(lines(docs), "lines")
    # written first, so that the join deals both sides anew and can split a very common line
    twice = through_table(every.groupBy("h").agg(F.count("*").alias("c"), F.min(here).alias("n")).where("c > 1").select("h", "n"), "twice")
    base = through_table(every.join(twice, "h").select("a", "b", "i", "words", "n").dropDuplicates(["a", "b", "i"]), "repeated")
    # up: names of runs of 2 ** k lines
    levels = [base.select("a", "b", "i", "n")]
    while not levels[-1].isEmpty():
        now, step = levels[-1], 1 << (len(levels) - 1)
        pair = now.join(now.select("a", "b", (F.col("i") - step).alias("i"), F.col("n").alias("m")), ["a", "b", "i"])
        pair = through_table(pair, "pairs")
        named = through_table(pair.groupBy("n", "m").agg(F.min(here).alias("f"), F.count("*").alias("c")).where("c > 1").select("n", "m", "f"), "named")
        levels.append(through_table(pair.join(named, ["n", "m"]).select("a", "b", "i", F.col("f").alias("n")), "names"))
    # down: each suffix to the deepest interval that also holds an earlier one; an interval's first suffix goes along as its witness
    none = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(-1).alias("i"))
    state = base.select("a", "b", "i", F.lit(0).alias("size"), none.alias("n"), F.lit(True).alias("own"))
    for k in reversed(range(len(levels) - 1)):
        at = levels[k].select("a", "b", F.col("i").alias("j"), F.col("n").alias("m"))
        met = state.withColumn("j", F.col("i") + F.col("size")).join(at, ["a", "b", "j"])
        deeper = through_table(met.groupBy("size", "n", "m").agg(F.min(here).alias("f"), F.count("*").alias("c")).where("c > 1").select("size", "n", "m", "f"), "deeper")
        moved = met.join(deeper, ["size", "n", "m"]).withColumn("later", F.col("own") & (here != F.col("f")))
        moved = through_table(moved.select("a", "b", "i", "size", "n", "f", "later"), "moved")
        gone = moved.where("later").select("a", "b", "i", "size", "n")
        state = state.join(gone, ["a", "b", "i", "size", "n"], "left_anti").unionByName(moved.select("a", "b", "i", (F.col("size") + (1 << k)).alias("size"), F.col("f").alias("n"), F.col("later").alias("own")))
        state = through_table(state, "suffixes")
    sums = base.select("a", "b", "i", "words", F.sum("words").over(Window.partitionBy("a", "b").orderBy("i")).alias("upto"))
    found = state.where("own and size > 0").join(sums, ["a", "b", "i"]).withColumn("j", F.col("i") + F.col("size") - 1)
    ends = sums.select("a", "b", F.col("i").alias("j"), F.col("upto").alias("till"))
    total = F.col("till") - F.col("upto") + F.col("words")
    return found.join(ends, ["a", "b", "j"]).where(total >= min_words).select("a", "b", "i", "size", total.alias("words"), F.col("n").alias("first"))


def _with_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """row (docs' columns but text), text, spans: the deleted stretches of lines, null if there are none."""
    found = through_table(runs(docs, min_words).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("i", (F.col("i") + F.col("size")).alias("j")))).alias("spans")), "spans")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "text", *_key())
    # the runs grow with the corpus, so texts and runs are dealt out to each other at every size
    return rows.join(found.hint("merge"), ["a", "b"], "left").select("row", "text", "spans")


def cut(blob: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int, int]:
    """The text without the lines in spans (sorted, disjoint), its lines that aren't blank, the deleted ones, their words."""
    out, n, gone, words, k = [], 0, 0, 0, 0
    for x in blob.split(b"\n"):
        if x.strip():
            while k < len(spans) and spans[k][1] <= n:
                k += 1
            n += 1
            if k < len(spans) and spans[k][0] < n:
                gone += 1
                words += len(x.split())
                continue
        out.append(x)
    return b"\n".join(out) if gone else blob, n, gone, words


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans or []:
        i, j = s["i"], s["j"]
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], max(j, out[-1][1]))
        else:
            out.append((i, j))
    return out


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_cut, n_cut_words, left_bytes, left_sha256 of every document row.

    Null and empty texts have no lines. Blank lines are never deleted and don't part a run. Of copies the first by doc_id
    stays (null ids come first), within a document the first by place; rows that repeat a document wholly are one document
    and share its result. Overlapping copies within one document count: of a line given n times in a row the first stays.
    """
    return _with_runs(docs.select("doc_id", "text"), min_words).select("row.doc_id", "text", "spans").mapInArrow(_report, "doc_id long, n_lines long, n_cut long, n_cut_words long, left_bytes long, left_sha256 string")


@tidy
def _report(batches):
    import hashlib

    import pyarrow as pa

    for batch in batches:
        for part in slices(batch):
            got = [cut(b or b"", _merged(s)) for b, s in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("spans").to_pylist())]
            cols = [*([g[k] for g in got] for k in (1, 2, 3)), [len(g[0]) for g in got]]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols), pa.array([hashlib.sha256(g[0]).hexdigest() for g in got])], ["doc_id", "n_lines", "n_cut", "n_cut_words", "left_bytes", "left_sha256"])


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with deleted runs taken out of text (and n_chars, if there, set anew); a document of which only blank lines are left goes.

    All other rows stay as they are, null and empty texts too; which copies are deleted is as in report. Columns may have any names.
    """
    marked = _with_runs(docs, min_words)
    left = marked.mapInArrow(_cut_text, StructType([marked.schema["row"], StructField("text", StringType()), StructField("cut", BooleanType())]))
    left = left.where(~F.col("cut") | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cut"), F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return left.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))


@tidy
def _cut_text(batches):
    import pyarrow as pa

    for batch in batches:
        for part in slices(batch):
            spans = part.column("spans").to_pylist()
            text = [b if s is None else cut(b or b"", _merged(s))[0] for b, s in zip(part.column("text").cast(pa.binary()).to_pylist(), spans)]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(text, pa.binary()).cast(pa.string()), pa.array([s is not None for s in spans], pa.bool_())], ["row", "text", "cut"])
