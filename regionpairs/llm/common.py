"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import functools
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionpairs.plans.shared import shared_dir, through_table  # noqa: F401

#: ASCII upper case to lower case, for bytes.translate.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fold_of(doc_id: int, n: int = 5) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text, null as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def sampled(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """At most n rows, those with the smallest hash of their key; a bound on the hash keeps all others from being moved."""
    h, total = F.pmod(F.xxhash64(key), F.lit(1 << 30)), df.count()
    if total > n:
        df = df.where(h < int(1.2 * n / total * (1 << 30)) + 1)
    return df.orderBy(h, key).limit(n)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Actions within it hand at most so many rows to Python at once: rows of megabytes would else fill a batch of a partition's size. The session's own setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def split_words(text):
    """Lower-cased words [^\\x20\\x09-\\x0D]+ of an Arrow column of texts without nulls, each distinct one once: (words as
    Arrow strings, place in words of every token, where each text's tokens start and end). An empty string may be among
    the words, without tokens."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(text)
    at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + n + 1]
    data = memoryview(text.buffers()[2] or b"")[at[0] : at[-1]].tobytes().translate(LOWER)
    split = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(at - at[0]), pa.py_buffer(data)]))
    coded = split.values.dictionary_encode()
    tokens, bounds = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    blank = pc.index(coded.dictionary, "").as_py()
    if blank >= 0:  # white space at a text's edge
        keep = tokens != blank
        tokens, bounds = tokens[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]
    return coded.dictionary, tokens, bounds


def listed(words) -> list[bytes]:
    """Arrow strings without white space as bytes."""
    return glued(words).split(b" ") if len(words) else []


def glued(words) -> bytes:
    """Arrow strings with a space between each two."""
    import numpy as np

    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return np.insert(data, ends[1:-1] - ends[0], 32).tobytes()


def slices(batch, size: int = 2 << 20, column: str = "text"):
    """A batch in runs of rows whose text (or other) column holds about `size` bytes (at least one row each)."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    text = batch.column(column)
    ends = np.cumsum(pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def tidy(of_batches):
    """A function over Arrow batches that gives freed memory back to the system when its partition ends: workers are used again."""

    @functools.wraps(of_batches)
    def run(*args, **named):
        try:
            yield from of_batches(*args, **named)
        finally:
            give_back()

    return run


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
