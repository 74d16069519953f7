"""Operator 7: benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive item words. For each pattern length m a table over hashed blocks of two words (one for
m = 1) tells how far a search window may move on without missing an occurrence; only where it says 0 are the window's
suffix bucket and then the words themselves compared. Many texts are searched in step, so each move is one array operation.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts, through_table, tidy

WINDOW = 10
#: Item words that one search holds in a task; beyond it the items are searched block by block.
BLOCK_WORDS = 1_000_000
#: Word characters are ASCII letters and digits and all beyond ASCII; upper case is lowered, the rest parts words (fixed by the contract).
WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else 32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))
TABLE = 1 << 20
#: Words of a text that one lane searches.
LANE = 512


def words_of(blob: bytes) -> list[bytes]:
    return blob.translate(WORDS).split()


class WuManber:
    """Tables for patterns of one length over word numbers (0: a word of no item)."""

    def __init__(self, patterns):
        """patterns: array of shape (n, m), distinct rows."""
        import numpy as np

        self.m, self.block = patterns.shape[1], min(2, patterns.shape[1])
        self.shift = np.full(TABLE, self.m - self.block + 1, np.int16)
        for end in range(self.block, self.m + 1):
            np.minimum.at(self.shift, self.hash([patterns[:, end - k - 1] for k in range(self.block)]), self.m - end)
        key = self.hash([patterns[:, self.m - k - 1] for k in range(self.block)])
        order = np.argsort(key, kind="stable")
        self.patterns, self.order = patterns[order], order
        self.first = np.searchsorted(key[order], np.arange(TABLE + 1))

    @staticmethod
    def hash(words):
        """Of a block, its last word first."""
        import numpy as np

        h = np.zeros(len(words[0]), np.uint64)
        for w in words:
            h = (h + w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h % np.uint64(TABLE)).astype(np.int64)

    def search(self, ids, lows, highs):
        """(last positions, pattern numbers) of all occurrences in ids, for texts [low, high)."""
        import numpy as np

        # a lane's windows end in [at, stop)
        n = np.maximum(0, highs - lows - self.m + 1)
        lanes = -(-n // LANE)
        text = np.repeat(np.arange(len(n)), lanes)
        k = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = lows[text] + self.m - 1 + k * LANE
        stop = np.minimum(at + LANE, highs[text])
        ends, found = [], []
        while len(at):
            h = self.hash([ids[at - j] for j in range(self.block)])
            move = self.shift[h]
            hit = move == 0
            if hit.any():
                p, b = at[hit], h[hit]
                size = self.first[b + 1] - self.first[b]
                p, size, b = p[size > 0], size[size > 0], b[size > 0]
                if len(p):
                    row = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[b], size)
                    p = np.repeat(p, size)
                    for j in range(self.m):  # direct comparison, dropping what differs
                        same = ids[p - j] == self.patterns[row, self.m - 1 - j]
                        p, row = p[same], row[same]
                        if not len(p):
                            break
                    ends.append(p)
                    found.append(self.order[row])
            at = at + np.maximum(move, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return (np.concatenate(ends), np.concatenate(found)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Search:
    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        import numpy as np

        self.vocabulary: dict[bytes, int] = {}
        by: dict[int, dict[tuple, set]] = {}
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            m = min(window, len(ids))
            for k in range(len(ids) - m + 1 if m else 0):
                by.setdefault(m, {}).setdefault(tuple(ids[k : k + m]), set()).add(item)
        self.tables = [(WuManber(np.array(list(p), np.int32).reshape(len(p), m)), [sorted(x) for x in p.values()]) for m, p in sorted(by.items())]

    def run(self, blobs: list[bytes]):
        """Per text: number of words, hit spans as sorted disjoint (starts, ends), item ids."""
        import numpy as np

        get = self.vocabulary.get
        lists = [words_of(b) for b in blobs]
        n = np.array([len(x) for x in lists], np.int64)
        highs = np.cumsum(n)
        lows = highs - n
        ids = np.fromiter((get(w, 0) for x in lists for w in x), np.int32, int(n.sum()))
        cover, items = np.zeros(len(ids) + 1, np.int32), [set() for _ in blobs]
        for table, owners in self.tables:
            ends, found = table.search(ids, lows, highs)
            np.add.at(cover, ends - table.m + 1, 1)
            np.add.at(cover, ends + 1, -1)
            for text, p in set(zip(np.searchsorted(highs, ends, side="right").tolist(), found.tolist())):
                items[text].update(owners[p])
        hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]]) if len(ids) else np.zeros(2, bool)
        out = []
        for lo, hi, x, got in zip(lows.tolist(), highs.tolist(), n.tolist(), items):
            if not got:
                out.append((x, [], [], []))
                continue
            h = np.diff(np.concatenate([[0], hit[lo + 1 : hi + 1].astype(np.int8), [0]]))
            out.append((x, np.flatnonzero(h == 1).tolist(), np.flatnonzero(h == -1).tolist(), sorted(got)))
        return out


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, starts, ends (word spans [start, end) inside occurring windows), items (ids of items with occurring windows).

    Every document row gives one row; null and empty texts have no words. Items of fewer words than a window are one
    window, items without words or with a null item_id none; equal items all count. The items' size is checked: up to
    block_words they go to each task, beyond that the documents are searched once per block of items, one block after the
    other so that the driver holds one at a time, and the blocks' spans united. An item longer than a block is one by itself.
    """
    blocks = _blocks(benchmark, block_words)
    schema = "doc_id long, n_words long, starts array<long>, ends array<long>, items array<long>"
    docs = texts(docs)
    if len(blocks) == 1:
        return docs.mapInArrow(functools.partial(_find, held=_sent(blocks[0]), window=window), schema)
    docs = docs.withColumn("copy", F.monotonically_increasing_id())
    docs = through_table(docs, "copies")  # so that all blocks see the same row numbers
    parts = [through_table(docs.mapInArrow(functools.partial(_find, held=_sent(block), window=window), schema + ", copy long"), "found") for block in blocks]
    both = functools.reduce(DataFrame.unionByName, parts)
    merged = both.groupBy("doc_id", "copy").agg(F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # spans in order, each joined with the one before if they touch
    joined = F.aggregate(
        "s",
        F.expr("cast(array() as array<struct<starts:bigint,ends:bigint>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1).ends >= x.starts),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1).starts.alias("starts"), F.greatest(F.element_at(acc, -1).ends, x.ends).alias("ends")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return merged.withColumn("s", joined).select("doc_id", "n_words", F.col("s.starts").alias("starts"), F.col("s.ends").alias("ends"), "items")


def _blocks(benchmark: DataFrame, block_words: int) -> list[DataFrame]:
    """item_id, text of the items in blocks of about block_words words, one at least."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).where(F.col("item_id").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.length("text") / 2), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // block_words))
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b) for b in range(n)]


def _sent(items: DataFrame):
    """(name, broadcast list of item ids and words) of one block: bounded by block_words, or by one item that is longer."""
    rows = sorted((r.item_id, words_of(bytes(r.text))) for r in items.collect())
    return uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast(rows)


_tables: dict = {}


def _search(held, window: int) -> Search:
    """A worker builds the tables of a block once and keeps those of the last block."""
    name, items = held
    if (name, window) not in _tables:
        _tables.clear()
        _tables[name, window] = Search(items.value, window)
    return _tables[name, window]


@tidy
def _find(batches, held, window):
    import pyarrow as pa

    search = _search(held, window)
    for batch in batches:
        for part in slices(batch):
            rows = list(zip(*search.run(part.column("text").cast(pa.binary()).to_pylist())))
            out = [part.column("doc_id"), pa.array(rows[0], pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in rows[1:])]
            names = ["doc_id", "n_words", "starts", "ends", "items"]
            if "copy" in part.schema.names:
                out, names = [*out, part.column("copy")], [*names, "copy"]
            yield pa.RecordBatch.from_arrays(out, names)


def report(found: DataFrame) -> DataFrame:
    """The columns of op7."""
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda a, b: a - b), F.lit(0).cast("long"), lambda a, b: a + b)
    listed = F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the rows whose text holds a window of an item; the task that searches a row drops it, so ids, null or repeated, don't matter. Rows with null or empty texts stay."""
    blocks = _blocks(benchmark, block_words)
    for k, block in enumerate(blocks):
        docs = docs.mapInArrow(functools.partial(_clean, held=_sent(block), window=window), docs.schema)
        if k + 1 < len(blocks):
            docs = through_table(docs, "clean")
    return docs


@tidy
def _clean(batches, held, window):
    import pyarrow as pa

    search = _search(held, window)
    for batch in batches:
        for part in slices(batch):
            blobs = [b or b"" for b in part.column("text").cast(pa.binary()).to_pylist()]
            yield part.filter(pa.array([not x[3] for x in search.run(blobs)], pa.bool_()))


def sha_of(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
