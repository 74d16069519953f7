"""Operator 5: token-ID files.

A folder of two tables (and `frames`, the compressed arrays before they are dealt out in order). `dictionary`: one row, the shared zstandard dictionary and its sha256. `segments`: rows of about
segment_bytes in ascending document order, each a run of separately compressed id arrays with the offset index that opens
one short document alone: doc_ids, offsets, counts, and the hash of the dictionary that they need. An array is stored as
unsigned 16-bit integers where its ids allow, else as 32-bit (the sign of its offset index entry `wide`).
"""

from __future__ import annotations

import functools
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import AT_ONCE, encoder
from .common import sampled, shared_dir, slices, texts, tidy

#: Documents, by smallest hash of their id, whose ids train the dictionary; pieces of them that it sees; its size.
SAMPLE_DOCS, PIECE_BYTES, DICTIONARY_BYTES = 500, 4096, 64 * 1024
SHARD_DOCS, SEGMENT_BYTES, LEVEL = 16_384, 1 << 20, 3
#: Pieces that the trainer needs, besides as many bytes as the dictionary has.
TRAINABLE = 32
BEFORE = (Window.unboundedPreceding, -1)
SEGMENT = "shard int, seg int, first_id long, last_id long, n_docs int, n_tokens long, doc_ids array<long>, counts array<long>, offsets array<long>, wide array<boolean>, dict_hash string, payload binary"


def train_dictionary(docs: DataFrame, path: str, end_id: int) -> bytes:
    """A dictionary from a bounded sample of whole documents' serialized ids; where the trainer finds too few of them, the
    pieces themselves are the dictionary (raw content). Empty without documents."""
    import zstandard

    rows = sampled(texts(docs), SAMPLE_DOCS).mapInArrow(functools.partial(_ids, path=path, end_id=end_id), "doc_id long, ids binary").collect()
    pieces = [bytes(r.ids)[k : k + PIECE_BYTES] for r in rows for k in range(0, len(r.ids), PIECE_BYTES)]
    size = sum(map(len, pieces))
    if len(pieces) >= TRAINABLE and size >= DICTIONARY_BYTES:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    return b"".join(pieces)[-DICTIONARY_BYTES:]


@tidy
def _ids(batches, path, end_id):
    import pyarrow as pa

    for batch in batches:
        for part in slices(batch, AT_ONCE):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[2] for x in _arrays(part, path, end_id)], pa.binary())], ["doc_id", "ids"])


def _arrays(part, path, end_id):
    """(number of ids, wide, bytes) of each text's ids with the end id."""
    import numpy as np
    import pyarrow as pa

    flat, bounds = encoder(path).encode(part.column("text").cast(pa.binary()).to_pylist())
    flat, bounds = np.insert(flat, bounds[1:], end_id), bounds + np.arange(len(bounds))
    narrow, cuts = flat.astype("<u2").tobytes(), bounds.tolist()
    for k, top in enumerate(np.maximum.reduceat(flat, bounds[:-1]) if len(bounds) > 1 else ()):
        a, b = cuts[k], cuts[k + 1]
        yield b - a, top > 0xFFFF, flat[a:b].tobytes() if top > 0xFFFF else narrow[2 * a : 2 * b]


def _coder(dictionary: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=True), zstandard.ZstdDecompressor(dict_data=d)


@tidy
def _frames(batches, path, end_id, dictionary):
    import pyarrow as pa

    squeeze = _coder(dictionary)[0].compress
    for batch in batches:
        for part in slices(batch, AT_ONCE):
            ns, wides, frames = [], [], []
            for n, wide, data in _arrays(part, path, end_id):
                ns.append(n)
                wides.append(bool(wide))
                frames.append(squeeze(data))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ns, pa.int64()), pa.array(wides, pa.bool_()), pa.array(frames, pa.binary())], ["doc_id", "n_tokens", "wide", "frame"])


@tidy
def _segments(batches, dict_hash, segment_bytes):
    import pyarrow as pa
    from pyspark import TaskContext

    names = [x.split()[0] for x in SEGMENT.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.string(), pa.binary()]
    # partitions are ranges in order, so their numbers are those of the shards
    shard = TaskContext.get().partitionId()
    rows: list = []
    size, seg = 0, 0

    def out():
        ids, ns, wides, frames = (list(x) for x in zip(*rows))
        offsets, at = [], 0
        for f in frames:
            offsets.append(at)
            at += len(f)
        known = [x for x in ids if x is not None]
        row = [shard, seg, min(known, default=None), max(known, default=None), len(rows), sum(ns), ids, ns, offsets, wides, dict_hash, b"".join(frames)]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "wide", "frame"))):
            if rows and size >= segment_bytes:
                yield out()
                rows, size, seg = [], 0, seg + 1
            rows.append(row)
            size += len(row[3])
    if rows:
        yield out()


def write(docs: DataFrame, tokenizer: str, end_id: int, to: str | None = None, shard_docs: int = SHARD_DOCS, segment_bytes: int = SEGMENT_BYTES) -> str:
    """Encode every text (null: empty), append end_id and write the files in ascending doc_id order; returns the folder.

    Documents are encoded and compressed where they lie; only compressed arrays are dealt out, into ranges of doc_id and, so
    that the copies of one id (or all null ids) don't meet in one, of a hash within it. An empty table gives files
    without segments; rows that share a doc_id lie side by side, in no stated order; null doc_ids come first.
    """
    spark = docs.sparkSession
    to = to or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    dictionary = train_dictionary(docs, tokenizer, end_id)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, dictionary, end_id, LEVEL)], "dict_hash string, dictionary binary, end_id long, level int").coalesce(1).write.parquet(f"{to}/dictionary")
    kind = "doc_id long, n_tokens long, wide boolean, frame binary"
    # written once: finding the ranges looks at every row before they are dealt out
    texts(docs).mapInArrow(functools.partial(_frames, path=tokenizer, end_id=end_id, dictionary=dictionary), kind).write.option("compression", "none").parquet(f"{to}/frames")
    frames = spark.read.schema(kind).parquet(f"{to}/frames")
    shards = max(1, -(-frames.count() // shard_docs))
    salt = F.xxhash64("frame").alias("salt")
    (
        frames.select("*", salt)
        .repartitionByRange(shards, "doc_id", "salt")
        .sortWithinPartitions("doc_id", "salt")
        .mapInArrow(functools.partial(_segments, dict_hash=name, segment_bytes=segment_bytes), SEGMENT)
        .write.option("compression", "none")
        .parquet(f"{to}/segments")
    )
    return to


def segments(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SEGMENT).parquet(f"{folder}/segments")


def starts(spark: SparkSession, folder: str) -> DataFrame:
    """shard, seg, seg_start: the ids before each segment, from the index alone."""
    index = segments(spark, folder).select("shard", "seg", "n_tokens")
    total = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # one row per shard: the only step over all shards
    base = total.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(*BEFORE)), F.lit(0)).alias("base"))
    within = index.select("shard", "seg", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("seg").rowsBetween(*BEFORE)), F.lit(0)).alias("inner"))
    return within.join(base, "shard").select("shard", "seg", (F.col("base") + F.col("inner")).alias("seg_start"))


def opened(spark: SparkSession, folder: str) -> DataFrame:
    """shard, seg, doc_id, inner_start (ids before it in its segment), n_tokens, ids (little-endian unsigned 32-bit) of every document in the files."""
    row = spark.read.parquet(f"{folder}/dictionary").first()
    held = segments(spark, folder).select("shard", "seg", "doc_ids", "counts", "offsets", "wide", "dict_hash", "payload")
    return held.mapInArrow(functools.partial(_open, dictionary=bytes(row.dictionary), dict_hash=row.dict_hash), "shard int, seg int, doc_id long, inner_start long, n_tokens long, ids binary")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of op5, from the files: only digests meet the segments' starts, not the ids."""
    short = opened(spark, folder).select("shard", "seg", "doc_id", "inner_start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return short.join(starts(spark, folder), ["shard", "seg"]).select("doc_id", (F.col("seg_start") + F.col("inner_start")).alias("start"), "n_tokens", "ids_crc32")


@tidy
def _open(batches, dictionary, dict_hash):
    import numpy as np
    import pyarrow as pa

    unsqueeze = _coder(dictionary)[1].decompress
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if row["dict_hash"] != dict_hash:
                raise ValueError("the segment needs another dictionary")
            ends = [*row["offsets"][1:], len(row["payload"])]
            ids = [np.frombuffer(unsqueeze(row["payload"][a:b]), "<u4" if w else "<u2").astype("<u4").tobytes() for a, b, w in zip(row["offsets"], ends, row["wide"])]
            if [len(x) // 4 for x in ids] != row["counts"]:
                raise ValueError("the offset index doesn't fit the arrays")
            n = len(ids)
            starts = np.cumsum([0, *row["counts"]])[:-1]
            yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * n, pa.int32()), pa.array([row["seg"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(ids, pa.binary())], ["shard", "seg", "doc_id", "inner_start", "n_tokens", "ids"])


def lookup(spark: SparkSession, folder: str, doc_id: int) -> list[int]:
    """One document's ids: only its segment is read (first_id and last_id reach the scan) and only its array opened."""
    import numpy as np

    row = spark.read.parquet(f"{folder}/dictionary").first()
    hit = spark.read.schema(SEGMENT).parquet(f"{folder}/segments").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id) & F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).first()
    if hit is None:
        raise KeyError(doc_id)
    k = hit.doc_ids.index(doc_id)
    ends = [*hit.offsets[1:], len(hit.payload)]
    return np.frombuffer(_coder(bytes(row.dictionary))[1].decompress(bytes(hit.payload)[hit.offsets[k] : ends[k]]), "<u4" if hit.wide[k] else "<u2").tolist()

