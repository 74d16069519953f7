"""Operator 1: media columns by signature sniffing.

An Aho-Corasick automaton finds every place where a known format's magic bytes stand, the format's validator confirms
structure and lengths there, and what it confirms is carved. The first media of a blob corrects the declared type.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

#: Magic bytes of the formats (fixed values).
MAGIC = {b"\x89PNG\r\n\x1a\n": "image/png", b"GIF87a": "image/gif", b"GIF89a": "image/gif", b"\xff\xd8\xff": "image/jpeg", b"BM": "image/bmp", b"RIFF": "audio/wav", b".snd": "audio/basic"}
#: A payload is a positive multiple of this, filled up with bytes 255; pictures are so wide.
UNIT, WIDTH = 576, 24
STORED = ("audio/wav", "audio/basic", "image/bmp", "image/png")


def _u32(b, at, big=False):
    return int.from_bytes(b[at : at + 4], "big" if big else "little")


def png(b: bytes, o: int) -> int:
    """Length of the PNG at o, else 0: each chunk's length and checksum up to IEND, IHDR first."""
    at = o + 8
    while at + 12 <= len(b):
        n, kind = _u32(b, at, True), b[at + 4 : at + 8]
        if at + 12 + n > len(b) or (at == o + 8) != (kind == b"IHDR") or zlib.crc32(b[at + 4 : at + 8 + n]) != _u32(b, at + 8 + n, True):
            return 0
        at += 12 + n
        if kind == b"IEND":
            return at - o
    return 0


def gif(b: bytes, o: int) -> int:
    """Blocks and sub-blocks up to the trailer."""
    if o + 13 > len(b):
        return 0
    at = o + 13 + (3 << (b[o + 10] & 7) + 1 if b[o + 10] & 0x80 else 0)
    while at < len(b):
        if b[at] == 0x3B:
            return at + 1 - o
        if b[at] == 0x2C and at + 10 < len(b):
            at += 11 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 0x80 else 0)
        elif b[at] == 0x21:
            at += 2
        else:
            return 0
        while at < len(b) and b[at]:
            at += 1 + b[at]
        at += 1
    return 0


def jpeg(b: bytes, o: int) -> int:
    """Marker segments up to the end of image."""
    at = o + 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        kind, n = b[at + 1], int.from_bytes(b[at + 2 : at + 4], "big")
        if kind < 0xC0 or n < 2:
            return 0
        at += 2 + n
        if kind == 0xDA:
            while (at := b.find(b"\xff", at)) >= 0:
                if at + 1 >= len(b):
                    return 0
                if b[at + 1] == 0xD9:
                    return at + 2 - o
                if b[at + 1] and not 0xD0 <= b[at + 1] <= 0xD7:
                    break
                at += 2
            if at < 0:
                return 0
    return 0


def bmp(b: bytes, o: int) -> int:
    """File size, pixel offset, header size and the size of the pixels agree."""
    if o + 54 > len(b):
        return 0
    size, start, head, w, h, planes, bits, packed = struct.unpack_from("<IxxxxIIiiHHI", b, o + 2)
    good = head >= 40 and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and not packed and w > 0 and h and start >= 14 + head
    return size if good and size == start + (w * bits + 31) // 32 * 4 * abs(h) and o + size <= len(b) else 0


def wav(b: bytes, o: int) -> int:
    """A WAVE list whose chunks, fmt and data among them, fill its stated size."""
    size = 8 + _u32(b, o + 4)
    if o + size > len(b) or b[o + 8 : o + 12] != b"WAVE":
        return 0
    at, seen = o + 12, set()
    while at + 8 <= o + size:
        seen.add(b[at : at + 4])
        n = _u32(b, at + 4)
        at += 8 + n + n % 2
    return size if at == o + size and {b"fmt ", b"data"} <= seen else 0


def au(b: bytes, o: int) -> int:
    if o + 24 > len(b):
        return 0
    head, size, kind, rate, channels = struct.unpack_from(">IIIII", b, o + 4)
    return head + size if head >= 24 and 1 <= kind <= 27 and rate and 1 <= channels <= 32 and o + head + size <= len(b) else 0


VALID = {"image/png": png, "image/gif": gif, "image/jpeg": jpeg, "image/bmp": bmp, "audio/wav": wav, "audio/basic": au}


@functools.lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (len(magic), kind))
    a.make_automaton()
    return a


def sniff(blob: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every confirmed media in a blob, in order of offset; those inside others too."""
    out = []
    for end, (n, kind) in automaton().iter(blob.decode("latin-1")):
        at = end - n + 1
        if size := VALID[kind](blob, at):
            out.append((kind, at, size))
    return sorted(out, key=lambda x: (x[1], -x[2]))


def store(samples: bytes, kind: str) -> bytes:
    """8-bit samples, a multiple of 24, as a file of the type."""
    n, rows = len(samples), len(samples) // WIDTH
    if kind == "audio/wav":
        return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", n) + samples
    if kind == "audio/basic":
        return b".snd" + struct.pack(">IIIII", 24, n, 2, 8000, 1) + samples
    if kind == "image/bmp":
        return b"BM" + struct.pack("<IxxxxI", 1078 + n, 1078) + struct.pack("<IiiHHIIiiII", 40, WIDTH, -rows, 1, 8, 0, n, 0, 0, 256, 0) + b"".join(bytes((i, i, i, 0)) for i in range(256)) + samples
    import numpy as np

    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(rows, WIDTH)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def samples_of(media: bytes, kind: str) -> bytes | None:
    """The samples of a file of the types, width and depth that store() writes; None for others."""
    if kind == "audio/wav":
        at = media.find(b"data", 12)
        return media[at + 8 : at + 8 + _u32(media, at + 4)]
    if kind == "audio/basic":
        return media[_u32(media, 4, True) :]
    if kind == "image/bmp":
        return media[_u32(media, 10) :] if media[18:22] == struct.pack("<i", WIDTH) and media[28] == 8 else None
    if kind != "image/png" or media[16:20] != struct.pack(">I", WIDTH) or media[24:29] != b"\x08\0\0\0\0":
        return None
    import numpy as np

    data, at = b"", 8
    while at < len(media):
        n = _u32(media, at, True)
        if media[at + 4 : at + 8] == b"IDAT":
            data += media[at + 8 : at + 8 + n]
        at += 12 + n
    try:
        lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, WIDTH + 1)
    except (zlib.error, ValueError):
        return None
    return lines[:, 1:].tobytes() if not lines[:, 0].any() else None


def feature(samples: bytes, kind: str) -> str:
    """Type, rows, mean, deviation, and a 64-bit average hash: of the mean row of 576 samples in 64 bins, those above the mean."""
    import numpy as np

    a = np.frombuffer(samples, np.uint8)
    bins = a.reshape(-1, UNIT).sum(axis=0, dtype=np.int64).reshape(64, -1).sum(axis=1)
    total = int(bins.sum())
    square = int(np.bincount(a, minlength=256) @ (np.arange(256, dtype=np.int64) ** 2))
    bits = int("".join("1" if x * 64 > total else "0" for x in bins.tolist()), 2)
    mean = total / len(a)
    return f"{kind}:{len(a) // WIDTH}x{WIDTH}:mean={mean:.3f}:var={square / len(a) - mean * mean:.3f}:hash={bits:016x}"


def payload(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def pack(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared (a type that is often wrong), media: every text's payload stored losslessly in a file whose type its checksum picks.

    A null text counts as empty, whose payload is one unit of bytes 255. Repeated rows and rows with a null doc_id are kept,
    each by itself; equal texts give equal files. A very long text is one file of its own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return docs.mapInArrow(_pack, "doc_id long, n_bytes long, declared string, media binary")


@tidy
def _pack(batches):
    import pyarrow as pa

    for batch in batches:
        for part in slices(batch):
            n, declared, media = [], [], []
            for b in part.column("text").to_pylist():
                p = payload(b)
                c = zlib.crc32(p)
                n.append(len(b))
                declared.append(STORED[(c >> 8) % 4])
                media.append(store(p, STORED[c % 4]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(declared), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "declared", "media"])


def inspect(blobs: DataFrame, keep: list[str]) -> DataFrame:
    """Sniff a `media` column: the kept columns, then what the first confirmed media is and holds.

    sniffed and offset are of the first confirmed media, corrected says whether `declared` differs, embedded lists type,
    offset and length of the others. A blob without confirmed media, an empty or null one gives nulls and an empty list.
    """
    kinds = {f.name: f.dataType.simpleString() for f in blobs.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keep), "sniffed string", "offset long", "corrected boolean", "embedded array<struct<type:string,offset:bigint,length:bigint>>", "payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "media_sha256 string", "feature string"])
    return blobs.select(*dict.fromkeys([*keep, "declared", "media"])).mapInArrow(functools.partial(_inspect, keep=keep), schema)


@tidy
def _inspect(batches, keep):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
    kinds = [pa.string(), pa.int64(), pa.bool_(), kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["sniffed", "offset", "corrected", "embedded", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for whole in batches:
        for batch in slices(whole, column="media"):
            rows = []
            for declared, blob in zip(batch.column("declared").to_pylist(), batch.column("media").to_pylist()):
                found = sniff(blob or b"")
                if not found:
                    rows.append((None, None, None, [], None, None, None, None, None, None))
                    continue
                t, at, size = found[0]
                media = blob[at : at + size]
                p = samples_of(media, t)
                rows.append((t, at, t != declared, [{"type": a, "offset": b, "length": c} for a, b, c in found[1:]], *((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) if p is not None else (None,) * 3), size, hashlib.sha256(media).hexdigest(), feature(p, t) if p and len(p) % UNIT == 0 else None))
            cols = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(list(c), t) for c, t in zip(cols, kinds))], [*keep, *names])
