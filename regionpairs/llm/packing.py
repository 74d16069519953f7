"""Operator 12: packing documents into windows of token ids by minimum bin slack.

Each partition of documents is encoded and packed as it streams by, so nothing is shuffled and a lost task packs its own
documents again. Whole windows of a long document are sequences by themselves; the rests wait in a pool of bounded size,
counted per length. A window takes the longest rest; bitset subset-sum dynamic programming over the lengths (bit s: some
multiset of rests sums to s) finds the sum closest to what is left, and backtracking through the bitsets how many of each
length make it. The same multiset fills further windows while its lengths last. Where no multiset fills a window exactly, the
next rest is cut to fill it; what is left at a partition's end is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import re
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts, tidy

#: Ids that wait in a task's pool before windows are filled; sequences handed on at once; bytes of text worked on at once.
HOLD, HANDED, AT_ONCE = 2 << 20, 1024, 4 << 20
#: Distinct units that a worker remembers, and their longest; units that the library gets as one text.
REMEMBERED, UNIT_BYTES, CALL = 200_000, 64, 4096
SEQUENCE = "sequence_id long, ids binary, padded_to int, pieces array<struct<doc_id:long,start:long,length:int,doc_tokens:long,offset:int>>"
#: White space beyond ASCII as UTF-8 (fixed values of Unicode): texts with it go to the library whole.
ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
SPACE, LETTER, MARK = (bytes(b in s for b in range(256)) for s in (b" \t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
#: What a tokenizer file must state so that its units can be encoded apart (fixed values of the file).
KNOWN = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


class Encoder:
    """Exactly the tokenizers library's encode(text, add_special_tokens=False), each distinct unit of a call encoded once.

    A unit is a run of white space with the text up to the next one, to a mark after a letter or, for a lone line end, none: no piece of the
    pre-tokenizer and no look-ahead crosses its ends. Texts with an added token or odd white space go to the library whole.
    """

    def __init__(self, path: str):
        import json

        import numpy as np
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.whole = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None, "post_processor": None}))
        self.by_units = spec["pre_tokenizer"] == KNOWN and spec["normalizer"] is None
        self.led = np.array([(self.whole.id_to_token(k) or "").startswith("Ġ") for k in range(self.whole.get_vocab_size(with_added_tokens=True))])
        self.odd = re.compile(b"|".join([ODD_SPACE.pattern, *(re.escape(t["content"].encode()) for t in spec.get("added_tokens", []))]))
        self.held: dict[bytes, bytes] = {}

    def library(self, blobs: list[bytes]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.whole.encode_batch_fast([b.decode() for b in blobs], add_special_tokens=False)]

    def _led(self, units: list[bytes]) -> list[bytes]:
        """Ids of units that start with a space and hold no other white space: many in one text, where each one's first token shows the space."""
        import numpy as np

        out: list[bytes] = []
        for k in range(0, len(units), CALL):
            ids = np.frombuffer(self.library([b"".join(units[k : k + CALL])])[0], "<u4")
            at, data = np.append(4 * np.flatnonzero(self.led[ids]), 4 * len(ids)).tolist(), ids.tobytes()
            out += [data[a:b] for a, b in zip(at, at[1:])]
        if len(out) != len(units):
            raise ValueError("a unit's first token doesn't show its space")
        return out

    def encode(self, blobs: list[bytes]):
        """(ids of all texts one after the other, where each text's start and end)."""
        import numpy as np

        odd = {k for k, b in enumerate(blobs) if not self.by_units or self.odd.search(b)}
        flat, bounds = self._units([b"" if k in odd else b for k, b in enumerate(blobs)])
        if not odd:
            return flat, bounds
        parts = [flat[a:b] for a, b in zip(bounds, bounds[1:])]
        for k, ids in zip(sorted(odd), self.library([blobs[k] for k in sorted(odd)])):
            parts[k] = np.frombuffer(ids, "<u4")
        return np.concatenate([np.zeros(0, "<u4"), *parts]), np.cumsum([0, *map(len, parts)])

    def _units(self, blobs):
        import numpy as np
        import pyarrow as pa

        data, at = np.frombuffer(b"".join(blobs), np.uint8), np.cumsum([0, *map(len, blobs)])
        space, letter, mark = (np.frombuffer(x, bool)[data] for x in (SPACE, LETTER, MARK))
        start = np.zeros(len(data), bool)
        start[1:] = (space[1:] & ~space[:-1]) | (mark[1:] & letter[:-1])
        start[2:] |= ~space[2:] & (data[1:-1] == 10) & ~space[:-2]  # after a line's end that stands alone
        start[at[:-1][np.diff(at) > 0]] = True  # every text but the empty ones
        cuts = np.flatnonzero(start)
        units = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data)).astype(np.int32)), pa.py_buffer(data)])
        coded = units.dictionary_encode()
        ids = self._known(coded.dictionary.to_pylist())
        sizes = np.fromiter((len(b) // 4 for b in ids), np.int64, len(ids))
        pieces = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        flat = pieces.take(coded.indices).flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes[coded.indices.to_numpy()])]) if len(cuts) else np.zeros(1, np.int64)
        return flat.astype("<u4", copy=False), ends[np.searchsorted(cuts, at)]

    def _known(self, units: list[bytes]) -> list[bytes]:
        new = [u for u in units if u not in self.held]
        led = [u for u in new if u[0] == 32 and len(u) > 1 and not SPACE[u[1]]]
        found = dict(zip(led, self._led(led)))
        rest = [u for u in new if u not in found]
        found.update(zip(rest, self.library(rest)))
        out = [found.get(u) or self.held[u] for u in units]
        if len(self.held) + len(found) > REMEMBERED:  # the units of this call are likelier than older ones
            self.held = dict(zip(units, out)) if len(units) <= REMEMBERED else {}
        self.held.update((u, b) for u, b in found.items() if len(u) <= UNIT_BYTES)
        return out


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def closest(counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """(sum, how many of each length): the multiset of lengths, each at most so often as counts has it, whose sum comes closest to room from below. Longer lengths are tried first."""
    reach, before = 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        now, left, k = reach, min(counts[length], room // length), 1
        while left:  # 1, 2, 4 ... copies and a rest make every number of copies
            k = min(k, left)
            now |= now << (k * length)
            left -= k
            k *= 2
        now &= (2 << room) - 1
        if now != reach:
            before.append((length, reach))
            reach = now
        if reach >> room & 1:
            break
    total = at = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, old in reversed(before):
        n = 0
        while not old >> at & 1:
            at, n = at - length, n + 1
        if n:
            taken[length] = n
    return total, taken


class Pool:
    """The rests of documents that wait for a window: per length a list of (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int):
        self.capacity, self.held, self.rests = capacity, 0, {}

    def add(self, rest: tuple) -> None:
        self.rests.setdefault(len(rest[2]), []).append(rest)
        self.held += len(rest[2])

    def take(self, length: int) -> tuple:
        run = self.rests[length]
        rest = run.pop()
        if not run:
            del self.rests[length]
        self.held -= length
        return rest

    def windows(self):
        """Runs of windows of one multiset, each a list of rests; there must be a window's worth of ids."""
        counts = {x: len(run) for x, run in self.rests.items()}
        top = max(counts)
        counts[top] -= 1
        total, taken = closest(counts, self.capacity - top)
        taken[top] = taken.get(top, 0) + 1
        lengths = [x for x, n in taken.items() for _ in range(n)]
        slack = self.capacity - top - total
        for _ in range(min(len(self.rests[x]) // n for x, n in taken.items()) if not slack else 1):
            window = [self.take(x) for x in lengths]
            if slack:  # every rest that is left is longer
                window.append(self.cut(max(self.rests), slack))
            yield window

    def cut(self, length: int, n: int) -> tuple:
        doc_id, start, ids, total = self.take(length)
        if n < length:
            self.add((doc_id, start + n, ids[n:], total))
        return doc_id, start, ids[:n], total

    def last(self):
        """What is left, less than a window: sequences of a power of two, largest first."""
        while self.held:
            window, room = [], 1 << (self.held.bit_length() - 1)
            while room:
                total, taken = closest({x: len(run) for x, run in self.rests.items()}, room)
                window += [self.take(x) for x, n in taken.items() for _ in range(n)]
                room -= total
                if room and not total:
                    window.append(self.cut(max(self.rests), room))
                    room = 0
            yield window


def _padded(n: int, capacity: int) -> int:
    return n if n & (n - 1) == 0 else capacity


@tidy
def _pack(batches, path, end_id, capacity, hold):
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    enc, pool, done = encoder(path), Pool(capacity), []
    number = TaskContext.get().partitionId() << 40

    def out():
        nonlocal number
        n = np.array([len(w) for w in done], np.int64)
        sizes = [sum(len(p[2]) for p in w) for w in done]
        rows = [p for w in done for p in w]
        lengths = np.array([len(p[2]) for p in rows], np.int64)
        ends, first = np.cumsum(lengths), np.concatenate([[0], np.cumsum(n)])
        offsets = ends - lengths - np.repeat(np.concatenate([[0], np.cumsum(sizes)])[:-1], n)
        kinds = [("doc_id", pa.int64(), [p[0] for p in rows]), ("start", pa.int64(), [p[1] for p in rows]), ("length", pa.int32(), lengths), ("doc_tokens", pa.int64(), [p[3] for p in rows]), ("offset", pa.int32(), offsets)]
        pieces = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(v, t) for _, t, v in kinds], [c for c, _, _ in kinds]))
        ids = [b"".join(p[2].tobytes() for p in w) for w in done]
        batch = pa.RecordBatch.from_arrays([pa.array(range(number, number + len(done)), pa.int64()), pa.array(ids, pa.binary()), pa.array([_padded(s, capacity) for s in sizes], pa.int32()), pieces], ["sequence_id", "ids", "padded_to", "pieces"])
        number += len(done)
        done.clear()
        return batch

    def drained(until):
        while pool.held >= max(until, capacity):
            for window in pool.windows():
                done.append(window)
                if len(done) >= HANDED:
                    yield out()

    for batch in batches:
        for part in slices(batch, AT_ONCE):
            flat, bounds = enc.encode(part.column("text").cast(pa.binary()).to_pylist())
            for doc_id, a, b in zip(part.column("doc_id").to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                ids, total = np.append(flat[a:b], np.uint32(end_id)), b - a + 1
                whole = total - total % capacity
                for start in range(0, whole, capacity):
                    done.append([(doc_id, start, ids[start : start + capacity], total)])
                    if len(done) >= HANDED:
                        yield out()
                if whole < total:
                    pool.add((doc_id, whole, ids[whole:].copy() if whole else ids, total))
            if pool.held >= hold:
                yield from drained(hold // 2)
    yield from drained(0)
    done.extend(pool.last())
    if done:
        yield out()


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, hold: int = HOLD) -> DataFrame:
    """sequence_id, ids (little-endian unsigned 32-bit, without padding), padded_to, pieces of the packed documents.

    Every text (null: empty) becomes its ids and end_id; each id lies in one piece. Repeated rows and rows with a null
    doc_id are packed each by itself, other columns don't matter, an empty table gives no sequence. Sequences hold capacity
    ids (a power of two), but at the end of each partition at most log2(capacity) shorter ones, of a power of two.
    sequence_id is unique; it depends on how the table is read. A task holds `hold` ids that wait, and one slice of texts.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    return texts(docs).mapInArrow(functools.partial(_pack, path=tokenizer, end_id=end_id, capacity=capacity, hold=hold), SEQUENCE)


def digests(sequences: DataFrame) -> DataFrame:
    """The columns of op12, one row per piece, cut from the sequences' ids."""
    p = sequences.select("sequence_id", "ids", "padded_to", F.explode("pieces").alias("p"))
    crc = F.crc32(F.substring("ids", F.col("p.offset") * 4 + 1, F.col("p.length") * 4))
    return p.select("p.doc_id", "p.start", F.col("p.length").cast("long").alias("length"), crc.alias("ids_crc32"), "p.doc_tokens", "sequence_id", F.col("p.offset").cast("long").alias("offset"), "padded_to")
