"""Operator 9: BPE encoding and decoding.

Words (text between ASCII white space, across which the tokenizer can't look) are told apart in Arrow; each distinct word of a
run of texts is encoded by the tokenizers library once. A text of more than `leaf_chars` is
halved, wherever that cuts, into leaves that are encoded in parallel as rows of their own; a tree then joins neighbours by
re-encoding a growing window around the join until it agrees with both sides.

Why the join is exact: in byte-pair encoding a sequence of tokens is the encoding of its text if every two neighbours are
neighbours in some true encoding of a stretch that holds both. The window shares a token with the left side and one with
the right side (or ends at white space there), so each pair of neighbours comes from one of three true encodings.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, glued, slices, texts, tidy

#: Words that aren't of letters alone are remembered if they aren't longer than this.
UNIT_CHARS = 64
#: Text beyond this length is halved into leaves.
LEAF_CHARS = 16_384
#: ASCII white space, where every tokenizer file of this kind parts its units.
SPACES = " \t\n\x0b\x0c\r"
#: How many of them a worker remembers; words that the library gets in one call; bytes of text that are worked on at once.
REMEMBERED, CALL, AT_ONCE = 50_000, 20_000, 4 << 20
#: The normalizer and pre-tokenizer that Encoder can apply to whole texts at once (fixed values of the tokenizer file).
KNOWN = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Bytes of UTF-8 text for which NFC changes nothing (code points below U+0300) and that no control rule touches.
PLAIN = bytes(b for b in range(256) if b < 0xCC and not 0x1C <= b <= 0x1F and b != 1)
#: The characters that stand for bytes in byte-level tokenizer files: printable ones for themselves, all others counted from 256; a space stays.
_SHOWN = {*range(32, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = [b for b in range(256) if b not in _SHOWN or b == 32]
BYTE_LEVEL = "".join(chr(b if b in _SHOWN else 256 + _HIDDEN.index(b)) for b in range(256))
#: Lower-case letters and marks of ASCII: a piece always ends between them.
LETTER, MARK = (bytes(b in s for b in range(256)) for s in (b"abcdefghijklmnopqrstuvwxyz", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))


class Encoder:
    """The tokenizer library, each distinct word encoded once per call; exactly its encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        import numpy as np
        import pyarrow as pa
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(open(path, encoding="utf-8").read())
        self.whole = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None, "post_processor": None}))
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.added_low = [t.lower().encode() for t in self.added]
        self.added_re = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        # the same model without normalizer and added tokens, and with words as its only pieces
        self.bare, self.letters = Tokenizer(self.whole.model), Tokenizer(self.whole.model)
        if self.whole.pre_tokenizer is not None:
            self.bare.pre_tokenizer = self.whole.pre_tokenizer
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = spec["model"].get("end_of_word_suffix")
        self.known = spec["normalizer"] == KNOWN and spec["pre_tokenizer"] == PIECES and bool(suffix)
        self.joins_words = spec.get("decoder") is None
        shown = [self.whole.id_to_token(k) or "" for k in range(self.whole.get_vocab_size(with_added_tokens=True))]
        self.shown = pa.array(shown, pa.string())
        self.ends_word = np.array([bool(suffix) and t.endswith(suffix) for t in shown])
        self.words: dict[str, bytes] = {}
        self.raw: dict[str, bytes] = {}

    def ids(self, blobs: list[bytes]) -> list[bytes]:
        """Texts as UTF-8 to ids as little-endian unsigned 32-bit integers."""
        flat, bounds = self.encode(blobs)
        data, cuts = flat.tobytes(), (4 * bounds).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def plain(self, blob: bytes) -> bytes | None:
        """The text in lower case if that is all that the normalizer does to it and it holds no added token."""
        if blob.translate(None, PLAIN) or b"\xc4\xb0" in blob:
            return None
        low = blob.translate(LOWER) if blob.isascii() else blob.decode().lower().encode()
        return None if any(t in low for t in self.added_low) else low

    def encode(self, blobs: list[bytes]):
        """(ids of all texts one after the other, where each text's start and end)."""
        import numpy as np

        if not self.known:
            found = [np.array(e.ids, "<u4") for e in self.whole.encode_batch_fast([b.decode() for b in blobs], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *found]), np.cumsum([0, *map(len, found)])
        lows = [self.plain(b) for b in blobs]
        odd = [k for k, x in enumerate(lows) if x is None]
        if not odd:
            return self.encode_words(lows, True)
        even = [k for k, x in enumerate(lows) if x is not None]
        found = [None] * len(blobs)
        for places, some, plain in ((even, [lows[k] for k in even], True), (odd, [blobs[k] for k in odd], False)):
            flat, bounds = self.encode_words(some, plain)
            for k, a, b in zip(places, bounds, bounds[1:]):
                found[k] = flat[a:b]
        return np.concatenate(found), np.cumsum([0, *map(len, found)])

    def encode_words(self, blobs: list[bytes], plain: bool):
        """As encode, of texts that are normalized but for their white space (plain) or that need the whole normalizer word by word."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        data, at = np.frombuffer(b"".join(blobs), np.uint8), np.cumsum([0, *map(len, blobs)])
        if plain and len(data):
            # a space between a letter and the mark after it leaves the pieces as they are and makes words recur
            letter = np.frombuffer(LETTER, bool)[data]
            letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # U+00C0 to U+00FF but the signs of multiplication and division
            cuts = np.flatnonzero(letter[:-1] & np.frombuffer(MARK, bool)[data[1:]]) + 1
            data, at = np.insert(data, cuts, 32), at + np.searchsorted(cuts, at)
        text = pa.Array.from_buffers(pa.string(), len(blobs), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
        split = pc.ascii_split_whitespace(text)
        coded = split.values.dictionary_encode()
        ids, sizes = self._encode(coded.dictionary, plain)
        pieces = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate([[0], sizes]), dtype=np.int32)), pa.array(ids))
        taken = pieces.take(coded.indices)
        return taken.flatten().to_numpy(), taken.offsets.to_numpy()[split.offsets.to_numpy()].astype(np.int64)

    def _encode(self, words, plain: bool):
        """(ids of all words one after the other, how many each has): words of letters in few calls, where word ends part them; all others one by one."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        letters = np.zeros(len(words), bool)
        if plain:
            letters = pc.and_(pc.utf8_is_alpha(words), pc.less(pc.binary_length(words), LEAF_CHARS)).to_numpy(zero_copy_only=False)
        whole, size = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        some = words.filter(pa.array(letters))
        for lo in range(0, len(some), CALL):
            part = some.slice(lo, CALL)
            ids = np.array(self.letters.encode_batch_fast([codecs.charmap_decode(glued(part), "strict", BYTE_LEVEL)[0]], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends_word[ids])
            if len(ends) != len(part):
                raise ValueError("the tokenizer file doesn't part words as expected")
            whole.append(ids)
            size.append(np.diff(ends, prepend=-1))
        rest = self._one_by_one(words.filter(pa.array(~letters)).to_pylist(), plain)
        sizes = np.zeros(len(words), np.int64)
        sizes[letters], sizes[~letters] = np.concatenate(size), [len(x) // 4 for x in rest]
        out = np.zeros(sizes.sum(), "<u4")
        of_letters = np.repeat(letters, sizes)
        out[of_letters], out[~of_letters] = np.concatenate(whole), np.frombuffer(b"".join(rest), "<u4")
        return out, sizes

    def _one_by_one(self, words: list[str], plain: bool) -> list[bytes]:
        tokenizer, memory = (self.bare, self.words) if plain else (self.whole, self.raw)
        out = list(map(memory.get, words))
        missing = [k for k, x in enumerate(out) if x is None]
        small = [k for k in missing if len(words[k]) <= LEAF_CHARS]
        for k, e in zip(small, tokenizer.encode_batch_fast([words[k] for k in small], add_special_tokens=False)):
            out[k] = array("I", e.ids).tobytes()
        for k in missing:
            if len(words[k]) > LEAF_CHARS:
                out[k] = self.assemble([(p, t, self.leaf(t) if p >= 0 else None) for p, t in self.leaves(words[k], LEAF_CHARS)])
            if len(memory) < REMEMBERED and len(words[k]) <= UNIT_CHARS:
                memory[words[k]] = out[k]
        return out

    def decode(self, flat, bounds):
        """The decoded texts (Arrow strings) of ids as encode gives them."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.joins_words:
            return pa.array(self.whole.decode_batch([flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])], skip_special_tokens=False), pa.string())
        # without a decoder the library puts a space between tokens
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), self.shown.take(pa.array(flat))), " ")

    # Long text: leaves and their tree.

    def leaves(self, text: str, leaf: int):
        """(place, text) of a text: added tokens as (-1, content), the rest normalized and halved; a place counts the leaf in its stretch, 0 the first."""
        low = self.plain(text.encode()) if self.known else None
        if low is not None:
            norm = low.decode()
            yield from ((k, norm[lo:hi]) for k, (lo, hi) in enumerate(halves(0, len(norm), leaf)))
            return
        at = 0
        for m in [*self.added_re.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            if part:
                norm = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
                for k, (lo, hi) in enumerate(halves(0, len(norm), leaf)):
                    yield k, norm[lo:hi]
            if m:
                yield -1, m.group()
                at = m.end()

    def leaf(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """ids, starts and ends of normalized text."""
        e = self.bare.encode(text, add_special_tokens=False)
        return e.ids, [a for a, _ in e.offsets], [b for _, b in e.offsets]

    def assemble(self, parts) -> bytes:
        """(place, text, leaf) in order to ids; a leaf is ids, starts, ends, both None where white space tells where its ends are."""
        out, run = [], []
        for p, t, x in [*parts, (0, "", None)]:
            if p <= 0 and run:
                out.append(array("I", self.tree(run)).tobytes())
                run = []
            if p < 0:
                out.append(array("I", [self.whole.token_to_id(t)]).tobytes())
            elif t:
                run.append((t, x))
        return b"".join(out)

    def tree(self, leaves: list) -> list[int]:
        """Leaves of one stretch to ids, joining neighbours pair by pair."""
        level = leaves
        while len(level) > 1:
            level = [self.join(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0][1][0]

    def _last(self, node, w: int):
        """(place, ids, starts, ends): a node's last tokens, from white space at least w characters before its end or from its start."""
        text, (ids, starts, ends) = node
        if starts is not None:
            return 0, ids, starts, ends
        p = max(0, *(text.rfind(c, 0, max(0, len(text) - w)) for c in SPACES))
        ids, starts, ends = self.leaf(text[p:])
        return p, ids, [x + p for x in starts], [x + p for x in ends]

    def _first(self, node, w: int):
        """(place, ids, starts, ends): a node's first tokens, up to white space w characters or more after its start or to its end."""
        text, (ids, starts, ends) = node
        if starts is not None:
            return len(text), ids, starts, ends
        q = min([x for x in (text.find(c, w) for c in SPACES) if x >= 0], default=len(text))
        return q, *self.leaf(text[:q])

    def join(self, left, right):
        (lt, (li, ls, le)), (rt, (ri, rs, re_)) = left, right
        cut, w = len(lt), 16
        while True:
            p, ti, ts, te = self._last(left, w)
            q, hi, hs, he = self._first(right, w)
            i = max(0, len(ti) - w)
            while i and (ts[i] < te[i - 1] or lt[ts[i]] == "'"):
                i -= 1
            j = min(len(hi), w)
            while j < len(hi) and hs[j] < he[j - 1]:
                j += 1
            a, b = (ts[i] if i else p), (cut + he[j - 1] if j < len(hi) else cut + q)
            ids, ws, we = self.leaf(lt[a:] + rt[: b - cut])
            ws, we = [x + a for x in ws], [x + a for x in we]
            ok = not i or bool(ids) and (ids[0], ws[0], we[0]) == (ti[i], ts[i], te[i]) and (len(ids) < 2 or ws[1] >= we[0])
            last, rest = len(ids), len(hi) if ok and j == len(hi) else None
            if ok and rest is None:
                theirs = {(hi[k], cut + hs[k], cut + he[k]): k for k in range(j - 1) if hs[k + 1] >= he[k] and (not k or hs[k] >= he[k - 1])}
                for k in range(len(ids) - 2, -1, -1):
                    if we[k] <= b - 4 and we[k] > cut and ws[k + 1] >= we[k] and (not k or ws[k] >= we[k - 1]) and (m := theirs.get((ids[k], ws[k], we[k]))) is not None:
                        last, rest = k + 1, m + 1
                        break
            if rest is not None:
                kept = len(li) - len(ti) + i
                starts = ends = None
                if ls is not None and rs is not None:
                    starts = ls[:kept] + ws[:last] + [x + cut for x in rs[rest:]]
                    ends = le[:kept] + we[:last] + [x + cut for x in re_[rest:]]
                return lt + rt, (li[:kept] + ids[:last] + ri[rest:], starts, ends)
            w *= 2


def halves(lo: int, hi: int, leaf: int):
    """[lo, hi) halved until no part is longer than leaf."""
    if hi - lo <= leaf:
        yield lo, hi
    else:
        mid = (lo + hi) // 2
        yield from halves(lo, mid, leaf)
        yield from halves(mid, hi, leaf)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def round_trip(docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), decoded (UTF-8) of every text; a null text counts as empty.

    Texts up to leaf_chars are encoded where they lie. Longer ones become rows of leaves that are dealt out anew, encoded
    in parallel and joined per document. Empty texts have no ids and decode to an empty text; repeated rows and rows with a
    null doc_id are kept, each by itself.
    """
    docs = texts(docs)
    short = docs.where(F.length("text") <= leaf_chars).mapInArrow(functools.partial(_whole, path=path), "doc_id long, ids binary, decoded binary")
    leaves = (
        docs.where(F.length("text") > leaf_chars)
        .withColumn("copy", F.monotonically_increasing_id())
        .mapInArrow(functools.partial(_cut, path=path, leaf=leaf_chars), "doc_id long, copy long, n int, place int, text string")
        .repartition("copy", "n")
        .mapInArrow(functools.partial(_leaves, path=path), "doc_id long, copy long, n int, place int, text string, ids binary, starts binary, ends binary")
    )
    long = leaves.groupBy("copy").applyInPandas(functools.partial(_grow, path=path), "doc_id long, ids binary, decoded binary")
    return short.unionByName(long)


def _binary(flat, bounds):
    """Arrow binary values of the runs of a 32-bit array."""
    import numpy as np
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


@tidy
def _whole(batches, path):
    import pyarrow as pa

    enc = encoder(path)
    for batch in batches:
        for part in slices(batch, AT_ONCE):
            flat, bounds = enc.encode(part.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _binary(flat, bounds), enc.decode(flat, bounds).cast(pa.binary())], ["doc_id", "ids", "decoded"])


@tidy
def _cut(batches, path, leaf):
    import pyarrow as pa

    enc = encoder(path)
    for batch in batches:
        for k in range(batch.num_rows):
            d, c, t = (batch.column(x)[k].as_py() for x in ("doc_id", "copy", "text"))
            got = list(enc.leaves(t, leaf)) if enc.known else [(-2, t)]
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(got), pa.int64()), pa.array([c] * len(got), pa.int64()), pa.array(range(len(got)), pa.int32()), pa.array([p for p, _ in got], pa.int32()), pa.array([x for _, x in got], pa.string())], ["doc_id", "copy", "n", "place", "text"])


def leaf_rows(enc: Encoder, places: list[int], leaves: list[str]) -> list[tuple]:
    """ids, starts, ends of each leaf: with offsets where no white space is, by the fast way where it is."""
    out: list = [([], None, None)] * len(places)
    spaced = [k for k, p in enumerate(places) if p >= 0 and any(c in leaves[k] for c in SPACES)]
    if spaced:
        flat, bounds = enc.encode_words([leaves[k].encode() for k in spaced], True)
        for k, a, b in zip(spaced, bounds, bounds[1:]):
            out[k] = (flat[a:b].tolist(), None, None)
    for k in sorted({k for k, p in enumerate(places) if p >= 0} - set(spaced)):
        out[k] = enc.leaf(leaves[k])
    for k, p in enumerate(places):
        if p == -2:
            out[k] = (array("I", enc.ids([leaves[k].encode()])[0]).tolist(), None, None)
    return out


@tidy
def _leaves(batches, path):
    import pyarrow as pa

    enc = encoder(path)
    for batch in batches:
        for part in slices(batch):
            got = leaf_rows(enc, part.column("place").to_pylist(), part.column("text").to_pylist())
            held = [pa.array([None if x[k] is None else array("I", x[k]).tobytes() for x in got], pa.binary()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*part.columns, *held], [*part.schema.names, "ids", "starts", "ends"])


def _grow(pdf, path):
    import numpy as np
    import pandas as pd

    enc, out, run = encoder(path), [], []
    numbers = lambda b: None if b is None else array("I", b).tolist()
    for row in pdf.sort_values("n").itertuples():
        if row.place == -2:
            out.append(row.ids)
        else:
            run.append((row.place, row.text, (numbers(row.ids), numbers(row.starts), numbers(row.ends))))
    ids = b"".join([*out, enc.assemble(run)])
    flat = np.frombuffer(ids, "<u4")
    return pd.DataFrame({"doc_id": pdf.doc_id.iloc[:1].to_numpy(), "ids": [ids], "decoded": [enc.decode(flat, np.array([0, len(flat)]))[0].as_py().encode()]})


def digests(df: DataFrame) -> DataFrame:
    """The columns of op9 from ids and decoded."""
    return df.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
