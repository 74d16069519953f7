"""Operator 4: language-model scoring with Brown classes.

Words are clustered as units: every word of LEAST occurrences or more is one, all others belong to a unit by their ending.
The exchange algorithm assigns units to classes from the corpus's unit bigrams, moving a unit where the average mutual
information of neighbouring classes grows most: first the most frequent words and the endings on the driver, then all units
in the tasks, until a round over all units gains next to nothing. A text's probability is the product over its tokens of
the class transition, the unit within its class, and the word within its unit. In each ending unit a discount of the seen
words pays for the unknown ones, among which a model of their bytes divides it.
"""

from __future__ import annotations

import functools
import math
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, fold, give_back, listed, slices, split_words, texts, through_table, tidy

#: Frequent words that the first exchange, on the driver, starts from; ending units; classes; sweeps of that first exchange.
FREQUENT, ENDINGS, CLASSES, SWEEPS = 1000, 256, 48, 6
#: Occurrences from which a word is a unit of its own; if more than UNITS words have as many, the most frequent ones are:
#: tasks hold 18 bytes a unit, so 36 MB at most.
LEAST, UNITS = 10, 2_000_000
#: The exchange ends when a round over all units gains less than this share of the information that the classes have.
TOLERANCE = 0.002
#: Share of all tokens beyond which a unit moves with a smaller chance.
AT_A_TIME = 0.001
#: Bigrams of one unit that a task holds; those of more frequent units are dealt out by the neighbour.
SPLIT = 1 << 20
#: Bigrams that a task gathers before it hands them on; bigrams in a row of their table.
GATHER, PACK = 1 << 20, 1 << 20
#: Words, the most frequent, whose counts every task holds; the counts of all others are joined.
HELD = 150_000
END = b"\n"  # no word can be this
#: Rows of a text table and of the bigrams' table (megabytes each) that a task gets at once.
TEXTS, PACKS = 2000, 2
#: Distinct words of runs of texts that a task gathers before it hands them on; bytes of text in a run.
FLUSH, AT_ONCE = 200_000, 2 << 20
#: Spelling of unknown words: symbols for bytes (0 a word's start and end, 1 any byte that is rare); pseudo-counts of the shorter context.
SYMBOLS, SPELL = 96, 5.0
#: Bytes that a word can have.
BYTES = [b for b in range(256) if not (9 <= b <= 13 or b == 32 or 65 <= b <= 90)]


def ending(w: bytes) -> int:
    return zlib.crc32(w[-3:]) % ENDINGS


def ending_of(word: Column) -> Column:
    return F.pmod(F.crc32(F.when(F.length(word) > 3, F.substring(word, -3, 3)).otherwise(word)), F.lit(ENDINGS)).cast("int")


def training(docs: DataFrame) -> DataFrame:
    return texts(docs).where(F.coalesce(fold(F.col("doc_id")), F.lit(0)) != 1)


def count_words(docs: DataFrame) -> DataFrame:
    """word, c, ending, h (xxhash64) over all training tokens; the end token is END."""
    counts = training(docs).mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return counts.select("word", "c", ending_of(F.col("word")).alias("ending"), F.xxhash64("word").alias("h"))


@tidy
def _count(batches):
    import numpy as np
    import pyarrow as pa

    def out():
        every = pa.table({"word": pa.chunked_array([w for w, _ in held], pa.string()), "c": np.concatenate([n for _, n in held])})
        got = every.group_by("word", use_threads=False).aggregate([("c", "sum")])
        got = pa.table({"word": got.column("word").cast(pa.binary()), "c": got.column("c_sum")})
        yield from got.filter(pa.compute.greater(got.column("c"), 0)).to_batches()

    held, size = [], 0
    for batch in batches:
        for part in slices(batch, AT_ONCE):
            words, tokens, bounds = split_words(part.column("text"))
            held += [(words, np.bincount(tokens, minlength=len(words))), (pa.array([END.decode()]), np.array([len(bounds) - 1]))]
            size += len(words)
            if size > FLUSH:
                yield from out()
                held, size = [], 0
    if held:
        yield from out()


def hashes(words: list[bytes]):
    """Spark's xxhash64 of words."""
    import numpy as np
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64).view(np.int64)


class Units:
    """Words to units: 0 the end token, then the frequent words, then endings, then every other word that is a unit of its own.

    frequent: hashes in that order; own: sorted hashes."""

    def __init__(self, frequent, own):
        import numpy as np

        self.base = 1 + len(frequent)
        self.n = self.base + ENDINGS
        keys = np.concatenate([np.array(frequent, np.int64), np.array(own, np.int64)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], order.astype(np.int32)

    def __call__(self, words: list[bytes]):
        import numpy as np

        h = hashes(words)
        if not len(self.keys):
            return np.array([self.base + ending(w) for w in words], np.int64)
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        at = self.at[k].astype(np.int64)
        unit = np.where(at < self.base - 1, 1 + at, at + 1 + ENDINGS)
        rest = np.flatnonzero(self.keys[k] != h)
        unit[rest] = [self.base + ending(words[x]) for x in rest.tolist()]
        return unit

    def is_ending(self, unit):
        return (unit >= self.base) & (unit < self.n)


def bigrams(docs: DataFrame, sent) -> DataFrame:
    """Counts of unit bigrams, packed: rows of units with the number of their entries, and per entry the neighbour, its side
    (0 follows, 1 comes before) and the count; every text starts after an end.

    A unit's rows lie in one partition, in one row of the table; those of units of over SPLIT tokens in several.
    """
    dealt = training(docs).mapInArrow(functools.partial(_bigrams, sent=sent), "unit int, slot int, entries binary")
    packed = dealt.repartition("unit", "slot").sortWithinPartitions("unit").mapInArrow(_pack, "units binary, sizes binary, other binary, n binary")
    return through_table(packed, "bigrams")


@tidy
def _bigrams(batches, sent):
    import numpy as np
    import pyarrow as pa

    m = sent.value
    units, parts = Units(m["frequent"], m["own"]), m["parts"]

    def out(seqs):
        key, n = np.unique(np.concatenate([(a[:-1].astype(np.int64) << 32) | a[1:] for a in seqs]), return_counts=True)
        u, v, n = (key >> 32).astype(np.int32), key.astype(np.int32), n.astype(np.int32)
        del key
        unit, other, n = np.concatenate([u, v]), np.concatenate([2 * v, 2 * u + 1]), np.concatenate([n, n])
        del u, v
        slot = ((other >> 1) % parts[unit]).astype(np.int32)
        order = np.lexsort((slot, unit))
        unit, slot = unit[order], slot[order]
        rows = np.stack([other[order], n[order]], axis=1)
        del order, other, n
        cuts = np.flatnonzero((np.diff(unit) != 0) | (np.diff(slot) != 0)) + 1
        starts = np.concatenate([[0], cuts])
        for lo in range(0, len(starts), 20_000):
            some = starts[lo : lo + 20_000]
            end = starts[lo + 20_000] if lo + 20_000 < len(starts) else len(unit)
            offsets = np.concatenate([some, [end]]) - some[0]
            entries = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((8 * offsets).astype(np.int32).tobytes()), pa.py_buffer(rows[some[0] : end].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(unit[some], pa.int32()), pa.array(slot[some], pa.int32()), entries], ["unit", "slot", "entries"])

    held, size = [], 0
    for batch in batches:
        for part in slices(batch, AT_ONCE):
            words, tokens, bounds = split_words(part.column("text"))
            seq = np.insert(units(listed(words))[tokens], bounds, 0)  # an end before the first text and after each
            held.append(seq.astype(np.int32))
            size += len(seq)
            if size >= GATHER:
                yield from out(held)
                held, size = [], 0
    if held:
        yield from out(held)


@tidy
def _pack(batches):
    import numpy as np
    import pyarrow as pa

    def out(units, blobs):
        sizes = np.array([len(b) // 8 for b in blobs])
        e = np.frombuffer(b"".join(blobs), np.int32).reshape(-1, 2)
        u, at = np.unique(np.array(units, np.int64), return_inverse=True)
        key, inverse = np.unique((np.repeat(at, sizes) << 32) | e[:, 0].astype(np.int64), return_inverse=True)
        n = np.bincount(inverse, weights=e[:, 1]).astype(np.int32)
        columns = [u.astype(np.int32), np.bincount(key >> 32, minlength=len(u)).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), n]
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["units", "sizes", "other", "n"])

    units, blobs, size = [], [], 0
    for batch in batches:
        for u, b in zip(batch.column("unit").to_pylist(), batch.column("entries").to_pylist()):
            if size >= PACK and u != units[-1]:
                yield out(units, blobs)
                units, blobs, size = [], [], 0
            units.append(u)
            blobs.append(b)
            size += len(b) // 8
    if units:
        yield out(units, blobs)


def _unpacked(batches, only=None):
    """Units, the place of each entry's unit among them, neighbour, side, count; of all units or those that are True in only."""
    import numpy as np

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("units", "sizes", "other", "n"))):
            units, sizes, other, n = (np.frombuffer(x, np.int32) for x in row)
            if only is not None:
                some = only[units]
                if not some.any():
                    continue
                k = np.repeat(some, sizes)
                units, sizes, other, n = units[some], sizes[some], other[k], n[k]
            yield units, np.repeat(np.arange(len(units)), sizes), other >> 1, other & 1, n


def _coarse(batches, sent):
    """Bigram counts of core words and endings, the words of their own counted with their ending."""
    import numpy as np
    import pyarrow as pa

    n = sent.value["n"]
    to = sent.value["coarse"]
    total = np.zeros(n * n, np.int64)
    for units, at, other, side, c in _unpacked(batches):
        k = side == 0
        key, inverse = np.unique(to[units][at[k]] * n + to[other[k]], return_inverse=True)
        total[key] += np.bincount(inverse, weights=c[k]).astype(np.int64)
    rows = [(u, zlib.compress(x.tobytes(), 1)) for u, x in enumerate(total.reshape(n, n)) if x.any()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["unit", "counts"])


def _sum(pdf):
    import numpy as np
    import pandas as pd

    total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in pdf.counts)
    return pd.DataFrame({"unit": pdf.unit.iloc[:1].to_numpy(), "counts": [zlib.compress(total.tobytes(), 1)]})


def _class_pairs(batches, sent):
    import numpy as np
    import pyarrow as pa

    of, was, classes = sent.value
    total, moved = np.zeros(classes * classes), None if was is None else of != was
    for units, at, other, side, c in _unpacked(batches, moved):
        u = units[at]
        # a pair of moved units counts once, where the first of them is
        k = (side == 0) if was is None else (side == 0) | ~moved[other]
        first, second, c = np.where(side == 0, u, other)[k], np.where(side == 0, other, u)[k], c[k]
        for x, sign in ((of, 1), *([] if was is None else [(was, -1)])):
            total += sign * np.bincount(x[first].astype(np.int64) * classes + x[second], weights=c, minlength=classes * classes)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["pairs"])


def class_pairs(packed: DataFrame, of, classes: int, was=None, pair=0):
    """The square array of class bigram counts; each task sends its own. With classes `was` and their `pair`, from the bigrams of moved units."""
    import numpy as np

    sent = packed.sparkSession.sparkContext.broadcast((of, was, classes))
    got = packed.mapInArrow(functools.partial(_class_pairs, sent=sent), "pairs binary").collect()
    sent.unpersist()
    return pair + sum((np.frombuffer(bytes(r.pairs)) for r in got), np.zeros(classes * classes)).reshape(classes, classes)


def _parts(seen):
    import numpy as np

    return (1 + seen // SPLIT).astype(np.int64)


def _xlogx(x):
    import numpy as np

    return x * np.log(np.maximum(x, 1e-300))


def information(pair) -> float:
    return float(_xlogx(pair).sum() - _xlogx(pair.sum(1)).sum() - _xlogx(pair.sum(0)).sum())


def gains(a, b, own, c, pair):
    """By how much information() grows if a unit moves from class c to each class, one row per unit. a and b: the counts of
    the classes after and before it, own: of itself after itself (which a and b don't count)."""
    import numpy as np

    h, hp, m = _xlogx, _xlogx(pair), np.arange(len(c))
    left, right, diag = pair.sum(1), pair.sum(0), np.diag(pair)
    own = own[:, None]

    def added(x, cells, hc):  # sum over d of h(cells[t, d] + x[d]) - hc[t, d]
        i, d = np.nonzero(x)
        out = np.zeros(x.shape)
        if len(i):
            starts = np.flatnonzero(np.diff(i, prepend=-1))
            out[i[starts]] = np.add.reduceat(h(cells.T[d] + x[i, d][:, None]) - hc.T[d], starts, axis=0)
        return out

    ac, bc = a[m, c][:, None], b[m, c][:, None]
    row, col, hrow, hcol = pair[c], pair.T[c], hp[c], hp.T[c]  # cells (c, t) and (t, c)
    less_a, less_b = h(row - a) - hrow, h(col - b) - hcol
    out = added(a, pair, hp) - (h(col + ac) - hcol) - (h(diag + a) - np.diag(hp))
    out += added(b, pair.T, hp.T) - (h(row + bc) - hrow) - (h(diag + b) - np.diag(hp))
    out += (less_a.sum(1) - less_a[m, c])[:, None] - less_a + (less_b.sum(1) - less_b[m, c])[:, None] - less_b
    out += h(diag[c][:, None] - ac - bc - own) - hp[c, c][:, None] + h(diag + a + b + own) - np.diag(hp)
    out += h(row - a + bc) - hrow + h(col + ac - b) - hcol
    for x, total in ((a, left), (b, right)):
        n = x.sum(1, keepdims=True) + own
        out -= h(total + n) - h(total) + (h(total[c][:, None] - n) - h(total[c][:, None]))
    out[m, c] = 0
    out[:, 0] = -np.inf
    return out


def _choose(units, vectors, of, pair):
    """(units that gain by a move, their classes): vectors are rows of classes after, classes before, own pair."""
    import numpy as np

    k, go, to = len(pair), [], []
    for lo in range(0, len(units), 1024):
        u, v = units[lo : lo + 1024], vectors[lo : lo + 1024]
        c, m = of[u].astype(np.int64), np.arange(len(u))
        a, b, own = v[:, :k].copy(), v[:, k : 2 * k].copy(), v[:, 2 * k]
        a[m, c] -= own
        b[m, c] -= own
        g = gains(a, b, own, c, pair)
        best = g.argmax(1)
        # less than rounding errors of the sums is no gain
        yes = (g[m, best] > 1e-9 * pair.sum() ** 0.5 + 1e-6) & (u > 0)
        go.append(u[yes])
        to.append(best[yes])
    return np.concatenate(go or [np.zeros(0, np.int64)]), np.concatenate(to or [np.zeros(0, np.int64)])


def _moves(batches, sent):
    import numpy as np
    import pyarrow as pa

    of, parts, pair = sent.value
    k = len(pair)
    for units, at, other, side, c in _unpacked(batches):
        vectors = np.zeros((len(units), 2 * k + 1))
        vectors[:, : 2 * k] = np.bincount(at * (2 * k) + side * k + of[other], weights=c, minlength=len(units) * 2 * k).reshape(-1, 2 * k)
        self_ = (side == 0) & (other == units[at])
        vectors[at[self_], 2 * k] = c[self_]
        whole = parts[units] == 1
        u, to = _choose(units[whole], vectors[whole], of, pair)
        some = np.flatnonzero(~whole)
        blobs = [None] * len(u) + [vectors[x].tobytes() for x in some]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, units[some]]), pa.int32()), pa.array(np.concatenate([to, np.zeros(len(some), np.int64)]), pa.int32()), pa.array(blobs, pa.binary())], ["unit", "to", "vector"])


def exchange_all(packed: DataFrame, of, seen, classes: int, tolerance: float = TOLERANCE):
    """Classes of all units and their pair counts, from the start in `of`, when no unit gains by a move or when a round over
    all units gains no more than `tolerance` of the information that the classes have over one class for all.

    seen: tokens of every unit. Every task finds the moves of its units against the classes as they are; units of over SPLIT
    tokens, few for any corpus, are summed and moved on the driver. Moves at once may hinder each other, those of frequent
    units most: a unit moves with a chance that falls with its tokens beyond AT_A_TIME of all. If the moves lose
    information, they are taken back and the chances fall to a quarter, down to a single move, which always gains.
    """
    import numpy as np

    sc = packed.sparkSession.sparkContext
    pair = class_pairs(packed, of, classes)
    value, share, rnd, rounds, n, parts = information(pair), 1.0, np.random.default_rng(1), 0, pair.sum(), _parts(seen)
    while True:
        sent = sc.broadcast((of, parts, pair))
        got = packed.mapInArrow(functools.partial(_moves, sent=sent), "unit int, to int, vector binary").toArrow()
        sent.unpersist()
        unit, to = got.column("unit").to_numpy(), got.column("to").to_numpy()
        hot = np.flatnonzero(~got.column("vector").is_null().to_numpy(zero_copy_only=False))
        if len(hot):
            u, at = np.unique(unit[hot], return_inverse=True)
            vectors = np.zeros((len(u), 2 * classes + 1))
            for k, blob in zip(at.tolist(), got.column("vector").take(hot).to_pylist()):
                vectors[k] += np.frombuffer(blob)
            hu, ht = _choose(u, vectors, of, pair)
            unit, to = np.concatenate([np.delete(unit, hot), hu]), np.concatenate([np.delete(to, hot), ht])
        del got
        give_back()
        if not len(unit):
            return of, pair
        order = np.argsort(unit, kind="stable")
        while True:
            take = order[rnd.random(len(order)) < np.minimum(1 if share == 1 else 0.5, share * AT_A_TIME * n / np.maximum(seen[unit[order]], 1))]
            take = take if len(take) else order[[rnd.integers(len(order))]]
            new = of.copy()
            new[unit[take]] = to[take]
            new_pair = class_pairs(packed, new, classes, of, pair)
            new_value = information(new_pair)
            rounds += 1
            if PROGRESS:
                PROGRESS(rounds, len(unit), len(take), value, new_value, value + n * math.log(max(n, 1)))
            if new_value > value or len(take) == 1:
                break
            share /= 4
        if new_value <= value:  # a gain below what the sums can tell
            return of, pair
        gain, of, pair, value, share = new_value - value, new, new_pair, new_value, min(1.0, 2 * share)
        if gain <= tolerance * (value + n * math.log(max(n, 1))):
            return of, pair


#: Called once per round, if set: round, units that would gain, units moved, information before and after, and before above that of one class.
PROGRESS = None


def exchange(counts, classes: int = CLASSES, sweeps: int = SWEEPS):
    """Class of every unit from the square array of bigram counts; unit 0, the end, keeps class 0 for itself.

    Start: the most frequent units a class each, the others dealt in turn. Each sweep takes every unit out of its class
    and puts it where sum over class pairs of n log n - 2 sum over classes of n log n is largest; ties keep the lowest class.
    """
    import numpy as np

    n = len(counts)
    classes = max(2, min(classes, n))
    counts = counts.astype(np.float64)
    size = np.maximum(counts.sum(0), counts.sum(1))
    order = [u for u in np.argsort(-size, kind="stable").tolist() if u]
    of = np.zeros(n, np.int64)
    for k, u in enumerate(order):
        of[u] = 1 + k % (classes - 1)
    h = lambda x: x * np.log(np.maximum(x, 1e-300))
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    pair, after, before = member.T @ counts @ member, counts @ member, counts.T @ member
    left, right = pair.sum(1), pair.sum(0)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not size[u]:
                continue
            c, a, b, own = of[u], after[u].copy(), before[u].copy(), counts[u, u]
            # without u: a and b hold its neighbours by class, its own pair apart
            a[c] -= own
            b[c] -= own
            pair[c] -= a
            pair[:, c] -= b
            pair[c, c] -= own
            out, into = counts[u].sum(), counts[:, u].sum()
            left[c] -= out
            right[c] -= into
            hp = h(pair)
            row, col, diag = h(pair + a).sum(1) - hp.sum(1), h(pair + b[:, None]).sum(0) - hp.sum(0), np.diag(pair)
            # the diagonal cell gets a, b and the unit's own pair at once
            cell = h(diag + a + b + own) - h(diag + a) - h(diag + b) + h(diag)
            gain = row + col + cell - (h(left + out) - h(left)) - (h(right + into) - h(right))
            gain[0] = -np.inf
            to = int(np.argmax(gain))
            if gain[to] <= gain[c] + 1e-9:
                to = c
            pair[to] += a
            pair[:, to] += b
            pair[to, to] += own
            left[to] += out
            right[to] += into
            if to != c:
                moved += 1
                of[u] = to
                after[:, c] -= counts[:, u]
                after[:, to] += counts[:, u]
                before[:, c] -= counts[u]
                before[:, to] += counts[u]
        if not moved:
            break
    return of


def least_count(words: DataFrame, n: int) -> int:
    """The smallest count such that at most n words have as many, down to a step of the counts' logarithm."""
    steps = words.groupBy(F.floor(64 * F.log2("c")).alias("step")).agg(F.count("*").alias("k"), F.min("c").alias("c")).collect()  # a few thousand
    have, least = 0, None
    for r in sorted(steps, key=lambda r: -r.step):
        have += r.k
        if have > n:
            break
        least = r.c
    return least if least is not None else max((r.c for r in steps), default=0) + (1 << 30)


class Spelling:
    """Probabilities of words by their bytes, each after the two before it: p over symbols, symbol of each byte, and each
    byte's share of its symbol."""

    def __init__(self, symbol, share, n):
        """n: counts of symbol triples."""
        import numpy as np

        k = len(n)
        one = n.sum((0, 1)) + 0.5
        two = n.sum(0) + SPELL * one / one.sum()
        two[0, 0] = 0
        two /= two.sum(1, keepdims=True)
        three = n + SPELL * two
        three[0, 0, 0] = 0
        self.symbol, self.share, self.p = symbol, share, three / np.maximum(three.sum(2, keepdims=True), 1e-300)
        # expected visits of the last two symbols
        start = np.zeros((k, k))
        start[0] = self.p[0, 0]
        step = self.p.copy()
        step[:, :, 0] = 0
        step[:, 0] = 0
        visits = start
        while True:
            new = start + np.einsum("xy,xyz->yz", visits, step)
            if abs(new - visits).max() < 1e-12:
                break
            visits = new
        self.visits = visits

    def ending_shares(self):
        """The probability that a word is of each ending unit, exactly."""
        import numpy as np

        step = np.array([_crc_step(b) for b in range(256)], np.uint32)
        byte = np.array(BYTES, np.uint32)
        g, w, p = self.symbol[BYTES], self.share[BYTES], self.p
        unit = lambda crc: (~crc % ENDINGS).ravel()
        total = lambda crc, x: np.bincount(unit(crc), weights=x.ravel(), minlength=ENDINGS)
        one = step[(0xFFFFFFFF ^ byte) & 255] ^ np.uint32(0xFFFFFF)
        shares = total(one, w * p[0, 0, g] * p[0, g, 0])
        end = p[g[:, None], g[None, :], 0] * w[None, :]  # of the last byte, given the one before it
        for k in range(len(byte)):
            two = step[(one[k] ^ byte) & 255] ^ (one[k] >> 8)
            shares += total(two, w[k] * p[0, 0, g[k]] * p[0, g[k], g] * w * p[g[k], g, 0])
            three = step[(two[:, None] ^ byte[None, :]) & 255] ^ (two[:, None] >> 8)
            shares += total(three, w[k] * (self.visits[g[k], g] * w)[:, None] * p[g[k], g][:, g] * end)
        return shares

    def logs(self, words: list[bytes]):
        """Logarithm of each word's probability."""
        import numpy as np

        data = np.frombuffer(b"  " + b"  ".join(words) + b" ", np.uint8)
        g = self.symbol[data]
        edge = np.flatnonzero(data == 32)
        starts = edge[:-1:2]  # of the two before each word
        with np.errstate(divide="ignore"):
            each = np.log10(self.p[g[:-2], g[1:-1], g[2:]]) + np.log10(self.share[data[2:]])
        gap = starts[1:] - 1  # what would lead from one word to the next
        each[gap] = 0
        return np.add.reduceat(each, starts)


def spelling(words: DataFrame) -> Spelling:
    """Learned from the words that occur once, which are most like unknown ones."""
    import numpy as np

    once = words.where("c = 1").select("word")
    n = np.zeros(256)
    for r in once.mapInArrow(_bytes, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        n[r.byte] = r.n
    order = sorted(BYTES, key=lambda b: (-n[b], b))[: SYMBOLS - 2]
    symbol, share = np.ones(256, np.int64), np.zeros(256)
    symbol[32], share[32] = 0, 1
    symbol[order], share[order] = 2 + np.arange(len(order)), 1
    rare = sorted(set(BYTES) - set(order))
    share[rare] = 1 / len(rare)
    triples = np.zeros((SYMBOLS, SYMBOLS, SYMBOLS))
    for r in once.mapInArrow(functools.partial(_triples, symbol=symbol), "triple int, n long").groupBy("triple").agg(F.sum("n").alias("n")).collect():  # at most SYMBOLS ** 3
        triples.ravel()[r.triple] = r.n
    return Spelling(symbol, share, triples)


def _bytes(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        n = np.bincount(np.frombuffer(b"".join(batch.column("word").to_pylist()), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(n)], ["byte", "n"])


def _triples(batches, symbol):
    import numpy as np
    import pyarrow as pa

    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        data = np.frombuffer(b"  " + b"  ".join(batch.column("word").to_pylist()) + b" ", np.uint8)
        g = symbol[data]
        key = (g[:-2] * SYMBOLS + g[1:-1]) * SYMBOLS + g[2:]
        # not from a word over its end: an edge follows an edge only before a word
        total += np.bincount(key[~((g[1:-1] == 0) & ((g[:-2] > 0) | (g[2:] == 0)))], minlength=len(total))
    k = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(total[k])], ["triple", "n"])


def _crc_step(x: int) -> int:
    for _ in range(8):
        x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
    return x


def fit(docs: DataFrame, frequent: int = FREQUENT, held: int = HELD, classes: int = CLASSES, tolerance: float = TOLERANCE):
    """(counts of all words as a table, model): the model holds the rest, see _score; of it only the hashes, classes and
    shares of the words that are units grow with the vocabulary, by 18 bytes each, and UNITS bounds them."""
    import numpy as np

    spark = docs.sparkSession
    table = through_table(count_words(docs), "words")
    words = table.where(F.col("word") != F.lit(bytearray(END)))
    total = table.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(bytearray(END)), F.col("c"))), F.lit(0)).alias("ends"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    least = max(LEAST, least_count(words, UNITS))
    core = words.where(F.col("c") >= least).orderBy(F.desc("c"), "word").limit(frequent).collect()
    more = words.where(F.col("c") >= least).select("h", "c", "ending").toArrow()
    own, own_c, own_e = (more.column(c).to_numpy() for c in ("h", "c", "ending"))
    core_h = np.array([r.h for r in core], np.int64)
    rest = ~np.isin(own, core_h)
    own, first = np.unique(own[rest], return_index=True)
    own_c, own_e = own_c[rest][first], own_e[rest][first]
    units = Units(core_h, own)
    # of an ending unit: tokens and distinct words that aren't units of their own
    n_e, v_e = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in words.where(F.col("c") < least).groupBy("ending").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        n_e[r.ending], v_e[r.ending] = r.n, r.v
    seen = np.concatenate([[total.ends], [r.c for r in core], n_e, own_c]).astype(np.float64)  # every token follows something
    parts = _parts(seen)
    sent = spark.sparkContext.broadcast({"frequent": core_h, "own": own, "parts": parts, "n": units.n, "coarse": np.concatenate([np.arange(units.n), units.base + own_e]).astype(np.int64)})
    packed = bigrams(docs, sent)
    counts = np.zeros((units.n, units.n), np.int64)
    with batches_of(spark, PACKS):
        for r in packed.mapInArrow(functools.partial(_coarse, sent=sent), "unit int, counts binary").groupBy("unit").applyInPandas(_sum, "unit int, counts binary").collect():  # at most one row per unit of the start
            counts[r.unit] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64)
        of = exchange(counts, classes)
        k = int(of.max()) + 1
        del counts, core, more, own_c
        give_back()  # the driver lives on
        of, pair = exchange_all(packed, np.concatenate([of, of[units.base + own_e]]).astype(np.int16), seen, k, tolerance)
    of = of.astype(np.int64)
    share = (np.bincount(of, weights=seen, minlength=k) + 0.5) / (seen.sum() + 0.5 * k)
    mass = 5.0  # pseudo-counts of the class's overall share
    trans = (pair + mass * share) / (pair.sum(1, keepdims=True) + mass)
    # a unit within its class: ending units get a pseudo-count, since an unknown word may come first there
    unit_n = seen + np.concatenate([np.zeros(units.base), np.full(ENDINGS, 0.5), np.zeros(len(own))])
    of_class = np.bincount(of, weights=unit_n, minlength=k)
    within = unit_n / np.maximum(of_class[of], 1e-300)
    discount = min(0.95, max(0.05, total.once / max(1, total.once + 2 * total.twice)))
    log = lambda x: np.log10(np.maximum(x, 1e-300))
    spelled = spelling(words)
    kept = words.where(F.col("c") >= least_count(words, held)).select("h", "c").toArrow()
    held_h, first = np.unique(kept.column("h").to_numpy(), return_index=True)
    model = {
        "frequent": core_h, "own": own, "held": held_h, "held_c": kept.column("c").to_numpy()[first], "classes": of.astype(np.int16), "trans": log(trans), "within": log(within), "ends": total.ends, "n": total.n, "v": total.v, "least": least,
        "discount": discount, "ending_n": n_e, "unknown": np.where(n_e > 0, log(discount * v_e / np.maximum(n_e, 1)), 0.0), "spelled": spelled, "ending_share": log(spelled.ending_shares()),
    }
    return table, model


def unknown_words(words: list[bytes], m: dict):
    """Logarithm of each word's probability in its ending unit as an unknown one: the unit's share of unknown words, and the
    word's spelling among all words of that ending."""
    import numpy as np

    if not words:
        return np.zeros(0)
    e = np.array([ending(w) for w in words])
    return m["unknown"][e] + m["spelled"].logs(words) - m["ending_share"][e]


def score(docs: DataFrame, frequent: int = FREQUENT, held: int = HELD, classes: int = CLASSES, tolerance: float = TOLERANCE) -> DataFrame:
    """The columns of op4 for every document row.

    Null and empty texts have the end token alone, and very long ones are like any other. Repeated rows are kept and score
    alike (rows are told apart by a row number, not by doc_id); a null doc_id belongs to training. Without training rows
    every word is unknown and N is 0. Held words are scored where the text lies; each other word of a text is sent once,
    with its number of occurrences, to its count.
    """
    spark = docs.sparkSession
    with batches_of(spark, TEXTS):
        return _scored(docs, *fit(docs, frequent, held, classes, tolerance))


def _scored(docs: DataFrame, counts: DataFrame, model: dict) -> DataFrame:
    spark = docs.sparkSession
    rows = texts(docs).withColumn("row", F.monotonically_increasing_id())
    sent = spark.sparkContext.broadcast(model)
    got = through_table(rows.mapInArrow(functools.partial(_score, sent=sent), "doc_id long, row long, n_tokens long, n_known long, base double, score double, rest array<struct<word:binary,k:bigint,taken:double>>"), "scored")
    discount, n, v = model["discount"], model["n"], model["v"]
    ending_n = F.lit([float(x) for x in model["ending_n"]])
    # what the task took for unknown is put right by the words that have a count
    rest = got.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.k", "r.taken")
    known = rest.join(counts, "word").select(
        "row",
        "k",
        (F.col("k") * (F.log10((F.col("c") + 0.5) / F.lit(0.5)))).alias("base"),
        F.when(F.col("c") >= model["least"], 0.0).otherwise(F.col("k") * (F.log10((F.col("c") - discount) / ending_n[F.col("ending")]) - F.col("taken"))).alias("score"),  # units of their own have no more to add
    )
    per = known.groupBy("row").agg(F.sum("k").alias("k"), F.sum("base").alias("b"), F.sum("score").alias("s"))
    out = got.drop("rest").join(per, "row", "left")
    fill = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + fill("k")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + fill("b")).alias("base_score"),
        (F.col("score") + fill("s")).alias("score"),
        F.lit(v).cast("long").alias("train_types"),
    )


@tidy
def _score(batches, sent):
    import numpy as np
    import pyarrow as pa

    m = sent.value
    units = Units(m["frequent"], m["own"])
    denominator = math.log10(m["n"] + 0.5 * (m["v"] + 1))
    classes, within, trans = m["classes"], m["within"], m["trans"]
    kind = pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64()), ("taken", pa.float64())]))
    for batch in batches:
        for part in slices(batch, AT_ONCE):
            words, tokens, bounds = split_words(part.column("text"))
            words = listed(words)
            # by distinct word, the end token last
            h, unit = hashes(words), np.append(units(words), 0)
            at = np.minimum(np.searchsorted(m["held"], h), max(0, len(m["held"]) - 1))
            known = m["held"][at] == h if len(m["held"]) else np.zeros(len(words), bool)
            c = np.append(np.where(known, m["held_c"][at], 0) if len(m["held"]) else np.zeros(len(words), np.int64), m["ends"])
            by_ending = units.is_ending(unit)
            word = np.zeros(len(words) + 1)
            k = np.flatnonzero(by_ending & (c > 0))
            word[k] = np.log10((c[k] - m["discount"]) / m["ending_n"][unit[k] - units.base])
            k = np.flatnonzero(by_ending[:-1] & ~known)
            word[k] = unknown_words([words[x] for x in k.tolist()], m)
            base = np.log10(c + 0.5) - denominator
            seq = np.insert(tokens, bounds[1:], len(words))
            starts = bounds[:-1] + np.arange(len(bounds) - 1)
            g = classes[unit[seq]].astype(np.int64)
            before = np.append(classes[0], g[:-1])
            before[starts] = classes[0]
            total = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
            # per text, its distinct words that aren't held
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            out = ~known[tokens]
            pairs, n = np.unique(text[out] * (len(words) + 1) + tokens[out], return_counts=True)
            which, of_text = pairs % (len(words) + 1), pairs // (len(words) + 1)
            rest = pa.StructArray.from_arrays([pa.array([words[x] for x in which.tolist()], pa.binary()), pa.array(n), pa.array(word[which])], fields=list(kind.value_type))
            offsets = np.searchsorted(of_text, np.arange(len(bounds))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row"), pa.array(np.diff(bounds) + 1), pa.array(total((c > 0)[seq].astype(np.int64)), pa.int64()), pa.array(total(base[seq]), pa.float64()),
                 pa.array(total(trans[before, g] + within[unit[seq]] + word[seq]), pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), rest)],
                ["doc_id", "row", "n_tokens", "n_known", "base", "score", "rest"],
            )
