"""Local similarity of sequence pairs: seed join, best ungapped segment per diagonal, e-values; set similarities."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from regionpairs.functions import columns as C
from regionpairs.operators.pairs import BLOCK, block_groups, block_pairs
from regionpairs.plans.shared import through_table

WORD = 10
#: Letters of sequences, or columns of diagonals, that one step in numpy works on; a longer one is a step of its own.
COLUMNS = 1 << 20


def words(seq: Column, k: int) -> Column:
    """Array of (pos, kmer), positions from 0; empty for shorter sequences."""
    n = F.length(seq) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("pos"), seq.substr(i + 1, F.lit(k)).alias("kmer")))).otherwise(F.expr("cast(array() as array<struct<pos:int,kmer:string>>)"))


def runs(seqs: DataFrame, k: int) -> DataFrame:
    """set_id, member, kmer, lo, step, n: the places of every k-letter word of a sequence, those at equal distances as one run (lo, lo + step, ... n places).

    Words of many sequences are sorted at a time; a run ends where the word or the distance changes, so poly-A is one run and
    a repeated unit one run per word of it, however long. Words with a masked letter (N) are none.
    """
    return _runs(seqs, ["set_id", "member"], k)


def _runs(seqs: DataFrame, ident: list[str], k: int) -> DataFrame:
    own = seqs.select(*ident, "seq")
    return own.mapInArrow(functools.partial(_word_runs, k=k), StructType([*own.schema.fields[:-1], StructField("kmer", StringType()), *(StructField(c, IntegerType()) for c in ("lo", "step", "n"))]))


def _word_runs(batches, k: int):
    """Batches whose last column holds sequences as batches of the runs of their words."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        letters, ends = _letters(batch.column(batch.num_columns - 1))
        for m, n in _steps(ends):
            part, first = letters[ends[m] : ends[n]], ends[m : n + 1] - ends[m]
            own, at = _unmasked(part, *_places(first, k), k)
            code, size = _codes(part, at, k)
            order = np.argsort(own * size + code, kind="stable")
            own, at, code = own[order], at[order], code[order]
            lo, *more = _equal_runs(own, at, code)
            more = [at[lo] - first[own[lo]], *more]
            for c in range(0, len(lo), COLUMNS):
                cut = slice(c, c + COLUMNS)
                ident = [batch.column(i).slice(m, n - m).take(pa.array(own[lo[cut]])) for i in range(batch.num_columns - 1)]
                spelt, places = _words_at(part, at[lo[cut]], k), [pa.array(x[cut].astype(np.int32)) for x in more]
                yield pa.RecordBatch.from_arrays([*ident, spelt, *places], names=[*batch.schema.names[:-1], "kmer", "lo", "step", "n"])


def _places(ends, k: int):
    """Sequence and place in the letters of every k-letter word."""
    import numpy as np

    n = np.maximum(np.diff(ends) - k + 1, 0)
    own = np.repeat(np.arange(len(n)), n)
    return own, np.arange(len(own)) + (ends[:-1] - np.cumsum(n) + n)[own]


def _unmasked(letters, own, at, k: int):
    """Those words that hold no N."""
    import numpy as np

    hidden = np.concatenate([[0], np.cumsum(letters == ord("N"))])
    free = hidden[at + k] == hidden[at]
    return own[free], at[free]


def _equal_runs(own, at, code):
    """Of words by sequence and code (either first), then place: the first word of each run of equal distances, its step and its number of words."""
    import numpy as np

    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = (own[1:] == own[:-1]) & (code[1:] == code[:-1])
    gap = np.diff(at, prepend=0, append=0)
    begins = ~same
    begins[1:] |= same[:-1] & (gap[1:] != gap[:-1])
    lo, hi = np.flatnonzero(begins[:-1]), np.flatnonzero(begins[1:])
    return lo, np.where(hi > lo, (at[hi] - at[lo]) // np.maximum(hi - lo, 1), 1), hi - lo + 1


def _steps(ends, share: int = 1):
    """Ranges of strings with some COLUMNS // share letters together, or of one longer string."""
    import numpy as np

    k = 0
    while k < len(ends) - 1:
        m = max(k + 1, int(np.searchsorted(ends, ends[k] + COLUMNS // share, "right")) - 1)
        yield k, m
        k = m


def _codes(letters, at, k: int):
    """A number below the returned size for each k-letter word that starts at `at`; equal for equal words only."""
    import numpy as np

    names = np.unique(letters)
    ranks = np.searchsorted(names, letters)
    n = max(len(letters) - k + 1, 0)
    code, size = np.zeros(n, np.int64), 1
    for j in range(k):
        if size * len(names) >= 1 << 40:  # leaves room for the sequence's number
            names_, code = np.unique(code, return_inverse=True)
            size = len(names_)
        code, size = code * len(names) + ranks[j : j + n], size * len(names)
    return code[at], max(size, 1)


def _words_at(letters, at, k: int):
    """The words as a column of strings."""
    import numpy as np
    import pyarrow as pa

    spelt = letters[at[:, None] + np.arange(k)]
    if letters.dtype == np.uint8:
        return pa.StringArray.from_buffers(len(at), pa.py_buffer((np.arange(len(at) + 1) * k).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(spelt)))
    return pa.array([w.tobytes().decode("utf-32-le") for w in spelt], pa.string())


def spots(seqs: DataFrame, ident: list[str], k: int = WORD) -> DataFrame:
    """ident, strand, kmer, lo, step, n: the runs of words of every sequence (ident, seq) on both strands; case doesn't count."""
    upper = seqs.select(*ident, F.upper("seq").alias("seq"))
    both = F.array(F.struct(F.lit("+").alias("strand"), "seq"), F.struct(F.lit("-").alias("strand"), C.reverse_complement(F.col("seq")).alias("seq")))
    return _runs(upper.select(*ident, F.explode(both).alias("_s")).select(*ident, "_s.*"), [*ident, "strand"], k)


def seeds(seqs: DataFrame, k: int = WORD, asked: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """set_id, a, b, strand, diag: diagonals of set members (columns set_id, member, seq) on which a k-letter word occurs in both, on either strand of b.

    Sequences, not words, are shuffled: to their set's pairs of blocks (pairs.block_groups), whose words meet in numpy, those of
    many small sets at a time. Case doesn't count, and a word with a masked letter (N) is none. diag is a's position less b's,
    b's counted on the stated strand. Runs of a word meet as intervals of diagonals, so a word that fills two sequences is one
    meeting; no word is left out however frequent. asked (set_id, a, b): only these pairs.
    """
    met = _grouped(seqs, block).mapInArrow(functools.partial(_by_groups, of=functools.partial(_seed_diagonals, k=k)), StructType([seqs.schema["set_id"], *_pair_fields(seqs)])).distinct()
    return met if asked is None else met.join(asked, ["set_id", "a", "b"], "left_semi")


def search(seqs: DataFrame, k: int = WORD, max_e: float | None = None, block: int = BLOCK) -> DataFrame:
    """segments of all seeds of seqs, in the tasks that find them: no diagonal is shuffled nor joined with its sequences. max_e: only those of an e-value of at most max_e."""
    ints = lambda *names: [StructField(c, IntegerType()) for c in names]
    fields = [seqs.schema["set_id"], *_pair_fields(seqs), *ints("score", "lo", "hi", "a_len", "b_len"), StructField("sseq", StringType())]
    found = _grouped(seqs, block).mapInArrow(functools.partial(_by_groups, of=functools.partial(_seed_segments, k=k, max_e=max_e)), StructType(fields))
    found = _shown(found.withColumn("from", F.greatest(F.col("diag"), F.lit(0))), F.col("sseq"))
    # a diagonal of several parts of a group comes from each
    return (found if max_e is None else with_e_values(found, max_e)).distinct()


def _pair_fields(seqs: DataFrame) -> list[StructField]:
    of = seqs.schema["member"].dataType
    return [StructField("a", of), StructField("b", of), StructField("strand", StringType()), StructField("diag", IntegerType())]


def _grouped(seqs: DataFrame, block: int) -> DataFrame:
    """set_id, member, _new (a group's first row), _rank (that of its member), _own (its block), seq in capitals: groups of two blocks of a set, each whole in one task and by member."""
    own = seqs.select("set_id", "member", F.upper("seq").alias("seq")).where("member is not null and seq is not null")
    groups = block_groups(own, "set_id", ["member"], F.length("seq"), block, COLUMNS)
    w = Window.partitionBy("set_id", "_low", "_high").orderBy("member")
    return groups.select("set_id", "member", (F.row_number().over(w) == 1).alias("_new"), F.rank().over(w).alias("_rank"), F.when(F.col("_low") == F.col("_high"), -1).otherwise(F.col("_own")).alias("_own"), "seq")


def _by_groups(batches, of):
    """What `of` makes of the rows, whole groups at a time with some COLUMNS / 4 letters together, or one larger group."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def done(rows):
        letters, ends = _letters(rows.column("seq"))
        first = np.append(np.flatnonzero(rows.column("_new").to_numpy(zero_copy_only=False)), rows.num_rows)
        for m, n in _steps(ends[first], 4):
            m, n = int(first[m]), int(first[n])
            yield from of(rows.slice(m, n - m), letters[ends[m] : ends[n]], ends[m : n + 1] - ends[m])

    held, size = [], 0
    for batch in batches:
        batch = batch.set_column(batch.num_columns - 1, "seq", batch.column("seq").cast(pa.large_string()))
        at = batch.column("_new").to_numpy(zero_copy_only=False).nonzero()[0]
        if size >= COLUMNS and len(at):
            # all groups but the last are whole
            yield from done(pa.Table.from_batches([*held, batch.slice(0, int(at[-1]))]).combine_chunks().to_batches(None)[0])
            batch, held, size = batch.slice(int(at[-1])), [], 0
        held.append(batch)
        size += pc.sum(pc.utf8_length(batch.column("seq"))).as_py() or 0
    if held:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches(None)
        yield from done(whole[0]) if whole else ()


def _own_rows(rows):
    """Of every row: its group's first row, the first row of its member there, and its block, or -1 where the group is one block."""
    import numpy as np

    first = np.maximum.accumulate(np.where(rows.column("_new").to_numpy(zero_copy_only=False), np.arange(rows.num_rows), 0))
    return first, first + rows.column("_rank").to_numpy() - 1, rows.column("_own").to_numpy()


def _meetings(ends, first):
    """For items numbered along their groups: every item of `first` with each later one of its group, some COLUMNS pairs at a time. ends: where each item's group ends."""
    import numpy as np

    n = ends[first] - first - 1
    for p, q in _steps(np.concatenate([[0], np.cumsum(n)])):
        i = np.repeat(first[p:q], n[p:q])
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n[p:q]) - n[p:q], n[p:q])


def _stretches(key):
    """Where the stretch of equal keys of each item ends."""
    import numpy as np

    last = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)) if len(key) else np.zeros(0, np.int64)
    return np.repeat(last, np.diff(last, prepend=0))


def _met_diagonals(rows, letters, ends, k: int):
    """Of the groups of `rows`, some at a time: letters of all sequences on both strands, where each begins (those of the other strand in reverse), then a's number, b's among both strands, and the diagonal, each once in one part."""
    import numpy as np

    m, (group, who, block) = rows.num_rows, _own_rows(rows)
    other = letters.copy()
    for x, y in zip(b"ACGT", b"TGCA"):
        other[letters == x] = y
    # the other strand: all letters backwards, so the sequences in reverse
    text, row = np.concatenate([letters, other[::-1]]), np.concatenate([np.arange(m), np.arange(m)[::-1]])
    begin = np.concatenate([ends, 2 * ends[-1] - ends[-2::-1]])
    own, at = _unmasked(text, *_places(begin, k), k)
    code, size = _codes(text, at, k)
    key = group[row][own] * size + code
    order = np.argsort(key, kind="stable")
    own, at, key = own[order], at[order], key[order]
    lo, step, n = _equal_runs(own, at, key)
    own, at, till = own[lo], at[lo] - begin[own[lo]], _stretches(key[lo])
    for i, j in _meetings(till, np.flatnonzero(own < m)):
        x, y = own[i], row[own[j]]
        met = (who[x] < who[y]) & ((block[x] < 0) | (block[x] != block[y]))
        i, j, pair = i[met], j[met], x[met] * (2 * m) + own[j[met]]
        zero, even = at[i] - at[j], (n[i] == 1) | (n[j] == 1) | (step[i] == step[j])
        along = np.where(n[i] > 1, step[i], step[j])
        # runs of different steps: all their places, which differ by other numbers
        many = np.where(even, n[i] + n[j] - 1, n[i] * n[j])
        for p, q in _steps(np.concatenate([[0], np.cumsum(many)])):
            r = np.repeat(np.arange(p, q), many[p:q])
            t = np.arange(len(r)) - np.repeat(np.cumsum(many[p:q]) - many[p:q], many[p:q])
            diag = zero[r] + np.where(even[r], (t - n[j][r] + 1) * along[r], t // n[j][r] * step[i][r] - t % n[j][r] * step[j][r])
            order = np.lexsort((diag, pair[r]))
            both, diag = pair[r][order], diag[order]
            new = np.append(True, (both[1:] != both[:-1]) | (diag[1:] != diag[:-1]))[: len(both)]
            yield text, begin, both[new] // (2 * m), both[new] % (2 * m), diag[new]


def _named(rows, a, b, diag) -> dict:
    """set_id, a, b, strand, diag of diagonals as columns."""
    import numpy as np
    import pyarrow as pa

    m = rows.num_rows
    member = rows.column("member")
    strand = pa.array(["+", "-"]).take(pa.array((b >= m).astype(np.int64)))
    return {"set_id": rows.column("set_id").take(pa.array(a)), "a": member.take(pa.array(a)), "b": member.take(pa.array(np.where(b < m, b, 2 * m - 1 - b))), "strand": strand, "diag": pa.array(diag.astype(np.int32))}


def _seed_diagonals(rows, letters, ends, k: int):
    """set_id, a, b, strand, diag of the groups of `rows`."""
    import pyarrow as pa

    for _, _, a, b, diag in _met_diagonals(rows, letters, ends, k):
        yield pa.RecordBatch.from_pydict(_named(rows, a, b, diag))


def _seed_segments(rows, letters, ends, k: int, max_e: float | None = None):
    """As _seed_diagonals, with score, lo, hi (of the best segment of a diagonal's columns), a_len, b_len, sseq; max_e: scores that are too low for it may be left out."""
    import numpy as np
    import pyarrow as pa

    for text, begin, a, b, diag in _met_diagonals(rows, letters, ends, k):
        size = np.diff(begin)
        since = np.maximum(diag, 0)
        n = np.minimum(size[a], size[b] + diag) - since
        x, y = begin[a] + since, begin[b] + since - diag
        found = np.zeros((3, len(n)), np.int64)
        for p, q in _steps(np.concatenate([[0], np.cumsum(n)]), 16):
            t = np.arange(n[p:q].sum()) - np.repeat(np.cumsum(n[p:q]) - n[p:q], n[p:q])
            found[:, p:q] = _best_of(text[np.repeat(x[p:q], n[p:q]) + t] == text[np.repeat(y[p:q], n[p:q]) + t], n[p:q])
        if max_e is not None:
            # a point of score beside rounding; the exact comparison is the caller's
            kept = found[0] >= np.log(C.K * size[a] * size[b].astype(float) / max_e) / C.LAMBDA - 1
            a, b, diag, y, found = a[kept], b[kept], diag[kept], y[kept], found[:, kept]
        score, lo, hi = found
        for p, q in _steps(np.concatenate([[0], np.cumsum(hi - lo)])):
            own = [pa.array(z[p:q].astype(np.int32)) for z in (score, lo, hi, size[a], size[b])]
            yield pa.RecordBatch.from_pydict(_named(rows, a[p:q], b[p:q], diag[p:q]) | dict(zip(("score", "lo", "hi", "a_len", "b_len"), own)) | {"sseq": _spelt(text, (y + lo)[p:q], (hi - lo)[p:q])})


def _spelt(letters, at, n):
    """Stretches of letters as a column of strings."""
    import numpy as np
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum(n)])
    own = letters[np.repeat(at - ends[:-1], n) + np.arange(ends[-1])]
    if letters.dtype == np.uint8:
        return pa.StringArray.from_buffers(len(n), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(own))
    return pa.array([own[p:q].tobytes().decode("utf-32-le") for p, q in zip(ends[:-1], ends[1:])], pa.string())


def _shared_words(rows, letters, ends, k: int):
    """set_id, a, b, shared, na, nb of the groups of `rows`: the distinct words of two members, masked ones too, and of each."""
    import numpy as np
    import pyarrow as pa

    m, (group, who, block) = rows.num_rows, _own_rows(rows)
    own, at = _places(ends, k)
    code, size = _codes(letters, at, k)
    wide = int((who - group).max(initial=0)) + 1
    if m * size * wide >= 1 << 63:
        names, code = np.unique(code, return_inverse=True)
        size = len(names)
    # group, word and member in one number, so that numbers are sorted, not places of them
    key = np.sort((group[own] * size + code) * wide + (who - group)[own])
    key, own = np.divmod(key[np.append(True, key[1:] != key[:-1])[: len(key)]], wide)
    own += key // size
    n, till = np.bincount(own, minlength=m), _stretches(key)
    for i, j in _meetings(till, np.flatnonzero(till - np.arange(len(key)) > 1)):
        x, y = own[i], own[j]
        met = (block[x] < 0) | (block[x] != block[y])
        pair, shared = np.unique(x[met] * m + y[met], return_counts=True)
        a, b = pair // m, pair % m
        yield pa.RecordBatch.from_arrays([rows.column("set_id").take(pa.array(a)), *(rows.column("member").take(pa.array(z)) for z in (a, b)), *map(pa.array, (shared, n[a], n[b]))], names=["set_id", "a", "b", "shared", "na", "nb"])


def seeds_in(members: DataFrame, words_of: DataFrame, ident: str, asked: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """As seeds, for sets (set_id, member, ident) of sequences whose runs of words (spots: ident, strand, ...) are there already; so all replicates of a control share them."""
    first, second = block_pairs(members.select("set_id", "member", ident), "set_id", ["member"], block)
    return _diagonals(first.join(words_of.where("strand = '+'").drop("strand"), ident), second.join(words_of, ident), asked)


def _diagonals(first: DataFrame, second: DataFrame, asked: DataFrame | None) -> DataFrame:
    key = ["set_id", "_first", "_second", "kmer"]
    side = lambda df, p, more: df.select(*key, F.col("member").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("lo", "step", "n")), *more)
    met = side(first, "a", []).join(side(second, "b", ["strand"]), key).where("a < b")
    if asked is not None:
        met = met.join(asked, ["set_id", "a", "b"], "left_semi")
    zero, step = F.col("a_lo") - F.col("b_lo"), F.when(F.col("a_n") > 1, F.col("a_step")).otherwise(F.col("b_step"))
    along = F.sequence(zero - (F.col("b_n") - 1) * step, zero + (F.col("a_n") - 1) * step, step)
    # runs of different steps: all their places, which differ by other numbers
    each = F.flatten(F.transform(F.sequence(F.lit(0), F.col("a_n") - 1), lambda i: F.transform(F.sequence(F.lit(0), F.col("b_n") - 1), lambda j: zero + i * F.col("a_step") - j * F.col("b_step"))))
    met = met.select("set_id", "a", "b", "strand", F.when((F.col("a_n") == 1) | (F.col("b_n") == 1) | (F.col("a_step") == F.col("b_step")), along).otherwise(each).alias("_d"))
    return met.select("set_id", "a", "b", "strand", F.explode_outer("_d").alias("diag")).distinct()


def segments(diagonals: DataFrame, seqs: DataFrame) -> DataFrame:
    """Best ungapped segment of every diagonal: score, qstart, qend, sstart, send (from 0, half-open, b's on the stated strand), matches.

    One pass over the diagonal's columns, those of many diagonals at a time in numpy; nothing is shuffled but the sequences
    to their diagonals. Of equal segments the one that ends first counts, of those the shortest.
    """
    s = seqs.select("set_id", "member", F.upper("seq").alias("seq"))
    met = diagonals.join(s.select("set_id", F.col("member").alias("a"), F.col("seq").alias("a_seq")), ["set_id", "a"]).join(s.select("set_id", F.col("member").alias("b"), F.col("seq").alias("b_own")), ["set_id", "b"])
    met = met.withColumn("b_seq", F.when(F.col("strand") == "-", C.reverse_complement(F.col("b_own"))).otherwise(F.col("b_own")))
    met = met.withColumns({"a_len": F.length("a_seq"), "b_len": F.length("b_seq"), "from": F.greatest(F.col("diag"), F.lit(0))}).withColumn("n", F.least("a_len", F.col("b_len") + F.col("diag")) - F.col("from"))
    met = met.select("set_id", "a", "b", "strand", "diag", "from", "a_len", "b_len", F.expr("substring(a_seq, from + 1, n)").alias("x"), F.expr("substring(b_seq, from - diag + 1, n)").alias("y"))
    given = [f for f in met.schema.fields if f.name != "x"]
    # a map of rows, so that no later filter on scores works them out a second time
    best = met.mapInArrow(_best_columns, StructType([*given, *(StructField(c, IntegerType()) for c in ("score", "lo", "hi"))]))
    return _shown(best, F.expr("substring(y, lo + 1, hi - lo)"))


def _shown(best: DataFrame, sseq: Column) -> DataFrame:
    q, size = F.col("from") + F.col("lo"), F.col("hi") - F.col("lo")
    return best.select(
        "set_id", "a", "b", "strand", "diag", "score", q.alias("qstart"), (F.col("from") + F.col("hi")).alias("qend"), (q - F.col("diag")).alias("sstart"), (F.col("from") + F.col("hi") - F.col("diag")).alias("send"),
        ((F.col("score") - C.MISMATCH * size) / (C.MATCH - C.MISMATCH)).cast("int").alias("matches"), "a_len", "b_len", sseq.alias("sseq"),
    )


def _best_columns(batches):
    """Batches with x and y (strings of equal length) as batches without x, with score, lo and hi of the best segment of their columns."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        at = batch.schema.get_field_index("x")
        x, y = _letters(batch.column("x")), _letters(batch.column("y"))
        ends, found = x[1], np.zeros((3, batch.num_rows), np.int32)
        for k, m in _steps(ends):
            found[:, k:m] = _best_of(x[0][ends[k] : ends[m]] == y[0][ends[k] : ends[m]], np.diff(ends[k : m + 1]))
        kept = [i for i in range(batch.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *map(pa.array, found)], names=[*(batch.schema.names[i] for i in kept), "score", "lo", "hi"])


def _letters(column):
    """Letters of a column of strings one after the other, and where each string begins, with the end of the last."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.cast(pa.large_string())
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
    text = "".join(column.drop_null().to_pylist())
    letters = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return letters, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _best_of(same, sizes):
    """score, lo, hi of the best segment of each of several runs of columns (whether letters agree), `sizes` columns each."""
    import numpy as np

    n, first = len(sizes), np.cumsum(sizes) - sizes + np.arange(len(sizes))  # each run's sums begin with an empty one
    own = np.repeat(np.arange(n), sizes + 1)
    total = np.zeros(len(own), np.int64)
    step = np.ones(len(own), bool)
    step[first] = False
    total[step] = np.where(same, C.MATCH, C.MISMATCH)
    total = np.cumsum(total)
    total -= total[first][own]
    # runs lie so far below each other that none sees the least sum of the one before
    apart = own * ((C.MATCH - C.MISMATCH) * (int(sizes.max(initial=0)) + 1))
    low = np.minimum.accumulate(total - apart) + apart
    since = np.maximum.accumulate(np.where(total == low, np.arange(len(own)), 0))
    gain = total - low
    best = np.maximum.reduceat(gain, first)
    at = np.flatnonzero(gain == best[own])
    hi = at[np.searchsorted(at, first)]  # the first of a run that is its best
    return best, since[hi] - first, hi - first


def with_e_values(hits: DataFrame, cutoff: float | None = None, scales: DataFrame | None = None) -> DataFrame:
    """Score-to-expectation, optionally cut off. scales (set_id, scale): each set's own scale; a set without one has null expectations."""
    scale = None
    if scales is not None:
        hits, scale = hits.join(scales.select("set_id", "scale"), "set_id", "left"), F.col("scale")
    out = hits.withColumn("evalue", C.e_value(F.col("score"), F.col("a_len"), F.col("b_len"), scale))
    return out if cutoff is None else out.where(F.col("evalue") <= cutoff)


def score_scales(seqs: DataFrame) -> DataFrame:
    """set_id, letters (A, C, G and T of all members), match (that two of them are equal), scale (lambda) for the set's own base composition; null without letters or where there is none."""
    n = [F.sum(F.regexp_count(F.upper("seq"), F.lit(x))).cast("double").alias(x) for x in "ACGT"]
    got = seqs.groupBy("set_id").agg(*n)
    total = F.col("A") + F.col("C") + F.col("G") + F.col("T")
    match = F.try_divide(F.col("A") * F.col("A") + F.col("C") * F.col("C") + F.col("G") * F.col("G") + F.col("T") * F.col("T"), total * total)
    return got.select("set_id", total.cast("bigint").alias("letters"), match.alias("match")).withColumn("scale", C.karlin_lambda(F.col("match")))


def best_per_pair(hits: DataFrame, key: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc("score"), "strand", "qstart", "sstart")
    return hits.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def top(hits: DataFrame, k: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), "set_id", "a", "b", "strand", "qstart", "sstart").limit(k)


def word_jaccard(seqs: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """set_id, a, b, shared, total, jaccard, containment (of the smaller set) of the distinct k-letter words of set members that share any; words meet as those of seeds do."""
    of = seqs.schema["member"].dataType
    met = _grouped(seqs, block).mapInArrow(functools.partial(_by_groups, of=functools.partial(_shared_words, k=k)), StructType([seqs.schema["set_id"], StructField("a", of), StructField("b", of), *(StructField(c, LongType()) for c in ("shared", "na", "nb"))]))
    return _ratios(met.groupBy("set_id", "a", "b").agg(F.sum("shared").alias("shared"), F.max("na").alias("na"), F.max("nb").alias("nb")))


def _jaccard(sets: DataFrame) -> DataFrame:
    n = sets.groupBy("set_id", "member").agg(F.count("*").alias("n"))
    met = sets.withColumnRenamed("member", "a").join(sets.withColumnRenamed("member", "b"), ["set_id", "w"]).where("a < b").groupBy("set_id", "a", "b").agg(F.count("*").alias("shared"))
    return _ratios(met.join(n.select("set_id", F.col("member").alias("a"), F.col("n").alias("na")), ["set_id", "a"]).join(n.select("set_id", F.col("member").alias("b"), F.col("n").alias("nb")), ["set_id", "b"]))


def _ratios(both: DataFrame) -> DataFrame:
    total = F.col("na") + F.col("nb") - F.col("shared")
    return both.select("set_id", "a", "b", "shared", total.alias("total"), (F.col("shared") / total).alias("jaccard"), (F.col("shared") / F.least("na", "nb")).alias("containment"))


def minhash_links(seqs: DataFrame, k: int, least: float = 0.5, bands: int = 24, rows: int = 2) -> DataFrame:
    """set_id, a, b, shared, total, jaccard, containment of the members of a set whose distinct k-letter words have a Jaccard similarity of `least` or more, found by MinHash.

    A sequence keeps bands * rows minima of salted hashes of its words; pairs that agree in a band's `rows` minima are
    candidates, which are then compared exactly. So no word is joined, however frequent; a pair of similarity s is found
    with probability 1 - (1 - s^rows)^bands. Sequences shorter than a word have none. Candidates of a band that many
    members share are as many as their pairs.
    """
    upper = seqs.select("set_id", "member", F.upper("seq").alias("seq"))
    sets = upper.where(F.length("seq") >= k).select("set_id", "member", F.array_distinct(F.transform(words(F.col("seq"), k), lambda w: w["kmer"])).alias("ws"))
    one = lambda j: F.array_min(F.transform("ws", lambda w: F.md5(F.concat(F.lit(f"{j}|"), w).cast("binary"))))
    mins = sets.select("set_id", "member", "ws", F.array(*(F.concat_ws("|", F.lit(str(b)), *(one(b * rows + r) for r in range(rows))) for b in range(bands))).alias("_bands"))
    mins = through_table(mins, "minima")
    keys = mins.select("set_id", "member", F.explode("_bands").alias("_band"))
    a, b = keys.withColumnRenamed("member", "a"), keys.withColumnRenamed("member", "b")
    near = a.join(b, ["set_id", "_band"]).where("a < b").select("set_id", "a", "b").distinct()
    both = near.join(mins.select("set_id", F.col("member").alias("a"), F.col("ws").alias("_x")), ["set_id", "a"]).join(mins.select("set_id", F.col("member").alias("b"), F.col("ws").alias("_y")), ["set_id", "b"])
    both = both.select("set_id", "a", "b", F.size(F.array_intersect("_x", "_y")).cast("bigint").alias("shared"), F.size("_x").alias("_m"), F.size("_y").alias("_n"))
    total = (F.col("_m") + F.col("_n") - F.col("shared")).cast("bigint")
    out = both.select("set_id", "a", "b", "shared", total.alias("total"), (F.col("shared") / total).alias("jaccard"), (F.col("shared") / F.least("_m", "_n")).alias("containment"))
    return out.where(F.col("jaccard") >= least)


def motif_jaccard(motifs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """As word_jaccard, of the distinct motif groups of members (set_id, member, w). groups (w, grp) maps motifs to groups, several if need be; a motif that isn't in it counts for none."""
    if groups is not None:
        motifs = motifs.join(groups.select("w", "grp"), "w").select("set_id", "member", F.col("grp").alias("w"))
    return _jaccard(motifs.select("set_id", "member", "w").distinct())


def low_complexity(seqs: DataFrame, width: int = 64, stride: int = 32) -> DataFrame:
    """set_id, member, chunk, score: sum of c (c - 1) / 2 over the triplets of each width-letter stretch, divided by their number less one; stretches start every stride letters, so they overlap."""
    n = F.greatest(F.ceil(F.length("seq") / stride).cast("int"), F.lit(1))
    cut = seqs.select("set_id", "member", F.upper("seq").alias("seq"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk")).select("set_id", "member", "chunk", F.expr(f"substring(seq, chunk * {stride} + 1, {width})").alias("part"))
    t = cut.select("set_id", "member", "chunk", F.explode(F.transform(words(F.col("part"), 3), lambda w: w["kmer"])).alias("t")).groupBy("set_id", "member", "chunk", "t").agg(F.count("*").alias("c"))
    return t.groupBy("set_id", "member", "chunk").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("s"), F.sum("c").alias("l")).where("l > 1").select("set_id", "member", "chunk", (F.col("s") / (F.col("l") - 1)).alias("score"))


def masked(seqs: DataFrame, level: float = 2.0, width: int = 64, stride: int = 32) -> DataFrame:
    """seqs with the letters of all stretches whose low-complexity score is above level as N, which no seed may hold."""
    low = low_complexity(seqs, width, stride).where(F.col("score") > level).groupBy("set_id", "member").agg(F.array_sort(F.collect_list("chunk")).alias("_low"))
    at = lambda c: c * stride
    cover = lambda s, c: F.overlay(s, F.repeat(F.lit("N"), F.least(F.lit(width), F.length(s) - at(c))), at(c) + 1)
    return seqs.join(low, ["set_id", "member"], "left").withColumn("seq", F.coalesce(F.aggregate("_low", F.col("seq"), cover), F.col("seq"))).drop("_low")


#: Letters of a piece that one step of `dusted` works on; a sequence's length isn't bounded.
PIECE = 1 << 20


def dusted(seqs: DataFrame, level: float = 2.0, width: int = 64) -> DataFrame:
    """seqs with the letters of all perfect intervals as N: stretches of at most `width` letters whose low-complexity score (see low_complexity) is above level and beaten by that of no stretch within them.

    The rest of a low-complexity region's surroundings stays, unlike in masked, which takes whole windows. Other letters than
    A, C, G, T form triplets of their own; null stays null. Scores of all windows of one length are computed at once.
    """
    @F.pandas_udf("string")
    def mask(column: pd.Series) -> pd.Series:
        return column.map(lambda s: s if s is None else _dust(s, level, width))

    return seqs.withColumn("seq", mask("seq"))


def _dust(seq: str, level: float, width: int) -> str:
    import numpy as np

    letters = np.array([seq]).view(np.uint32) if seq else np.zeros(0, np.uint32)
    low = np.zeros(len(letters) + 1, np.int32)
    for at in range(0, len(letters), PIECE):
        # intervals that start in this piece or within a width before it, with all that they hold
        lo = max(0, at - width)
        for a, b in _perfect(letters[lo : at + PIECE + width], level, width):
            np.add.at(low, lo + a, 1)
            np.add.at(low, lo + b, -1)
    hidden = np.cumsum(low[:-1]) > 0
    if not hidden.any():
        return seq
    return np.where(hidden, np.uint32(ord("N")), letters).astype("<u4").tobytes().decode("utf-32-le")


def _perfect(letters, level: float, width: int):
    """(starts, ends) of the perfect intervals, per length."""
    import numpy as np

    upper = np.where((letters >= 97) & (letters <= 122), letters - 32, letters).astype(np.int64)
    t = (upper[:-2] << 42) + (upper[1:-1] << 21) + upper[2:] if len(letters) > 2 else np.zeros(0, np.int64)
    n = len(t)
    equal, pairs_, best = np.zeros(n, np.int32), np.zeros(n, np.int64), np.full(n, -1.0)
    for size in range(2, min(width - 2, n) + 1):  # triplets of an interval
        far = size - 1
        equal[far:] += t[far:] == t[:-far]  # earlier equal triplets among the last `far`
        pairs_ = pairs_[: n - far] + equal[far:]  # of intervals by their start
        score = pairs_ / far
        inner = np.maximum(best[:-1], best[1:])  # of both intervals one shorter
        at = np.flatnonzero((score > level) & (score >= inner))
        if len(at):
            yield at, at + size + 2
        best = np.maximum(score, inner)
