"""Operator 6: n-gram Jaccard join by vertical partitioning.

Texts become sets of hashed word n-grams. Equal sets are one node. The global n-gram order is by hash, with n-grams that
many nodes hold moved to its end; two sets that are similar enough share an n-gram among the first few of each (the prefix),
so nodes meet there, and lengths, positions and parity sketches rule out most meetings. To confirm a pair, the order of the
hashes is cut into fragments, the overlap is counted in each fragment separately and summed per pair.

Links are wanted for components, so at first one link per node is confirmed, to the earlier node whose sketch is nearest;
then one pair for every two components that meet; at last all pairs that are still in different components. No link between
components is missed, and groups of near copies aren't expanded into all pairs. An n-gram under which more than BLOCK rows
meet is dealt out in blocks of nodes: at first each block by itself, later every two blocks, as rows of their own; n-grams
whose nodes are all of one component are left out before.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, slices, texts, through_table, tidy
from .graph import forest, merged

#: An n-gram in the prefixes of more nodes than this goes to the end of the order.
COMMON = 100
#: Fragments that the order is cut into for counting; bits of a parity sketch, and of the wide one that large sets have besides.
FRAGMENTS, SKETCH, WIDE = 8, 256, 4096
#: Rows that meet under one n-gram before the first round compares each with the first and the nearest ones only.
ALL_BELOW, NEAREST = 2048, 64
#: Rows of one n-gram that a task compares with each other; more are dealt out in blocks of about this size.
BLOCK = 1024
#: Ids that are sent to every task rather than joined by shuffling the texts.
SENT = 1_000_000


def need(a, b, pct):
    """Smallest overlap of sets of sizes a and b with 100 * overlap >= pct * union."""
    return -(-pct * (a + b) // (100 + pct))


def prefix(n, pct):
    """So many first n-grams of a set hold one of any set that is similar enough."""
    return n - -(-pct * n // 100) + 1


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers(n: int):
    """Powers of an odd number modulo 2 ** 64 and of its inverse."""
    import numpy as np

    p = 0x9E3779B97F4A7C15
    q = pow(p, -1, 1 << 64)
    up, down = np.full(n, p, np.uint64), np.full(n, q, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_SPACE = [9, 10, 11, 12, 13, 32]


def shingle_sets(blobs: list[bytes], k: int) -> list:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text; fewer words are one shingle, none give an empty set."""
    import numpy as np

    data = b"\n".join(b.translate(LOWER) for b in blobs) + b"\n"
    a = np.frombuffer(data, np.uint8)
    lens = np.array([len(b) + 1 for b in blobs])
    size = 1 << max(16, (len(a)).bit_length())
    up, down = _powers(size)
    gap = np.isin(np.arange(256), _SPACE)[a]
    edge = np.diff(gap.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = ends[: len(starts)] if len(ends) == len(starts) else ends[len(ends) - len(starts) :]
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=total[1:])
    words = _mix((total[ends] - total[starts]) * down[starts] + _mix((ends - starts).astype(np.uint64)))
    first = np.searchsorted(starts, np.cumsum(lens) - lens)
    bounds = [*first.tolist(), len(words)]
    h = np.full(max(0, len(words) - k + 1), k, np.uint64)
    for j in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(h)])
    out = []
    for lo, hi in zip(bounds, bounds[1:]):
        n = hi - lo
        if n >= k:
            out.append(np.unique(h[lo : hi - k + 1].view(np.int64)))
        elif n:
            x = np.full(1, n, np.uint64)
            for j in range(lo, hi):
                x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + words[j : j + 1])
            out.append(x.view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def _sets(batches, k):
    """(part, sets) of bounded runs of rows."""
    import pyarrow as pa

    for batch in batches:
        for part in slices(batch, 1 << 20):
            yield part, shingle_sets(part.column("text").cast(pa.binary()).to_pylist(), k)


@tidy
def _heads(batches, k, pct):
    import numpy as np
    import pyarrow as pa
    import xxhash

    for part, sets in _sets(batches, k):
        keys, ns, heads, sketches, wides = [], [], [], [], []
        for s in sets:
            n = len(s)
            ns.append(n)
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if n else None)
            p = prefix(n, pct)
            heads.append(s[: min(n, p + p // 4 + 4)] if n else s)
            bits = (np.bincount((s.view(np.uint64) % np.uint64(WIDE)).astype(np.int64), minlength=WIDE) & 1).astype(np.uint8)
            sketches.append(np.packbits(np.bitwise_xor.reduce(bits.reshape(-1, SKETCH))).tobytes())
            wides.append(np.packbits(bits).view(np.int64) if n > SKETCH else None)
        flat = np.concatenate(heads) if heads else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in heads])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(ns, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(sketches, pa.binary()), pa.array(wides, pa.list_(pa.int64()))], ["doc_id", "key", "n", "head", "sketch", "wide"]
        )


@tidy
def _whole_sets(batches, k):
    import numpy as np
    import pyarrow as pa

    for part, sets in _sets(batches, k):
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["node", "tokens"])


@tidy
def _reordered(batches, k, pct, common):
    """The prefix of whole sets, n-grams in common (sorted) last."""
    import numpy as np
    import pyarrow as pa

    common = np.array(common, np.int64)
    for part, sets in _sets(batches, k):
        tok, node, n, pos = [], [], [], []
        for d, s in zip(part.column("doc_id").to_pylist(), sets):
            p = prefix(len(s), pct)
            x = s[np.argsort(np.isin(s, common), kind="stable")][:p]
            tok.append(x)
            node += [d] * len(x)
            n += [len(s)] * len(x)
            pos += range(len(x))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tok)), pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(pos, pa.int32())], ["token", "node", "n", "pos"])


@tidy
def _fragments(batches, k):
    """node, fragment of the order, its n-grams."""
    import numpy as np
    import pyarrow as pa

    width = (1 << 64) // FRAGMENTS
    cuts = np.array([-(1 << 63) + width * f for f in range(1, FRAGMENTS)], np.int64)
    for part, sets in _sets(batches, k):
        ids = part.column("doc_id").to_pylist()
        node, frag, toks = [], [], []
        for d, s in zip(ids, sets):
            for f, x in enumerate(np.split(s, np.searchsorted(s, cuts))):
                if len(x):
                    node.append(d)
                    frag.append(f)
                    toks.append(x)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in toks])]).astype(np.int32)
        flat = np.concatenate(toks) if toks else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(frag, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["node", "f", "tokens"])


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs with these ids: ids go to the tasks while they are few, else both sides are shuffled."""
    few = ids.count() <= SENT
    return docs.join(F.broadcast(ids) if few else ids, docs.doc_id == ids.node, "left_semi")


@tidy
def _meet(batches, pct, mode):
    """Pairs (a, b) of nodes that meet in a cell (an n-gram, or two blocks of one), from rows sorted by cell, n, node, with their components and how
    far their sketches differ. `near`: each node with the earlier one that it differs from least; `merge`: of two components
    the pair that differs least; `all`: every pair of different components. All only as far as they may be similar."""
    import numpy as np
    import pyarrow as pa

    def group(best, n, pos, node, sketch, comp, side):
        keep = np.concatenate([[True], node[1:] != node[:-1]])
        n, pos, node, sketch, comp, side = n[keep], pos[keep], node[keep], sketch[keep], comp[keep], side[keep]
        m = len(n)
        if m < 2 or mode != "near" and (comp == comp[0]).all():
            return
        low = np.searchsorted(n, -(-pct * n // 100))  # sizes below can't be similar
        for j in range(1, m):
            if mode != "near" or m <= ALL_BELOW:
                i = np.arange(low[j], j)
            else:
                i = np.unique(np.concatenate([[low[j]], np.arange(max(low[j], j - NEAREST), j)]))
                i = i[i < j]
            if mode != "near":
                i = i[(comp[i] != comp[j]) & ((side[i] == 0) | (side[i] != side[j]))]
            if not len(i):
                continue
            least = need(n[i], n[j], pct)
            ok = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least
            i, least = i[ok], least[ok]
            if not len(i):
                continue
            differ = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
            ok = (n[i] + n[j] - differ) // 2 >= least
            i, far = i[ok], 10_000 * differ[ok] // (n[i[ok]] + n[j])
            if not len(i):
                continue
            order = np.lexsort((node[i], far))
            i, far = i[order], far[order]
            if mode == "near":
                i, far = i[:1], far[:1]
            elif mode == "merge":
                _, first = np.unique(comp[i], return_index=True)
                i, far = i[first], far[first]
            for x, d in zip(i.tolist(), far.tolist()):
                a, b, ca, cb = int(node[x]), int(node[j]), int(comp[x]), int(comp[j])
                key = b if mode == "near" else (min(ca, cb), max(ca, cb)) if mode == "merge" else (min(a, b), max(a, b))
                if key not in best or (d, a, b) < best[key]:
                    best[key] = (d, a, b)

    def close(rows):
        tok, *rest = rows
        cuts = np.flatnonzero(np.diff(tok)) + 1
        best: dict = {}
        comp = dict(zip(rest[2].tolist(), rest[4].tolist()))
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tok)]):
            if hi - lo > 1:
                group(best, *(x[lo:hi] for x in rest))
        cols = list(zip(*((a, b, min(comp[a], comp[b]), max(comp[a], comp[b]), d) for d, a, b in best.values()))) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["a", "b", "ca", "cb", "far"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        col = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        new = [col("cell"), col("n"), col("pos"), col("node"), sketch, col("comp"), col("side")]
        held = [np.concatenate(x) for x in zip(held, new)] if held else new
        last = int(np.searchsorted(held[0], held[0][-1]))  # the last n-gram may go on
        if last:
            yield close([x[:last] for x in held])
            held = [x[last:] for x in held]
    if held:
        yield close(held)


def _pairs(rows: DataFrame, pct: int, mode: str) -> DataFrame:
    """The pairs that _meet picks, over all n-grams: in mode `near` b's one a, which is earlier by size and id; else a < b."""
    dealt = _cells(rows, mode).select("cell", "n", "pos", "node", "sketch", "comp", "side").repartition("cell").sortWithinPartitions("cell", "n", "node")
    met = dealt.mapInArrow(functools.partial(_meet, pct=pct, mode=mode), "a long, b long, ca long, cb long, far long")
    if mode != "all":
        met = met.groupBy(*(["b"] if mode == "near" else ["ca", "cb"])).agg(F.min(F.struct("far", "a", F.col("b").alias("_b"))).alias("m")).select("m.a", F.col("m._b").alias("b"))
    if mode == "near":
        return met
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _cells(rows: DataFrame, mode: str) -> DataFrame:
    """rows (with blocks, the number of blocks that their n-gram is dealt out in) with the cell where they meet, and their
    side there: 0 in a cell of one block, else 1 or 2. A cell is a hash; two that share one by chance only meet in vain."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    if mode == "near":
        return rows.withColumn("cell", F.when(F.col("blocks") > 1, F.xxhash64("token", block)).otherwise(F.col("token"))).withColumn("side", F.lit(0))
    mixed = through_table(rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token"), "mixed")
    rows = rows.join(mixed, "token")
    one = rows.where("blocks = 1").withColumn("cell", F.col("token")).withColumn("side", F.lit(0))
    many = rows.where("blocks > 1").withColumn("own", block).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    cell = F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return one.unionByName(many.withColumn("cell", cell).withColumn("side", side).drop("own", "other"))


def _plausible(pairs: DataFrame, first: DataFrame, sizes: DataFrame, pct: int) -> DataFrame:
    """pairs that the wide sketches don't rule out."""
    of = lambda c: first.where("wide is not null").select(F.col("node").alias(c), F.col("wide").alias(f"w_{c}")).join(sizes.select(F.col("node").alias(c), F.col("n").cast("long").alias(f"n_{c}")), c)
    met = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    differ = F.aggregate(F.zip_with("w_a", "w_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda z, v: z + v)
    total = F.col("n_a") + F.col("n_b")
    # 100 * overlap >= pct * union with overlap at most (total - differ) / 2
    return met.where(F.col("w_a").isNull() | F.col("w_b").isNull() | ((100 + pct) * (total - differ) >= 2 * pct * total)).select("a", "b")


def confirm(docs: DataFrame, pairs: DataFrame, sizes: DataFrame, k: int, pct: int) -> DataFrame:
    """The pairs (a, b) that are similar enough: overlaps counted by fragment and summed."""
    few = pairs.count() <= SENT
    side = lambda c: _only(docs, pairs.select(F.col(c).alias("node")).distinct()).mapInArrow(functools.partial(_fragments, k=k), "node long, f int, tokens array<long>").select(F.col("node").alias(c), "f", F.col("tokens").alias(f"{c}_tokens"))
    # b's fragments learn their partners where they lie; one shuffle brings them to a's
    theirs = side("b").join(F.broadcast(pairs) if few else pairs, "b")
    met = theirs.join(side("a"), ["a", "f"]).select("a", "b", F.size(F.array_intersect("a_tokens", "b_tokens")).cast("long").alias("c"))
    both = met.groupBy("a", "b").agg(F.sum("c").alias("c"))
    n = lambda c: sizes.select(F.col("node").alias(c), F.col("n").cast("long").alias(f"n_{c}"))
    return both.join(n("a"), "a").join(n("b"), "b").where(100 * F.col("c") >= pct * (F.col("n_a") + F.col("n_b") - F.col("c"))).select("a", "b")


def link(docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every document row: texts whose sets of k-word shingles have a Jaccard similarity
    of pct / 100 or more are linked; a component has the smallest doc_id that links reach.

    Null, empty and wordless texts have empty sets and link with nothing; copies link with each other whatever their
    number; repeated rows of a doc_id are kept, and if their texts differ the one with the smallest hash counts for all. A
    null doc_id links with nothing and keeps a null component_id. An empty table gives an empty result.
    """
    docs = texts(docs)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _link(docs, k, pct)
    own = docs.where("doc_id is not null")
    one = own.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    linked = _link(one.unionByName(docs.where("doc_id is null")), k, pct)
    return own.select("doc_id").join(linked, "doc_id").unionByName(linked.where("doc_id is null"))


def _link(docs: DataFrame, k: int, pct: int) -> DataFrame:
    """link() of documents with distinct ids."""
    heads = through_table(docs.mapInArrow(functools.partial(_heads, k=k, pct=pct), "doc_id long, key binary, n int, head array<long>, sketch binary, wide array<long>"), "heads")
    nodes = through_table(heads.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n")), "nodes")
    # of copies one row has the head
    first = _only(heads, nodes.select("node")).select(F.col("doc_id").alias("node"), "head", "sketch", "wide")
    size_of_sql = f"n - cast(({pct} * cast(n as bigint) + 99) div 100 as int) + 1"  # prefix()
    size_of = F.expr(size_of_sql)
    rows = first.select("node", F.posexplode("head").alias("rank", "token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    shared = through_table(rows.join(counts, "token").select("token", "node", "rank", (F.col("c") > COMMON).alias("common")), "shared")
    sized = nodes.select("node", "n").withColumn("h", F.least("n", size_of + F.expr(f"({size_of_sql}) div 4 + 4").cast("int")))
    # common n-grams at the end of the order
    before = F.sum(F.col("common").cast("int")).over(_by_node().orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    all_common = F.sum(F.col("common").cast("int")).over(_by_node())
    placed = shared.join(sized, "node").withColumn("pos", F.col("rank") - F.coalesce(before, F.lit(0))).withColumn("short", F.col("h") - all_common < size_of).where((~F.col("common") & (F.col("pos") < size_of)) | F.col("short"))
    placed = through_table(placed.select("token", "node", "n", "pos", "short"), "placed")
    light = placed.where("not short").select("token", "node", "n", "pos")
    # nodes whose head is nearly all common: the order of the whole set
    short = through_table(placed.where("short").select("node").distinct(), "short")
    common = through_table(shared.where("common").select("token").distinct(), "common")
    if common.count() <= SENT:
        held = sorted(r.token for r in common.collect())
        heavy = _only(docs, short).mapInArrow(functools.partial(_reordered, k=k, pct=pct, common=held), "token long, node long, n int, pos int")
    else:
        whole = _only(docs, short).mapInArrow(functools.partial(_whole_sets, k=k), "node long, tokens array<long>").select("node", F.size("tokens").alias("n"), F.posexplode("tokens").alias("rank", "token"))
        order = whole.join(common.withColumn("common", F.lit(True)), "token", "left").select("node", "n", "token", "rank", F.coalesce("common", F.lit(False)).alias("common"))
        heavy = order.withColumn("pos", F.row_number().over(_by_node().orderBy("common", "rank")) - 1).where(F.col("pos") < size_of).select("token", "node", "n", "pos")
    met = light.unionByName(heavy)
    sketches = first.select("node", "sketch")
    # only n-grams that two prefixes hold
    again = met.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token", F.ceil(F.col("c") / BLOCK).alias("blocks"))
    met = through_table(met.join(again, "token").join(sketches, "node"), "met")
    sizes = nodes.select("node", "n")
    tried = through_table(_pairs(met.withColumn("comp", F.col("node")), pct, "near"), "tried")
    comps = through_table(forest(confirm(docs, tried, sizes, k, pct).select(F.col("b").alias("node"), F.col("a").alias("parent"))), "comps")
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for mode in ("merge", "all"):
        # first one pair for every two components, then all pairs of components that are still different
        labelled = met.join(comps.select("node", F.col("component").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        rest = through_table(_plausible(_pairs(labelled, pct, mode).join(tried, ["a", "b"], "left_anti"), first, sizes, pct), "rest")
        if rest.isEmpty():
            continue
        tried = tried.unionByName(rest)
        links = through_table(confirm(docs, rest, sizes, k, pct), "sure")
        if not links.isEmpty():
            comps = through_table(merged(comps, links), "comps")
    named = nodes.select("key", "node").join(comps, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    # a class's smallest id is its node, and a component's smallest node is its smallest id
    out = heads.select("doc_id", "key", F.col("n").cast("long").alias("n_shingles")).join(named, "key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _by_node():
    return Window.partitionBy("node")


def one_of_each(docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """docs without the documents that aren't the first of their component; other columns may have any names."""
    extra = link(docs, k, pct).where("doc_id <> component_id").select("doc_id").distinct()
    # joined by the id's name, so that no helper column can clash; the join puts it first
    return docs.join(extra, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
