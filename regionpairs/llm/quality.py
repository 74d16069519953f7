"""Operator 2: quality classifier from weak labels.

Overlapping heuristic labellers vote good (1), bad (-1) or nothing (0) on every document. Expectation-maximisation over the
counts of vote patterns of all documents estimates how each labeller votes on good and on bad documents. The resulting
posterior labels of a bounded sample train a linear scorer over hashed byte pairs and hashed text statistics, which then
judges every document.
"""

from __future__ import annotations

import functools
import math
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, sampled, slices, texts, tidy

#: Documents, by smallest hash of their id, that the scorer is trained on; its hashed features.
SAMPLE, DIMS = 8000, 1024
#: Rows of the sample that the driver makes double-precision numbers of at a time.
BLOCK = 1000
#: Frequent function words of four languages (fixed values).
FUNCTION_WORDS = frozenset(
    b"the of and to in a is that it for on was be with as at by this from are or an have not de la le les des et un une que qui dans en du el los las y del se por con para der die das und den von zu mit ist im auf nicht ein eine".split()
)
SYMBOLS = bytes(b for b in range(33, 127) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) and b not in b".,'\"-()")
LABELLERS = ("symbols", "capitals", "function_words", "variety", "stutter", "bare_tokens", "word_length", "lines")


def measures(blob: bytes) -> dict[str, float]:
    """Text statistics of a whole document."""
    words = blob.split()
    n, size = max(1, len(words)), max(1, len(blob))
    letters = size - len(blob.translate(None, bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))))
    capitals = size - len(blob.translate(None, bytes(range(65, 91))))
    symbols = size - len(blob.translate(None, SYMBOLS))
    few = words if n <= 400 else None
    if few is not None:
        variety = len(set(words)) / n
    else:  # mean over runs of 400 words, so that length doesn't matter
        variety = sum(len(set(words[k : k + 400])) / len(words[k : k + 400]) for k in range(0, n, 400)) / -(-n // 400)
    lines = [x for x in blob.split(b"\n") if x.strip()]
    return {
        "words": len(words),
        "symbols": symbols / size,
        "capitals": capitals / max(1, letters),
        "function_words": sum(map(FUNCTION_WORDS.__contains__, words)) / n,
        "variety": variety,
        "stutter": sum(map(bytes.__eq__, words, words[1:])) / n,
        "bare_tokens": sum(words.count(x) for x in (b"|", b"-", b"*", b"#")) / n,
        "word_length": size / n,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
    }


def votes(m: dict[str, float]) -> tuple[int, ...]:
    """Each labeller's vote, in the order of LABELLERS."""
    few = m["words"] < 20
    return (
        -1 if m["symbols"] > 0.08 else 1 if m["symbols"] < 0.02 else 0,
        -1 if m["capitals"] > 0.3 else 1 if m["capitals"] < 0.1 and not few else 0,
        0 if few else -1 if m["function_words"] < 0.03 else 1 if m["function_words"] > 0.1 else 0,
        0 if few else -1 if m["variety"] < 0.35 else 1 if m["variety"] > 0.5 else 0,
        -1 if m["stutter"] > 0.2 else 1 if m["stutter"] < 0.05 else 0,
        -1 if m["bare_tokens"] > 0.15 else 1 if m["bare_tokens"] < 0.02 and not few else 0,
        0 if few else -1 if not 3 <= m["word_length"] <= 14 else 1 if 4 <= m["word_length"] <= 10 else 0,
        -1 if m["lines"] > 0.6 else 0,
    )


def hashed(blob: bytes, m: dict[str, float]):
    """The scorer's input: frequencies of byte pairs in hashed buckets (square roots), and one hashed bucket per length class, statistic and step."""
    import numpy as np

    a = np.frombuffer(blob, np.uint8).astype(np.uint32)
    x = np.zeros(DIMS, np.float32)
    if len(a) > 1:
        pair = (a[:-1] * np.uint32(256) + a[1:]) * np.uint32(2654435761)
        x += np.sqrt(np.bincount(pair >> np.uint32(22), minlength=DIMS)[:DIMS] / (len(a) - 1)).astype(np.float32)
    length = "few" if m["words"] < 20 else "some" if m["words"] < 60 else "many"
    for k, v in m.items():
        tenth = int(math.log2(v + 1)) if k == "words" else int(v) if k == "word_length" else int(min(0.999, v) * 20)
        x[zlib.crc32(f"{length} {k}={tenth}".encode()) % DIMS] += 1
    return x


@tidy
def _votes(batches):
    import pyarrow as pa

    for batch in batches:
        for part in slices(batch):
            got = [list(votes(measures(b))) for b in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32()))], ["votes"])


@tidy
def _sample(batches):
    import pyarrow as pa

    for batch in batches:
        for part in slices(batch):
            ms = [(b, measures(b)) for b in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([list(votes(m)) for _, m in ms], pa.list_(pa.int32())), pa.array([zlib.compress(hashed(b, m).tobytes(), 1) for b, m in ms], pa.binary())], ["votes", "x"])


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50):
    """(prior of good, table[labeller][vote + 1][class]) by expectation-maximisation over vote patterns and their counts."""
    import numpy as np

    p = np.array([v for v, _ in patterns], np.int64).reshape(len(patterns), len(LABELLERS)) + 1
    n = np.array([c for _, c in patterns], np.float64)
    prior = 0.8
    # start: bad votes are rarely wrong, good votes are weak; the same as pseudo-counts later. A missing vote says nothing.
    start = np.tile(np.array([[0.4, 0.01], [1.0, 1.0], [0.6, 0.99]]), (len(LABELLERS), 1, 1))
    table = start.copy()
    for _ in range(rounds):
        good = _posterior(p, prior, table)
        weight = 0.001 * n.sum() + 1
        prior = min(0.99, max(0.01, (n @ good + 1) / (n.sum() + 2)))
        for j in range(len(LABELLERS)):
            for c, q in ((0, 1 - good), (1, good)):
                count = np.bincount(p[:, j], weights=n * q, minlength=3)[[0, 2]] + weight * start[j, [0, 2], c]
                table[j, [0, 2], c] = count / count.sum()
    return prior, table


def _posterior(p, prior, table):
    import numpy as np

    logs = np.log(np.array([1 - prior, prior])) + sum(np.log(table[j][p[:, j]]) for j in range(p.shape[1]))
    return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))


def train(docs: DataFrame, sample: int = SAMPLE):
    """(bias, weights) of the scorer, prior and the labellers' table."""
    import numpy as np

    docs = texts(docs)
    counts = docs.mapInArrow(_votes, "votes array<int>").groupBy("votes").count().collect()  # at most 3 ** labellers rows
    prior, table = estimate([(tuple(r.votes), r["count"]) for r in counts])
    rows = sampled(docs, sample).mapInArrow(_sample, "votes array<int>, x binary").toArrow()
    if not rows.num_rows:
        return 4.0, np.zeros(DIMS), prior, table
    y = _posterior(np.array(rows.column("votes").to_pylist(), np.int64) + 1, prior, table)
    x = np.empty((len(y), DIMS), np.float32)  # 32 MB at most
    for k, packed in enumerate(rows.column("x")):
        x[k] = np.frombuffer(zlib.decompress(packed.as_py()), np.float32)
    w, b, vw, vb = np.zeros(DIMS), 0.0, np.zeros(DIMS), 0.0
    for _ in range(400):  # full-batch gradient descent with momentum on logistic loss
        slope, off = np.zeros(DIMS), 0.0
        for k in range(0, len(y), BLOCK):
            part = x[k : k + BLOCK].astype(np.float64)
            e = 1 / (1 + np.exp(-np.clip(part @ w + b, -30, 30))) - y[k : k + BLOCK]
            slope, off = slope + part.T @ e, off + e.sum()
        vw = 0.9 * vw - 0.5 * (slope / len(y) + 1e-4 * w)
        vb = 0.9 * vb - 0.5 * off / len(y)
        w, b = w + vw, b + vb
    del x, rows
    give_back()  # the driver lives on
    return b, w, prior, table


def score(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score (probability of good), keep (score >= 0.5) and votes of every document row.

    Null and empty texts get no good vote but few bad ones; their score is the scorer's on an empty text. Repeated rows
    are kept and score alike. On an empty table the result is empty.
    """
    b, w, _, _ = train(docs, sample)
    return texts(docs).mapInArrow(functools.partial(_score, bias=float(b), weights=w), "doc_id long, score double, keep boolean, votes array<int>")


@tidy
def _score(batches, bias, weights):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for part in slices(batch):
            s, v = [], []
            for blob in part.column("text").cast(pa.binary()).to_pylist():
                m = measures(blob)
                v.append(list(votes(m)))
                s.append(1 / (1 + math.exp(-max(-30.0, min(30.0, bias + float(hashed(blob, m) @ weights))))))
            s = np.array(s)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array(s >= 0.5), pa.array(v, pa.list_(pa.int32()))], ["doc_id", "score", "keep", "votes"])


def keep_good(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs whose text the scorer keeps, with all their columns; judged where they lie."""
    b, w, _, _ = train(docs, sample)
    return docs.mapInArrow(functools.partial(_keep, bias=float(b), weights=w), docs.schema)


@tidy
def _keep(batches, bias, weights):
    import pyarrow as pa

    for batch in batches:
        for part in slices(batch):
            good = [bias + float(hashed(blob, measures(blob)) @ weights) >= 0 for blob in part.column("text").fill_null("").cast(pa.binary()).to_pylist()]
            yield part.filter(pa.array(good))
