import hashlib
import math

import numpy as np
import pytest

from regionpairs.llm import centroids


def brute(rows, k=16, rounds=3):
    """Lloyd's rounds with Python's integers."""
    vs = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    cs = [v for _, v in sorted(vs, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for r in range(rounds + 1):
        got = [min((dist(v, c), j) for j, c in enumerate(cs)) for _, v in vs]
        if r < rounds:
            for j in range(len(cs)):
                own = [v for (_, v), (_, c) in zip(vs, got) if c == j]
                if own:
                    cs[j] = [sum(x) // len(own) for x in zip(*own)]
    inertia = [sum(d for d, c in got if c == j) for j in range(len(cs))]
    long = lambda x: x if x < 1 << 63 else None
    return sorted(((i, c, d, long(inertia[c]), long(sum(inertia)), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(vs, got)), key=repr)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string")


@pytest.mark.parametrize("spread", [0.2, 3.0, 2.0**17, 2.0**21])
def test_against_brute_force(spark, spread):
    rng = np.random.default_rng(1)
    tops = rng.normal(0, spread, (20, 64))
    rows = [(i, (tops[i % 20] + rng.normal(0, spread / 8, 64)).tolist()) for i in range(400)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, rows[5][1])] + [(1000 + i, rows[0][1]) for i in range(50)]
    got = sorted((tuple(r) for r in centroids.cluster(frame(spark, rows)).collect()), key=repr)
    assert got == brute(rows)


def test_bounds_spare_scans_and_hold(spark):
    rng = np.random.default_rng(2)
    tops = rng.normal(0, 2, (16, 64))
    rows = [(i, (tops[i % 16] + rng.normal(0, 0.3, 64)).tolist()) for i in range(800)]
    state, cs = centroids.fit(centroids.kept(frame(spark, rows)).where("v is not null"))
    for r in state.collect():
        d = sorted(math.dist(r.v, c) for c in cs)
        assert d[0] <= r.upper + 1e-6 and (r.lower <= d[1] + 1e-6 or d[0] == d[1])
    assert sum(r.scanned for r in state.collect()) < 2.5 * len(rows)  # four passes


def test_loosening_is_safe_and_below_the_full_drift():
    rng, spared = np.random.default_rng(3), 0
    for _ in range(200):
        old = rng.normal(0, 5, (4, 3))
        new, radius = old + rng.normal(0, 1, (4, 3)), rng.uniform(0, 3, 4)
        moved, others = centroids.loosened(old, new, radius)
        for i in range(4):
            way = rng.normal(0, 1, (300, 3))
            x = old[i] + way / np.linalg.norm(way, axis=1)[:, None] * (radius[i] * rng.uniform(0, 1, 300) ** (1 / 3))[:, None]
            for j in set(range(4)) - {i}:
                assert (np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)).max() <= others[i] + 1e-9
            full = max(moved[j] for j in range(4) if j != i)
            assert others[i] <= full + 1e-12
            spared += others[i] < 0.95 * full
    assert spared > 200


def test_odd_tables(spark):
    assert centroids.cluster(frame(spark, []).limit(0)).count() == 0
    odd = [(1, None), (2, [0.0] * 63), (3, [0.0] * 63 + [None]), (4, [0.0] * 63 + [float("nan")]), (5, [float("-inf")] + [0.0] * 63), (6, [0.0] * 65)]
    assert centroids.cluster(frame(spark, odd)).count() == 0
    few = [(7, [0.5] * 64), (8, [-0.5] * 64)]
    assert sorted((r.vec_id, r.distance) for r in centroids.cluster(frame(spark, odd + few)).collect()) == [(7, 0), (8, 0)]
    far = [(9, [1e300] + [0.0] * 63)]
    assert {r.vec_id: r.cluster is None for r in centroids.cluster(frame(spark, far + few)).collect()} == {7: False, 8: False, 9: True}
    wide = [(1, [2.0**24] * 64), (2, [-(2.0**24)] * 64)]
    assert [tuple(r)[2:5] for r in centroids.cluster(frame(spark, wide), k=1).collect()].count((None, None, None)) >= 1
