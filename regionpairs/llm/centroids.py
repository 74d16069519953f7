"""Operator 11: centroid clustering of integer vectors, with bounds that tighten each centroid's drift by geometry.

Lloyd's rounds with exact integer arithmetic. A vector keeps its cluster, an upper bound of the distance to its own centroid
and a lower bound of that to all others. All vectors of a cluster lie in a sphere around its old centroid. When another
centroid moves from p to q, the lower bound need not give way by the full drift |pq|: the points of the sphere that
come nearer to it the most lie in the plane of the sphere's centre, p and q, and there a point that is seen from the middle of pq
at an angle t from the direction of the move comes nearer by |pq| cos t at most (its hyperbola lies within its asymptotes).
Vectors whose bounds still part need no distance at all; of all others all distances are computed exactly.

State travels with its vector, as a table in the shared folder per round, so nothing is shuffled but sums per cluster.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import through_table, tidy

#: Scaled components beyond this have distances that a long cannot hold.
TOP = 1 << 31
STATE = "vec_id long, v array<int>, cluster int, upper double, lower double, scanned int"


def kept(vectors: DataFrame, dim: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, v: floor(scale * x) of the vectors of dim components, none null or non-finite; v is null where a component is beyond TOP."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    got = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e")).where((F.size("e") == dim) & F.forall("e", finite))
    y = F.transform("e", lambda x: x.cast("double") * scale)
    fits = F.forall(y, lambda x: (x >= -TOP) & (x < TOP))
    return got.select("vec_id", F.when(fits, F.transform(y, lambda x: F.floor(x).cast("int"))).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str = "1:") -> list[list[int]]:
    """The k vectors whose id hashes lowest; ties (repeated ids) by their components."""
    h = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r.v) for r in vectors.orderBy(h, "v").limit(k).select("v").collect()]


def squared(x, c):
    """Exact squared distances of rows of integers to centroids: floating point while every step is exact in it, else 64-bit, else Python's integers."""
    import numpy as np

    c = np.array(c, object)
    top = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))), *(abs(y) for y in c.flat))
    if 4 * x.shape[1] * top * top < 1 << 53:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    kind = np.int64 if 4 * x.shape[1] * top * top < 1 << 63 else object
    x, c = x.astype(kind), c.astype(kind)
    return np.stack([((x - y) ** 2).sum(1) for y in c], 1)


def loosened(old, new, radius):
    """(how far each centroid moved, how much any other centroid can have come nearer to a vector in each cluster's sphere).

    The second is at most the largest move of the others.
    """
    import numpy as np

    p, q = np.array(old, float), np.array(new, float)
    moved = np.sqrt(((q - p) ** 2).sum(1))
    axis = (q - p) / np.maximum(moved, 1e-300)[:, None]
    seen = p[:, None, :] - ((p + q) / 2)[None, :, :]  # each sphere's centre from the middle of each move
    along, far = (seen * axis[None]).sum(2), np.sqrt((seen**2).sum(2))
    off = np.arctan2(np.sqrt(np.maximum(far**2 - along**2, 0)), along)
    wide = np.where(radius[:, None] < far, np.arcsin(np.minimum(radius[:, None] / np.maximum(far, 1e-300), 1)), np.pi)
    nearest = np.maximum(off - wide - 1e-6, 0)  # the slack covers rounding
    nearer = moved[None, :] * np.maximum(np.cos(nearest), 0)
    np.fill_diagonal(nearer, 0)
    return moved, nearer.max(1)


def _rows(batch):
    import numpy as np

    v = batch.column("v")
    return v.flatten().to_numpy().reshape(len(v), -1).astype(np.int64)


@tidy
def _first(batches, centroids):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            cluster, upper, lower = _nearest(squared(_rows(batch), centroids))
            yield _state(batch, cluster, upper, lower, np.ones(batch.num_rows, np.int32), pa)


def _nearest(d):
    """Cluster (of equals the smallest), distance to it and to the next of the others."""
    import numpy as np

    n = np.arange(len(d))
    cluster, rest = d.argmin(1), d.astype(float)
    upper = np.sqrt(rest[n, cluster])
    rest[n, cluster] = np.inf
    return cluster, upper, np.sqrt(rest.min(1))


def _state(batch, cluster, upper, lower, scanned, pa):
    return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(scanned, pa.int32())], [x.split()[0] for x in STATE.split(", ")])


@tidy
def _moved(batches, old, new, radius):
    """State under the new centroids; scanned counts the vectors' full scans."""
    import numpy as np
    import pyarrow as pa

    own, others = loosened(old, new, radius)
    for batch in batches:
        if not batch.num_rows:
            continue
        x, cluster = _rows(batch), batch.column("cluster").to_numpy().copy()
        upper, lower = batch.column("upper").to_numpy() + own[cluster], batch.column("lower").to_numpy() - others[cluster]
        scanned = batch.column("scanned").to_numpy().copy()
        sure = lambda k: upper[k] * (1 + 1e-9) + 1e-6 < lower[k] * (1 - 1e-9)
        left = np.flatnonzero(~sure(slice(None)))
        upper[left] = np.sqrt(_to_own(x[left], cluster[left], new).astype(float))
        left = left[~sure(left)]
        if len(left):
            cluster[left], upper[left], lower[left] = _nearest(squared(x[left], new))
            scanned[left] += 1
        yield _state(batch, cluster, upper, lower, scanned, pa)


def _to_own(x, cluster, centroids):
    """Exact squared distance of each row to its own centroid."""
    import numpy as np

    out = np.zeros(len(x), object)
    for c in np.unique(cluster):
        at = np.flatnonzero(cluster == c)
        out[at] = squared(x[at], [centroids[c]])[:, 0]
    return out


@tidy
def _distances(batches, centroids):
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            d = _to_own(_rows(batch), batch.column("cluster").to_numpy(), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array([y if y < 1 << 63 else None for y in d], pa.int64())], ["vec_id", "cluster", "distance"])


def updated(state: DataFrame, centroids: list[list[int]]):
    """(floors of the means, the old ones' radii): sums per partition first, then one row of them per cluster; k rows come to the driver."""
    import numpy as np

    dim = len(centroids[0])
    part = state.groupBy("cluster", F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.max("upper").alias("radius"), F.array(*(F.sum(F.col("v")[i].cast("long")) for i in range(dim))).alias("s"))
    # a partition's sums fit a long, those of all need not
    rows = part.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.array(*(F.sum(F.col("s")[i].cast("decimal(20,0)")) for i in range(dim))).alias("s")).collect()
    new, radius = [list(c) for c in centroids], np.zeros(len(centroids))
    for r in rows:
        new[r.cluster] = [int(x) // r.n for x in r.s]
        radius[r.cluster] = r.radius * (1 + 1e-9) + 1e-6
    return new, radius


def fit(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1:") -> tuple[DataFrame, list[list[int]]]:
    """(state after a last assignment, centroids) for vectors (vec_id, v) of one length without nulls.

    Ties go to the smaller centroid; empty clusters keep theirs; with fewer than k vectors each is one. Repeated rows count
    as often as they occur. No vectors: an empty state and no centroids.
    """
    centroids = first_centroids(vectors, k, seed)
    state = vectors.mapInArrow(functools.partial(_first, centroids=centroids), STATE)
    for _ in range(rounds if centroids else 0):
        state = through_table(state, "vectors")
        new, radius = updated(state, centroids)
        state = state.mapInArrow(functools.partial(_moved, old=centroids, new=new, radius=radius), STATE)
        centroids = new
    return state, centroids


def cluster(vectors: DataFrame, dim: int = 64, scale: int = 64, k: int = 16, rounds: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector (columns vec_id, embedding; see kept and fit).

    Other columns don't matter. A null vec_id hashes as an empty one. A vector with a component beyond TOP after scaling has
    a row of nulls and takes no part; a distance or an inertia that a long can't hold is null.
    """
    import hashlib

    whole = kept(vectors, dim, scale)
    state, centroids = fit(whole.where("v is not null"), k, rounds)
    near = through_table(state.mapInArrow(functools.partial(_distances, centroids=centroids), "vec_id long, cluster int, distance long"), "clusters")
    # null wherever one distance is
    total = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")
    sums = {r.cluster: r.s for r in near.groupBy("cluster").agg(total).collect()}
    long = lambda x: int(x) if x is not None and x < 1 << 63 else None
    every = None if None in sums.values() else long(sum(sums.values()))
    names = [(c, long(s), every, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    # one row per cluster: k bounds it
    per = vectors.sparkSession.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = near.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    void = [F.lit(None).cast(t).alias(c) for c, t in out.dtypes[1:]]
    return out.unionByName(whole.where("v is null").select("vec_id", *void))


def _oracle(k: int = 16, rounds: int = 3) -> str:
    near = lambda c: f"(SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT k.vec_id, k.v, x.c, CAST(list_sum(list_transform(list_zip(k.v, x.v), lambda y: (y[1] - y[2]) * (y[1] - y[2]))) AS BIGINT) AS d FROM k, {c} x) GROUP BY vec_id, v)"
    out = f"""WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM k ORDER BY h LIMIT {k}))"""
    for r in range(rounds):
        out += f""",
a{r} AS {near(f"c{r}")},
m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY c, i) GROUP BY c),
c{r + 1} AS (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} ON m{r}.c = c{r}.c)"""
    return out + f""",
z AS {near(f"c{rounds}")}
SELECT vec_id, CAST(z.c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256 FROM z JOIN c{rounds} f ON f.c = z.c"""


ORACLE = _oracle()
