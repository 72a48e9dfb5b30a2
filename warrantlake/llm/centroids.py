"""Centroid clustering: Lloyd's rounds in whole numbers, with lower bounds that drift by planar geometry.

Every vector keeps its cluster and a lower bound of its distance to any other centroid. When centroids move, the
bound of a cluster's members has to fall by the most that any of them can have come nearer to a moved centroid.
The members lie in a sphere around their own old centroid, so that is the maximum of ``|x - old| - |x - new|``
over a sphere. Points for which the difference is at least ``2 h cos(t)`` (``2 h``: how far the centroid moved) lie
on one sheet of a hyperbola, inside the cone of half angle ``t`` around the line of the move, with its tip at the
midpoint. In the plane through the line and the sphere's centre, the least angle that the sphere reaches is the
angle of its centre less its angular radius; ``2 h`` times its cosine is the drift, nought where the sphere lies
behind the midpoint. It is never more than the full drift ``2 h``. Vectors whose own exact distance is below the
loosened bound, or below half the way to the nearest other centroid, keep their cluster; the rest are scanned
against all centroids exactly. Results are those of plain rounds.

Spark holds the state: one table a round (vector, cluster, distance, bound), written to the shared folder. What
leaves the tasks in a round is one row for each cluster: component sums, count and radius. The driver holds the
centroids alone.

Vectors that are null, of another length, or hold a null, NaN or infinite component are left out, as contracted.
Components are ``floor(256 x)`` in double precision; one of more than 2^19 in size is refused with an error, as
squared distances would pass the range of a long. Equal distances go to the smaller number. Rows of equal or null id
are vectors like any other (a null id is hashed as the empty text; ties of the starting order go by components). With
fewer vectors than clusters there are fewer centroids, and copies may start as equal ones, of which the later stay
empty and where they are. An empty table gives no rows. Only ``vec_id`` and ``embedding`` are read, whatever other
columns there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warrantlake.llm.common import forget, table, written

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 40, 5, 64, 256
#: Largest size of a component whose squared distances fit a long, and of one whose sums are exact in a double.
WHOLE, EXACT = 1 << 19, 1 << 13
STATE = "vec_id long, vec array<int>, cluster int, distance long, lower double"


def whole_numbers(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, vec): the vectors of ``dimensions`` finite components, as integers ``floor(scale * x)``."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where((F.size("embedding") == dimensions) & finite).select("vec_id", x.alias("vec"))
    return kept.select("vec_id", F.transform("vec", lambda v: F.when(F.abs(v) > WHOLE, F.raise_error(F.lit(f"a component is larger than {WHOLE}"))).otherwise(F.floor(v * scale)).cast("int")).alias("vec"))


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, salt: str = "2") -> np.ndarray:
    """The vectors of the smallest hashes of their ids, in the order of the hashes."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.select("vec", key.alias("key")).orderBy("key", "vec").limit(clusters).collect()
    return np.array([r["vec"] for r in rows], np.int64)


def _squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows x centroids: in doubles as long as these hold every sum, else in integers."""
    small = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT * SCALE and x.shape[1] <= 128
    a, c = (x.astype(np.float64), centroids.astype(np.float64)) if small else (x.astype(np.int64), centroids)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)


def drifts(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """clusters x centroids: how much nearer than ``old[j]`` a point of the sphere (old[i], radius[i]) can be to ``new[j]``."""
    old, new = old.astype(np.float64), new.astype(np.float64)
    moved = np.sqrt(((new - old) ** 2).sum(axis=1))
    along = (new - old) / np.where(moved > 0, moved, 1.0)[:, None]
    offset = old[:, None, :] - ((old + new) / 2)[None, :, :]  # from each midpoint to each sphere's centre
    x = (offset * along[None, :, :]).sum(axis=2)
    far = np.sqrt((offset**2).sum(axis=2))
    inside = far <= radius[:, None]
    angle = np.arctan2(np.sqrt(np.maximum(far**2 - x**2, 0)), x) - np.arcsin(np.where(inside, 0.0, radius[:, None] / np.where(inside, 1.0, far)))
    share = np.where(inside, 1.0, np.cos(np.clip(angle, 0, np.pi / 2)))
    return moved[None, :] * np.minimum(share * (1 + 1e-9) + 1e-12, 1.0)


def loosened(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By cluster: the fall of its members' lower bound, and half the way from its new centroid to the nearest other."""
    k = len(new)
    if k == 1:
        return np.zeros(1), np.full(1, np.inf)
    other = ~np.eye(k, dtype=bool)
    fall = np.where(other, drifts(old, new, radius), 0).max(axis=1)
    return fall, np.sqrt(np.where(other, _squares(new, new), np.iinfo(np.int64).max).min(axis=1)) / 2


def assigned(state: DataFrame, new: np.ndarray, old: np.ndarray | None = None, radius: np.ndarray | None = None) -> DataFrame:
    """``state`` after its vectors went to the nearest of ``new``; without ``old`` all are scanned."""
    fall, half = loosened(old, new, radius) if old is not None else (None, None)

    def scan(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = _squares(x, new)
        best = d.argmin(axis=1)
        at = np.arange(len(x))
        least = d[at, best]
        d[at, best] = np.iinfo(np.int64).max
        return best, least, np.sqrt(d.min(axis=1)) if len(new) > 1 else np.full(len(x), np.inf)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)
            if fall is None:
                cluster, distance, lower = scan(x)
            else:
                cluster = batch.column("cluster").to_numpy().astype(np.int64)
                distance = ((x - new[cluster]) ** 2).sum(axis=1)
                lower = batch.column("lower").to_numpy() - fall[cluster]
                # A relative slack keeps rounded roots on the safe side; what is left open is scanned.
                open_ = np.flatnonzero(np.sqrt(distance) * (1 + 1e-9) >= np.maximum(lower, half[cluster]))
                if len(open_):
                    cluster[open_], distance[open_], lower[open_] = scan(x[open_])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(lower)], ["vec_id", "vec", "cluster", "distance", "lower"])

    return state.mapInArrow(step, STATE)


def sums_of(state: DataFrame, clusters: int, dimensions: int) -> tuple[np.ndarray, list[list[int]], np.ndarray, list[int]]:
    """By cluster: count, component sums, largest distance and summed squared distance; one row a cluster leaves Spark."""
    parts = [F.sum(F.col("vec")[i].cast("long")).alias(f"s{i}") for i in range(dimensions)]
    rows = {r["cluster"]: r for r in state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), F.sum("distance").alias("inertia"), *parts).collect()}
    blank = {"n": 0, "far": 0, "inertia": 0} | {f"s{i}": 0 for i in range(dimensions)}
    found = [rows.get(c, blank) for c in range(clusters)]
    return np.array([r["n"] for r in found]), [[r[f"s{i}"] for i in range(dimensions)] for r in found], np.sqrt([float(r["far"]) for r in found]), [r["inertia"] for r in found]


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, vec, cluster, distance, lower) of every kept vector, the final centroids and each one's inertia."""
    kept = whole_numbers(vectors, dimensions)
    state = written(kept.select("vec_id", "vec", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0.0).alias("lower")), "vectors")
    now = first_centroids(state, clusters)
    if not len(now):
        return state, now.reshape(0, dimensions), []
    before, radius = None, None
    for _ in range(rounds):
        last, state = state, written(assigned(state, now, before, radius), "assigned")
        forget(last)
        n, sums, radius, _ = sums_of(state, len(now), dimensions)
        before, now = now, np.array([[s // int(n[c]) for s in sums[c]] if n[c] else now[c].tolist() for c in range(len(now))], np.int64)
    last, state = state, written(assigned(state, now, before, radius), "assigned")
    forget(last)
    return state, now, sums_of(state, len(now), dimensions)[3]


def op13_geometric_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, centroids, inertia = cluster(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per_cluster = spark.createDataFrame([(c, inertia[c], sum(inertia), digests[c]) for c in range(len(digests))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> str:
    """The same rounds as SQL: a table expression for each assignment and each set of centroids."""
    near = "list_sum(list_transform(range(1, %d), lambda i: (v.vec[i] - c.vec[i]) * (v.vec[i] - c.vec[i])))" % (dimensions + 1)

    def assigning(n: int) -> str:
        return f"a{n} AS MATERIALIZED (SELECT r, vec_id, v, min(d) AS d, arg_min(c, (d, c)) AS c FROM (SELECT v.r, v.vec_id, v.vec AS v, c.c, {near}::BIGINT AS d FROM k v, c{n} c) GROUP BY r, vec_id, v)"

    def moving(n: int) -> str:
        return f"""m{n} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, {dimensions + 1})) AS i FROM a{n}) GROUP BY c, i),
        l{n} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS vec FROM m{n} GROUP BY c),
        c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(l.vec, o.vec) AS vec FROM c{n} o LEFT JOIN l{n} l USING (c))"""

    parts = reduce(lambda a, n: [*a, assigning(n), moving(n)], range(rounds), [])
    return f"""
        WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS vec FROM embeddings
                   WHERE len(embedding) = {dimensions} AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x::DOUBLE), false)))),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY key, vec) - 1 AS c, vec FROM (SELECT vec, sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS key FROM k ORDER BY key, vec LIMIT {clusters})),
        {", ".join(parts)}, {assigning(rounds)},
        t AS (SELECT c, sum(d)::BIGINT AS s FROM a{rounds} GROUP BY c)
        SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, t.s AS cluster_inertia, (SELECT sum(s)::BIGINT FROM t) AS inertia, sha256(array_to_string(f.vec, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN t ON t.c = a.c JOIN c{rounds} f ON f.c = a.c"""
