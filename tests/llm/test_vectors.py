"""Operators on vectors against brute force: all pairs, and plain rounds of whole numbers."""

import hashlib
import math

import numpy as np
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from warrantlake.llm import centroids, registry, vectors

SF = "/root/testdata/sf0.001"
NAMES = "vec_id long, embedding array<double>, label int"


def crowd(seed=1, dimensions=64, spread=0.012, groups=((0, 60), (0, 25), (1, 40), (2, 3))):
    """Near copies in groups of a label, chains among them, exact copies, and strangers."""
    rng = np.random.default_rng(seed)
    rows = []
    for label, size in groups:
        centre = rng.normal(size=dimensions)
        centre /= np.linalg.norm(centre)
        rows += [(label, centre + rng.normal(size=dimensions) * spread * rng.uniform(0.5, 1.5)) for _ in range(size)]
    rows += [(int(rng.integers(0, 3)), rng.normal(size=dimensions)) for _ in range(120)]
    rows += [(label, 3 * x) for label, x in rows[:10]] + rows[:15] * 3
    order = rng.permutation(len(rows))
    return [(int(n) * 7 % 1009, [float(v) for v in rows[at][1]], rows[at][0]) for n, at in enumerate(order)]


def links_of(rows, threshold=0.98):
    """By row: links and the smallest id reachable, from all pairs."""
    n = len(rows)
    linked = np.zeros((n, n), bool)
    usable = [r[1] is not None and r[2] is not None and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1]) for r in rows]
    for i in range(n):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                linked[i, j] = linked[j, i] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold
    out = []
    for i in range(n):
        seen, queue = {i}, [i]
        while queue:
            for j in np.flatnonzero(linked[queue.pop()]).tolist():
                if j not in seen:
                    seen.add(j)
                    queue.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], int(linked[i].sum()), least, rows[i][0] == least))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"cell": 20, "chunk_bytes": 20_000}, {"cell": 5}, {"blocks": 3}, {"blocks": 64}, {"hot": 10}, {"threshold": 0.9, "cell": 20, "chunk_bytes": 9_000}])
def test_links_are_those_of_all_pairs(spark, how):
    rows = crowd()
    want = links_of(rows, how.get("threshold", 0.98))
    assert sum(r[1] for r in want) > 1000
    assert rows_of(vectors.near_vectors(spark.createDataFrame(rows, NAMES).repartition(5), **how)) == want


def test_short_vectors_and_a_threshold_met_exactly(spark):
    rows = [(1, [1.0], 0), (2, [2.0], 0), (3, [-1.0], 0), (4, [1.0, 0.0], 0), (5, [0.98, math.sqrt(1 - 0.98**2)], 0), (6, [1.0, 0.0, 0.0], 0), (7, [1e200, 1e199, 0.0], 0), (8, [1e-200, 1e-201, 0.0], 0)]
    got = rows_of(vectors.near_vectors(spark.createDataFrame(rows, NAMES)))
    assert [r[:3] for r in got] == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 2, 6), (7, 2, 6), (8, 2, 6)]


ODD = [(1, None, 0), (2, [], 0), (3, [0.0] * 64, 0), (4, [0.0] * 64, 0), (5, [1.0] * 64, None), (6, [1.0] * 64, None), (7, [1.0] * 63 + [None], 0), (8, [1.0] * 63, 0), (9, [float("nan")] * 64, 0), (10, [float("inf")] * 64, 0), (11, [1.0] * 64, 0), (None, [1.0] * 64, 0), (12, [2.0] * 64, 0), (12, [2.0] * 64, 0), (13, [1.0] * 64, 1), (None, [0.5] * 64, 2), (14, [-0.0] * 63 + [1.0], 3), (15, [0.0] * 63 + [1.0], 3)]


def odd(spark):
    return spark.createDataFrame(ODD, NAMES).withColumns({c: F.lit("x") for c in ("vec", "k", "n", "cid", "d", "block", "cell", "cluster", "lower", "distance", "key")})


def test_odd_vectors(spark):
    assert rows_of(vectors.near_vectors(odd(spark))) == links_of(ODD)
    assert vectors.near_vectors(odd(spark).where("false")).collect() == []


def test_a_pair_within_budget_in_every_block_counts_once():
    y = np.random.default_rng(0).normal(size=(700, 6)) * 0.05
    d = ((y[:, None] - y[None]) ** 2).sum(axis=2)
    met = [tuple(sorted(p)) for a, b in vectors.range_pairs(y, 0.01, leaf=40) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(met) == len(set(met))
    assert {(i, j) for i, j in zip(*np.nonzero(np.triu(d <= 0.01, 1)), strict=True)} <= set(met)


def test_spanning_forests_join_what_links_join():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 200, 150), rng.integers(0, 200, 150)
    roots = np.arange(200)
    u, v = vectors.spanning(a, b, roots)
    assert len(u) == 200 - len(set(roots.tolist()))
    again = np.arange(200)
    vectors.spanning(u, v, again)
    assert [len(set(zip(roots.tolist(), again.tolist(), strict=True)))] == [len(set(roots.tolist()))]


@pytest.mark.parametrize("name", ["op11_subspace_pigeonhole", "op13_geometric_drift"])
def test_queries_equal_their_sql(spark, name):
    assert differences(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name]) == ""


def test_links_equal_their_sql_on_copies(spark, tmp_path):
    spark.createDataFrame(crowd(3) + ODD, NAMES).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = connect(SF)
    con.execute(f"create or replace view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    for name in ("op11_subspace_pigeonhole", "op13_geometric_drift"):
        assert differences(registry.queries()[name](spark, str(tmp_path)), con, registry.oracle_sql()[name]) == ""


# --- 13: centroids


def plain_rounds(rows, clusters, rounds):
    x = [(i, [math.floor(256 * v) for v in e]) for i, e, _ in rows]
    c = [v for _, v in sorted(x, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]]
    near = lambda v: min((sum((p - q) ** 2 for p, q in zip(v, m, strict=True)), at) for at, m in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in x]
        c = [[sum(v[i] for (_, v), o in zip(x, of, strict=True) if o == at) // of.count(at) for i in range(len(m))] if at in of else m for at, m in enumerate(c)]
    return sorted((i, near(v)[1], near(v)[0]) for i, v in x), c


@pytest.mark.parametrize(("clusters", "rounds"), [(7, 4), (1, 2), (400, 2), (3, 0)])
def test_rounds_are_those_of_plain_lloyd(spark, clusters, rounds):
    rows = crowd(5, spread=0.1)
    state, found, inertia = centroids.cluster(spark.createDataFrame(rows, NAMES), clusters, rounds)
    want, c = plain_rounds(rows, clusters, rounds)
    assert rows_of(state.select("vec_id", "cluster", "distance")) == sorted(want, key=repr)
    assert found.tolist() == c
    assert sum(inertia) == sum(d for *_, d in want)


def test_large_components_are_exact_or_refused(spark):
    rows = [(n, [v * 30_000.0 for v in e], label) for n, e, label in crowd(6, groups=())]
    state, found, _ = centroids.cluster(spark.createDataFrame(rows, NAMES), 5, 2)
    want, c = plain_rounds(rows, 5, 2)
    assert rows_of(state.select("vec_id", "cluster", "distance")) == sorted(want, key=repr) and found.tolist() == c
    with pytest.raises(Exception, match="larger than"):
        centroids.cluster(spark.createDataFrame([(1, [1e7] * 64, 0)], NAMES), 5, 2)


def test_drift_bounds_every_point_of_a_sphere_and_is_below_the_full_one():
    rng = np.random.default_rng(2)
    old = rng.normal(size=(6, 8)) * 50
    new = old + rng.normal(size=(6, 8)) * 5
    new[5] = old[5]
    radius = np.array([0.0, 10, 40, 60, 200, 30])
    bound = centroids.drifts(old, new, radius)
    full = np.linalg.norm(new - old, axis=1)
    assert (bound <= full[None, :] + 1e-9).all() and (bound[:, 5] == 0).all()
    assert (bound[:3, :5] < 0.999 * full[None, :5]).mean() > 0.5
    for i in range(6):
        u = rng.normal(size=(4000, 8))
        x = old[i] + u / np.linalg.norm(u, axis=1, keepdims=True) * radius[i] * rng.random((4000, 1)) ** 0.125
        nearer = np.linalg.norm(x[:, None] - old[None], axis=2) - np.linalg.norm(x[:, None] - new[None], axis=2)
        assert (nearer.max(axis=0) <= bound[i] + 1e-6).all()


def test_bounds_leave_most_vectors_unscanned(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 64))
    rows = [(n, (centres[n % 6] + rng.normal(size=64) * 0.2).tolist(), 0) for n in range(600)]
    state = centroids.whole_numbers(spark.createDataFrame(rows, NAMES)).select("vec_id", "vec", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0.0).alias("lower"))
    now, before, radius = centroids.first_centroids(state, 8), None, None
    for _ in range(4):
        state = centroids.assigned(state, now, before, radius).cache()
        n, sums, radius, _ = centroids.sums_of(state, 8, 64)
        before, now = now, np.array([[s // int(n[c]) for s in sums[c]] if n[c] else now[c].tolist() for c in range(8)])
    fall, half = centroids.loosened(before, now, radius)
    left = [math.dist(r["vec"], now[r["cluster"]]) < max(r["lower"] - fall[r["cluster"]], half[r["cluster"]]) for r in state.collect()]
    assert sum(left) > 0.6 * len(left)


def test_odd_tables_of_vectors(spark):
    state, found, _ = centroids.cluster(odd(spark), 40, 2)
    kept = [r for r in ODD if r[1] is not None and len(r[1]) == 64 and all(v is not None and math.isfinite(v) for v in r[1])]
    assert sorted([r["vec_id"] for r in state.collect()], key=repr) == sorted([r[0] for r in kept], key=repr)
    assert len(found) == len(kept)
    empty, none, _ = centroids.cluster(odd(spark).where("false"))
    assert empty.collect() == [] and len(none) == 0
