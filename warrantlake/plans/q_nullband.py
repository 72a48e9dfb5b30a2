"""Nulls and guards of drift settings over the reference events, and the null and power of pilots' spreads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warrantlake.functions.rng import draw_sql
from warrantlake.operators import drift as D
from warrantlake.operators import nullband as N
from warrantlake.plans.q_paired import _rounded
from warrantlake.sources.shared import written
from warrantlake.sources.views import SCORED, TRAFFIC, scored_items, traffic

WINDOWS, BINS, STABLE, REPEATS = [50, 200, 800], [5, 20], [0.1, 0.25], 100
PILOTS, COLLAPSES, FROZEN, DRAWS = [6, 12, 24], [1.0, 0.6, 0.3], 0.5, 400


def _settings(s: SparkSession, d: str) -> DataFrame:
    """Windows, bins and bands over the shares that the reference values have in equal-width bins of their middle part."""
    ref = traffic(s, d).where("not live").select(F.col("value").alias("v"))
    sizes = ref.withColumn("bins", F.explode(F.array(*[F.lit(b) for b in BINS]))).withColumn("bin", F.least(F.floor(F.col("v") * F.col("bins") / 150), F.col("bins") - 1).cast("int"))
    counted = sizes.groupBy("bins", "bin").agg(F.count("*").alias("c"))
    shares = counted.groupBy("bins").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "c"))), lambda b: b["c"].cast("double")).alias("probabilities"), F.sum("c").alias("n_reference"))
    return shares.withColumn("n", F.explode(F.array(*[F.lit(w) for w in WINDOWS]))).withColumn("stable", F.explode(F.array(*[F.lit(b) for b in STABLE])))


def _guarded(s: SparkSession, d: str) -> DataFrame:
    return _rounded(N.guarded(_settings(s, d), ["bins", "n", "stable"], 0.05, REPEATS))


def _grid(s: SparkSession, d: str) -> DataFrame:
    """The reference is as large as the smallest evaluation set."""
    least = scored_items(s, d).groupBy("eval_set_id").agg(F.count("*").alias("c")).agg(F.min("c").cast("int").alias("n_reference"))
    sizes = written(least.withColumn("n", F.explode(F.array(*[F.lit(n) for n in PILOTS]))), "sizes")
    return _rounded(N.power_grid(sizes, COLLAPSES, FROZEN, N.SHAPES, DRAWS))


_VALUES = lambda xs, cast="": ", ".join(f"({x}{cast})" for x in xs)
_GUARD = f"""WITH {TRAFFIC}, k AS (SELECT bins, least(CAST(floor(value * bins / 150) AS INTEGER), bins - 1) AS bin, count(*) AS c FROM traffic, (VALUES {_VALUES(BINS)}) b(bins) WHERE NOT live GROUP BY 1, 2),
p AS (SELECT bins, list(c::DOUBLE ORDER BY bin) AS cs, CAST(sum(c) AS BIGINT) AS n_reference, sum(c)::DOUBLE AS total FROM k GROUP BY 1),
q AS (SELECT *, list_transform(range(1, len(cs) + 1), lambda i: list_sum(cs[1:i]) / total) AS upto FROM p),
sd AS (SELECT bins, n, upto, side, CASE side WHEN 'ref' THEN n_reference ELSE n END AS size FROM q, (VALUES {_VALUES(WINDOWS)}) w(n), (VALUES ('ref'), ('live')) s(side)),
u AS (SELECT bins, n, upto, side, size, rep, {draw_sql("side", "rep", "i")} / 4503599627370496::DOUBLE AS u FROM (SELECT *, unnest(range(0, size)) AS i FROM (SELECT *, unnest(range(0, {REPEATS})) AS rep FROM sd))),
h AS (SELECT bins, n, rep, least(len(list_filter(upto, lambda c: c <= u)), len(upto) - 1) AS bin, count(*) FILTER (side = 'ref')::DOUBLE / max(size) FILTER (side = 'ref') AS ref, count(*) FILTER (side = 'live')::DOUBLE / max(size) FILTER (side = 'live') AS live FROM u GROUP BY 1, 2, 3, 4),
v AS (SELECT bins, n, rep, sum((greatest(coalesce(live, 0), 1e-6) - greatest(coalesce(ref, 0), 1e-6)) * ln(greatest(coalesce(live, 0), 1e-6) / greatest(coalesce(ref, 0), 1e-6))) AS v FROM h GROUP BY 1, 2, 3)
SELECT bins, n, stable, round(quantile_cont(v, 0.5), 9) AS p50, round(quantile_cont(v, 0.95), 9) AS p95, round(quantile_cont(v, 0.99), 9) AS p99, round(avg(CASE WHEN v > stable THEN 1::DOUBLE ELSE 0 END), 9) AS false_alarm_rate,
  avg(CASE WHEN v > stable THEN 1::DOUBLE ELSE 0 END) <= 0.05 AS accepted FROM v, (VALUES {_VALUES(STABLE, "::DOUBLE")}) b(stable) GROUP BY 1, 2, 3"""


def _draws(name: str, sizes: str, side: str, keys: str) -> str:
    u, v = (f"{draw_sql(f"'{x}'", 'rep', 'i')} / 4503599627370496::DOUBLE" for x in (side, f"{side}2"))
    return f"""{name} AS (SELECT {keys}, rep, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM (SELECT {keys}, rep, CASE shape WHEN 'normal' THEN sqrt(-2 * ln(u)) * cos({2 * math.pi!r}::DOUBLE * v) WHEN 'logistic' THEN ln(u / (1 - u)) ELSE 0.5::DOUBLE + cos((acos(1 - 2 * u) + {4 * math.pi!r}::DOUBLE) / 3) END AS x
      FROM (SELECT {keys}, rep, greatest({u}, {2.0**-60!r}::DOUBLE) AS u, {v} AS v FROM (SELECT *, unnest(range(0, size)) AS i FROM (SELECT *, unnest(range(0, {DRAWS})) AS rep FROM {sizes})))) GROUP BY ALL)"""


_POWER = f"""WITH {SCORED}, le AS (SELECT min(c)::INTEGER AS n_reference FROM (SELECT count(*) AS c FROM scored GROUP BY eval_set_id)), sh AS (SELECT * FROM (VALUES ('normal'), ('logistic'), ('beta2_2')) s(shape)),
ps AS (SELECT shape, n, n AS size FROM sh, (VALUES {_VALUES(PILOTS)}) p(n)), rs AS (SELECT shape, n_reference, n_reference AS size FROM sh, le),
{_draws("pi", "ps", "pilot", "shape, n")}, {_draws("rf", "rs", "reference", "shape, n_reference")},
r AS (SELECT pi.shape, n, n_reference, pi.iqr / rf.iqr AS ratio FROM pi JOIN rf ON rf.shape = pi.shape AND rf.rep = pi.rep),
b AS (SELECT shape, n, n_reference, {", ".join(f"quantile_cont(ratio, {p}) AS {name}" for name, p in (("p2_5", 0.025), ("p5", 0.05), ("p50", 0.5), ("p95", 0.95), ("p97_5", 0.975)))}, avg(CASE WHEN ratio < {FROZEN} THEN 1::DOUBLE ELSE 0 END) AS fa FROM r GROUP BY 1, 2, 3)
SELECT r.shape, r.n, r.n_reference, collapse, round(avg(CASE WHEN ratio * collapse < {FROZEN}::DOUBLE THEN 1::DOUBLE ELSE 0 END), 9) AS power_frozen, round(avg(CASE WHEN ratio * collapse < p5 THEN 1::DOUBLE ELSE 0 END), 9) AS power_recalibrated,
  {", ".join(f"round(any_value({c}), 9) AS {c}" for c in ("p2_5", "p5", "p50", "p95", "p97_5"))}, round(any_value(fa), 9) AS false_alarm_rate
FROM r JOIN b ON b.shape = r.shape AND b.n = r.n, (VALUES {_VALUES(COLLAPSES, "::DOUBLE")}) c(collapse) GROUP BY 1, 2, 3, 4"""


def _watched(s: SparkSession, d: str, key: Column) -> tuple[DataFrame, dict[str, int], DataFrame]:
    """Binned events with their ``shard``, each feature's number of bins, and the shares that are expected of them."""
    cuts = D.edges(traffic(s, d).where("not live").withColumn("_one", F.lit(1)), ["_one"], "value").select("edges")
    read = traffic(s, d, k=F.get_json_object("props", "$.k").cast("int")).where("event_id is not null")
    x = read.crossJoin(F.broadcast(cuts)).withColumn("shard", key)
    bins = {"value": (D.bin_of(F.col("value"), F.col("edges")), 8), "event_type": (F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("event_type")).cast("int") - 1, len(TYPES)), "k": (F.when(F.col("k") >= 20, F.floor(F.col("k") / 20).cast("int") - 1), 4), "latency": (F.lit(None).cast("int"), 4)}
    known = x.select("shard", "ts", "event_id", "live", *(b.alias(f"bin_{name}") for name, (b, _) in bins.items()))
    sizes = {name: n for name, (_, n) in bins.items()}
    return known, sizes, D.expected_shares(known.where("not live"), sizes)


def windows(s: SparkSession, d: str, key: Column, window: int) -> DataFrame:
    """Windows over a numeric value, a category, an attribute that some events lack, and a feature that none has."""
    known, sizes, expected = _watched(s, d, key)
    return D.verdicts(known, "shard", F.unix_micros(F.col("ts").cast("timestamp")), ["ts", "event_id"], sizes, expected, window)


def last_windows(s: SparkSession, d: str, key: Column, window: int) -> DataFrame:
    """The verdict of each shard's last window, of the same features."""
    known, sizes, expected = _watched(s, d, key)
    return D.last_verdicts(known, "shard", ["ts", "event_id"], sizes, written(expected, "expected"), window)


def _verdict(s: SparkSession, d: str) -> DataFrame:
    told = windows(s, d, F.col("user_id") % 4, 200)
    return told.select("event_id", "n", *(F.round(f"psi_{name}", 6).alias(f"psi_{name}") for name in _SIZES), "state", "driver", F.concat_ws(",", "unobserved").alias("unobserved"))


TYPES = ["click", "error", "purchase", "signup", "view"]


def _psi_sql(name: str, n: int) -> str:
    total = "(" + " + ".join(f"c_{name}_{i}" for i in range(n)) + ")"
    terms = [f"(greatest(c_{name}_{i} / {total}::DOUBLE, 1e-6) - greatest(e_{name}_{i}, 1e-6)) * ln(greatest(c_{name}_{i} / {total}::DOUBLE, 1e-6) / greatest(e_{name}_{i}, 1e-6))" for i in range(n)]
    empty = [f"CASE WHEN c_{name}_{i} = 0 OR e_{name}_{i} <= 1e-6 THEN {term} ELSE 0 END" for i, term in enumerate(terms)]
    known = f"CASE WHEN {total} > 0 AND e_{name}_0 IS NOT NULL THEN"
    return f"{known} {' + '.join(terms)} END AS psi_{name}, {known} {' + '.join(empty)} END AS empty_{name}"


_SIZES = {"value": 8, "event_type": 5, "k": 4, "latency": 4}
_STATE = lambda c: f"CASE WHEN {c} < 0.1 THEN 0 WHEN {c} < 0.25 THEN 1 ELSE 2 END"


def windows_sql(key: str, window: int) -> str:
    """The rows of ``windows`` as the table ``verdict``."""
    return f"""c0 AS (SELECT list_sort(list_distinct(quantile_cont(value, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]))) AS e FROM traffic WHERE NOT live),
x AS (SELECT t.event_id, t.ts, {key} AS shard, live, greatest(0, least(len(e) - 2, len(list_filter(e, lambda c: c <= value)) - 1)) AS bin_value, list_position({TYPES!r}, event_type) - 1 AS bin_event_type, CASE WHEN k >= 20 THEN k // 20 - 1 END AS bin_k, NULL::INTEGER AS bin_latency
  FROM traffic t JOIN (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) p ON p.event_id = t.event_id, c0),
ex AS (SELECT {", ".join(f"count(*) FILTER (bin_{f} = {i}) / nullif(count(bin_{f}), 0)::DOUBLE AS e_{f}_{i}" for f, n in _SIZES.items() for i in range(n))} FROM x WHERE NOT live),
w AS (SELECT event_id, ts, shard, count(*) OVER f AS n, {", ".join(f"count(*) FILTER (bin_{f} = {i}) OVER f AS c_{f}_{i}" for f, n in _SIZES.items() for i in range(n))} FROM x WINDOW f AS (PARTITION BY shard ORDER BY ts, event_id ROWS {window - 1} PRECEDING)),
p AS (SELECT event_id, ts, shard, n, {", ".join(_psi_sql(f, n) for f, n in _SIZES.items())} FROM w, ex),
v AS (SELECT *, list_filter([{", ".join(f"CASE WHEN psi_{f} IS NOT NULL THEN {{'s': {_STATE(f'psi_{f}')}, 'p': psi_{f}, 'o': {-at}, 'f': '{f}', 'z': 2 * empty_{f} > psi_{f}}} END" for at, f in enumerate(_SIZES))}], lambda r: r IS NOT NULL) AS found FROM p),
m AS (SELECT *, list_max(found) AS top FROM v),
verdict AS (SELECT event_id, ts, shard, n, {", ".join(f"CASE WHEN n >= {window} THEN round(psi_{f}, 6) END AS psi_{f}" for f in _SIZES)}, CASE WHEN n < {window} OR top IS NULL THEN 'INSUFFICIENT_DATA' ELSE ['INSIDE', 'MODERATE', 'SIGNIFICANT'][top.s + 1] END AS state, CASE WHEN n >= {window} THEN top.f END AS driver, coalesce(n >= {window} AND top.z, false) AS smoothed,
  CASE WHEN n < {window} THEN {list(_SIZES)!r} ELSE list_filter([{", ".join(f"CASE WHEN psi_{f} IS NULL THEN '{f}' END" for f in _SIZES)}], lambda r: r IS NOT NULL) END AS unobserved FROM m)"""


_VERDICT = f"""WITH {TRAFFIC}, {windows_sql("user_id % 4", 200)} SELECT event_id, n, {", ".join(f"psi_{f}" for f in _SIZES)}, state, driver, array_to_string(unobserved, ',') AS unobserved FROM verdict"""

QUERIES = {
    "sr03_guard": (_guarded, _GUARD),
    "pl14_power_grid": (_grid, _POWER),
    "wn04_drift_verdict": (_verdict, _VERDICT),
}
