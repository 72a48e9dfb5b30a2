"""Drift and resampling queries: events against a reference half-month, and bootstraps of scored items."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from warrantlake.functions.rng import draw, draw_sql, uniform
from warrantlake.operators import drift as D
from warrantlake.operators import metrics as M
from warrantlake.operators import nullband as N
from warrantlake.operators import resample as R
from warrantlake.sources.shared import written
from warrantlake.sources.views import SCORED, TRAFFIC, scored_items, traffic

KEY, TYPES, WINDOW, P0 = ["event_type"], ["click", "error", "purchase", "signup", "view"], 200, 0.15
TAU = 0.1
#: Samples of the simulated nulls.
NULLS = 400
#: Bootstrap replicates, those of paired differences, and seeds of the stability sweep.
REPS, PAIRED_REPS, SEEDS = 1000, 2000, 400

EDGES = f"""{TRAFFIC}, cuts AS (SELECT event_type, list_sort(list_distinct(quantile_cont(value, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]))) AS e FROM traffic WHERE NOT live GROUP BY 1),
binned AS (SELECT t.event_type, live, value, greatest(1, least(len(e) - 1, len(list_filter(e, lambda c: c <= value)))) AS b FROM traffic t JOIN cuts c ON t.event_type = c.event_type),
env AS (SELECT c.event_type, b, e[b] AS lo, e[b + 1] AS hi FROM (SELECT *, unnest(range(1, len(e))) AS b FROM cuts) c),
ref AS (SELECT v.event_type, v.b, v.lo, v.hi, greatest(coalesce(k.c, 0) / CAST(n.n AS DOUBLE), 1e-6) AS raw, n.n, n.mean, n.std FROM env v
  LEFT JOIN (SELECT event_type, b, count(*) AS c FROM binned WHERE NOT live GROUP BY 1, 2) k ON k.event_type = v.event_type AND k.b = v.b
  JOIN (SELECT event_type, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM traffic WHERE NOT live GROUP BY 1) n ON n.event_type = v.event_type),
envelope AS (SELECT *, raw / sum(raw) OVER (PARTITION BY event_type) AS p FROM ref)"""
PSI = f"""{EDGES}, lv AS (SELECT event_type, count(*) AS n FROM traffic WHERE live GROUP BY 1), lc AS (SELECT event_type, b, count(*) AS c FROM binned WHERE live GROUP BY 1, 2),
terms AS (SELECT e.event_type, lv.n AS n_live, e.n AS n_reference, coalesce(lc.c, 0) = 0 OR p <= 1e-6 AS smoothed, greatest(coalesce(lc.c, 0) / CAST(lv.n AS DOUBLE), 1e-6) AS a, greatest(p, 1e-6) AS x
  FROM envelope e JOIN lv ON lv.event_type = e.event_type LEFT JOIN lc ON lc.event_type = e.event_type AND lc.b = e.b),
psi AS (SELECT event_type, max(n_live) AS n_live, max(n_reference) AS n_reference, sum((a - x) * ln(a / x)) AS psi, count(*) FILTER (smoothed) AS bins_smoothed, coalesce(sum((a - x) * ln(a / x)) FILTER (smoothed), 0) AS sm FROM terms GROUP BY 1)"""


def _envelope(s, d):
    return D.envelope(traffic(s, d).where("not live"), KEY, "value")


def _psi(s, d):
    return D.psi(traffic(s, d).where("live"), _envelope(s, d), KEY, "value")


def _frame(key="user_id"):
    return Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(1 - 20, 0)


def _window_rate(s, d):
    return traffic(s, d).select("event_id", F.count("*").over(_frame()).alias("n"), F.round(F.avg((F.col("event_type") == "error").cast("double")).over(_frame()), 9).alias("error_rate"))


def _sliding(s, d):
    expected = {c: 0.2 for c in TYPES}
    x = D.sliding_psi(traffic(s, d).withColumn("shard", F.col("user_id") % 4), "shard", F.unix_micros(F.col("ts").cast("timestamp")), ["ts", "event_id"], TYPES, "event_type", expected, WINDOW)
    return x.select("event_id", "n", F.round("psi", 6).alias("psi"), D.state(F.col("psi"), F.col("n"), WINDOW).alias("state"))


def _sliding_sql() -> str:
    counts = ", ".join(f"count(*) FILTER (event_type = '{c}') OVER w AS c{i}" for i, c in enumerate(TYPES))
    term = " + ".join(f"(greatest(c{i} / CAST(n AS DOUBLE), 1e-6) - 0.2::DOUBLE) * ln(greatest(c{i} / CAST(n AS DOUBLE), 1e-6) / 0.2::DOUBLE)" for i in range(len(TYPES)))
    return f"""WITH {TRAFFIC}, c AS (SELECT event_id, count(*) OVER w AS n, {counts} FROM traffic WINDOW w AS (PARTITION BY user_id % 4 ORDER BY ts, event_id ROWS {WINDOW - 1} PRECEDING)), p AS (SELECT event_id, n, {term} AS psi FROM c)
    SELECT event_id, n, round(psi, 6) AS psi, CASE WHEN n < {WINDOW} THEN 'INSUFFICIENT_DATA' WHEN psi < 0.1 THEN 'INSIDE' WHEN psi < 0.25 THEN 'MODERATE' ELSE 'SIGNIFICANT' END AS state FROM p"""


def _ladder(s, d):
    x = _psi(s, d).select("event_type", D.state(F.col("psi")).alias("state"))
    statuses = F.explode(F.array(*[F.lit(v) for v in ("VALID", "STALE", "REVOKED", "REFUSED")]))
    x = x.withColumn("before", statuses).withColumn("after", D.ladder(F.col("before"), F.col("state")))
    return x.withColumns({"changed": F.col("before") != F.col("after"), "widen": F.when(F.col("state") == "MODERATE", 1.5).otherwise(1.0)})


def _eprocess(s, d):
    x = D.e_process(traffic(s, d).withColumn("shard", F.col("user_id") % 8), "shard", F.unix_micros(F.col("ts").cast("timestamp")), ["ts", "event_id"], F.col("event_type") == "error", P0)
    return x.select("event_id", "n", "k", F.round("log_wealth", 6).alias("log_wealth"), "revoked")


def _eprocess_sql() -> str:
    logs = ", ".join(f"k * {math.log1p(b * (1 - P0))!r}::DOUBLE + (n - k) * {math.log1p(-b * P0)!r}::DOUBLE" for b in D.bets(P0))
    return f"""WITH {TRAFFIC}, r AS (SELECT event_id, ts, user_id % 8 AS shard, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS k, count(*) OVER w AS n FROM traffic WINDOW w AS (PARTITION BY user_id % 8 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    l AS (SELECT *, [{logs}] AS g FROM r), m AS (SELECT *, list_max(g) + ln(list_sum(list_transform(g, lambda v: exp(v - list_max(g)))) / 40) AS lw FROM l)
    SELECT event_id, n, k, round(lw, 6) AS log_wealth, max(lw) OVER (PARTITION BY shard ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= {math.log(20)!r}::DOUBLE AS revoked FROM m"""


def _resume(s, d):
    """Counts of the first half-month carried into the second: wealth goes on where it stopped."""
    x = traffic(s, d).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("k"), F.count_if(F.col("live")).alias("n_live"))
    grid = D.bets(0.5)
    return x.withColumn("log_wealth_last_bet", F.round(F.col("k") * math.log1p(grid[-1] * 0.5) + (F.col("n") - F.col("k")) * math.log1p(-grid[-1] * 0.5), 6))


def _groups(s, d, keys=("eval_set_id",)):
    return R.numbered_groups(scored_items(s, d), list(keys), "question_id", TAU)


GROUPS = f"""{SCORED}, grp AS (SELECT eval_set_id, question_id, count(*) FILTER (score >= {TAU} AND label = 1) AS tp, count(*) FILTER (score >= {TAU} AND label = 0) AS fp, count(*) FILTER (score < {TAU} AND label = 0) AS tn, count(*) FILTER (score < {TAU} AND label = 1) AS fn,
  row_number() OVER (PARTITION BY eval_set_id ORDER BY question_id) - 1 AS g, count(*) OVER (PARTITION BY eval_set_id) AS groups FROM scored GROUP BY 1, 2)"""


def quantile_sql(p: float, v: str = "v") -> str:
    """A percentile of the defined replicates; none where more than a tenth of them is undefined."""
    return f"CASE WHEN 10 * count(*) FILTER ({v} IS NULL) <= count(*) THEN quantile_cont({v}, {p}) END"


LOW, HIGH = (1 - 0.95) / 2, (1 + 0.95) / 2


def _reps_sql(seed: str, n: int = REPS) -> str:
    return f"""sizes AS (SELECT eval_set_id, max(groups) AS groups FROM grp GROUP BY 1), dr AS (SELECT eval_set_id, groups, rep, unnest(range(0, groups)) AS i FROM (SELECT *, unnest(range(0, {n})) AS rep FROM sizes)),
    dw AS (SELECT eval_set_id, rep, {draw_sql(f"'{seed}'", "rep", "i")} % groups AS g FROM dr), reps AS (SELECT w.eval_set_id, w.rep, sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM dw w JOIN grp x ON x.eval_set_id = w.eval_set_id AND x.g = w.g GROUP BY 1, 2)"""


_STATS = {"recall": ("CAST(tp AS DOUBLE) / nullif(tp + fn, 0)", R.recall), "precision": ("CAST(tp AS DOUBLE) / nullif(tp + fp, 0)", R.precision), "flag_rate": ("CAST(tp + fp AS DOUBLE) / (tp + fp + tn + fn)", R.flag_rate)}


def _bootstrap(name: str):
    sql, statistic = _STATS[name]

    def build(s, d):
        x = R.interval(R.replicates(_groups(s, d), ["eval_set_id"], REPS, name, list(R.COUNTS)), ["eval_set_id"], statistic())
        return x.select("eval_set_id", F.round("ci_low", 9).alias("ci_low"), F.round("ci_high", 9).alias("ci_high"), "replicates", "undefined")

    return build, f"WITH {GROUPS}, {_reps_sql(name)}, v AS (SELECT eval_set_id, {sql} AS v FROM reps) SELECT eval_set_id, round({quantile_sql(LOW)}, 9) AS ci_low, round({quantile_sql(HIGH)}, 9) AS ci_high, count(v) AS replicates, count(*) FILTER (v IS NULL) AS undefined FROM v GROUP BY 1"


def _paired(s, d):
    """Difference in recall of two scores over the same draws: the score, and a hash-blurred one."""
    items = scored_items(s, d).withColumn("other", F.col("score") * (0.5 + uniform(F.lit("blur"), "item_id")))
    a = R.numbered_groups(items, ["eval_set_id"], "question_id", TAU, "score", "a_")
    b = R.numbered_groups(items, ["eval_set_id"], "question_id", TAU, "other", "b_").drop("g", "groups")
    both = a.join(b, ["eval_set_id", "question_id"])
    reps = R.replicates(both, ["eval_set_id"], PAIRED_REPS, "paired", ["a_tp", "a_fn", "b_tp", "b_fn"]).withColumn("v", R.recall("b_") - R.recall("a_"))
    x = reps.groupBy("eval_set_id").agg(F.percentile("v", F.lit(0.025)).alias("lo"), F.percentile("v", F.lit(0.975)).alias("hi"), F.stddev_samp("v").alias("se"))
    verdict = F.when((F.col("lo") > 0) | (F.col("hi") < 0), "difference").when((1.96 + 0.8416) * F.col("se") <= 0.1, "bounded").otherwise("UNDERPOWERED")
    return x.select("eval_set_id", F.round("lo", 9).alias("ci_low"), F.round("hi", 9).alias("ci_high"), F.round((1.96 + 0.8416) * F.col("se"), 6).alias("mde"), verdict.alias("verdict"))


_PAIRED = f"""WITH {SCORED}, it AS (SELECT *, score * (0.5::DOUBLE + {draw_sql("'blur'", "item_id")} / 4503599627370496::DOUBLE) AS other FROM scored),
  grp AS (SELECT eval_set_id, question_id, count(*) FILTER (score >= {TAU} AND label = 1) AS a_tp, count(*) FILTER (score < {TAU} AND label = 1) AS a_fn, count(*) FILTER (other >= {TAU} AND label = 1) AS b_tp, count(*) FILTER (other < {TAU} AND label = 1) AS b_fn,
   row_number() OVER (PARTITION BY eval_set_id ORDER BY question_id) - 1 AS g, count(*) OVER (PARTITION BY eval_set_id) AS groups FROM it GROUP BY 1, 2),
  sizes AS (SELECT eval_set_id, max(groups) AS groups FROM grp GROUP BY 1), dr AS (SELECT eval_set_id, groups, rep, unnest(range(0, groups)) AS i FROM (SELECT *, unnest(range(0, {PAIRED_REPS})) AS rep FROM sizes)),
  dw AS (SELECT eval_set_id, rep, {draw_sql("'paired'", "rep", "i")} % groups AS g FROM dr),
  v AS (SELECT w.eval_set_id, w.rep, CAST(sum(b_tp) AS DOUBLE) / nullif(sum(b_tp) + sum(b_fn), 0) - CAST(sum(a_tp) AS DOUBLE) / nullif(sum(a_tp) + sum(a_fn), 0) AS v FROM dw w JOIN grp x ON x.eval_set_id = w.eval_set_id AND x.g = w.g GROUP BY 1, 2),
  q AS (SELECT eval_set_id, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi, stddev_samp(v) AS se FROM v GROUP BY 1)
  SELECT eval_set_id, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high, round((1.96 + 0.8416)::DOUBLE * se, 6) AS mde, CASE WHEN lo > 0 OR hi < 0 THEN 'difference' WHEN (1.96 + 0.8416)::DOUBLE * se <= 0.1 THEN 'bounded' ELSE 'UNDERPOWERED' END AS verdict FROM q"""


def _seed_stability(s, d):
    """The interval of the flag rate under many seeds: how much its lower end moves, and how often it clears a bar."""
    groups = written(_groups(s, d), "groups")
    sizes = groups.groupBy("eval_set_id").agg(F.max("groups").alias("groups"))
    seeds = sizes.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1)))).repartition(64, "eval_set_id", "seed")
    each = seeds.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(REPS - 1)))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    drawn = each.select("eval_set_id", "seed", "rep", (draw(F.concat(F.lit("seed"), F.col("seed").cast("string")), "rep", "i") % F.col("groups")).alias("g"))
    flagged, n = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    rate = drawn.join(groups, ["eval_set_id", "g"]).groupBy("eval_set_id", "seed", "rep").agg(M.ratio(F.sum(flagged), F.sum(n)).alias("v"))
    out = R.interval(rate, ["eval_set_id", "seed"], F.col("v"))
    return out.groupBy("eval_set_id").agg(F.round(F.avg("ci_low"), 9).alias("mean_low"), F.round(F.stddev_pop("ci_low"), 9).alias("sd_low"), F.round(F.min("ci_low"), 9).alias("least_low"), F.round(F.max("ci_low"), 9).alias("most_low"), F.round(F.avg((F.col("ci_low") >= 0.1).cast("double")), 9).alias("share_clear"))


def _seed_stability_sql() -> str:
    return f"""WITH {GROUPS}, sizes AS (SELECT eval_set_id, max(groups) AS groups FROM grp GROUP BY 1),
    dr AS (SELECT eval_set_id, groups, seed, rep, unnest(range(0, groups)) AS i FROM (SELECT *, unnest(range(0, {REPS})) AS rep FROM (SELECT *, unnest(range(0, {SEEDS})) AS seed FROM sizes))),
    dw AS (SELECT eval_set_id, seed, rep, {draw_sql("'seed' || CAST(seed AS VARCHAR)", "rep", "i")} % groups AS g FROM dr),
    reps AS (SELECT w.eval_set_id, seed, w.rep, CAST(sum(tp + fp) AS DOUBLE) / sum(tp + fp + tn + fn) AS v FROM dw w JOIN grp x ON x.eval_set_id = w.eval_set_id AND x.g = w.g GROUP BY 1, 2, 3),
    u AS (SELECT eval_set_id, seed, quantile_cont(v, {LOW}) AS lo FROM reps GROUP BY 1, 2)
    SELECT eval_set_id, round(avg(lo), 9) AS mean_low, round(stddev_pop(lo), 9) AS sd_low, round(min(lo), 9) AS least_low, round(max(lo), 9) AS most_low, round(avg(CASE WHEN lo >= 0.1 THEN 1.0 ELSE 0.0 END), 9) AS share_clear FROM u GROUP BY 1"""


def _null_psi(s, d):
    """Monte-Carlo null of PSI: reference and live samples are both drawn from each envelope, at the sizes that are compared."""
    env = _envelope(s, d)
    w = Window.partitionBy("event_type").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cum = env.select("event_type", "bin", "p", "n_reference", F.sum("p").over(w).alias("upto"))
    lists = cum.groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "upto"))), lambda x: x["upto"]).alias("upto"), F.max("n_reference").alias("n_reference"))
    known = [(r["event_type"], list(r["upto"]), r["n_reference"]) for r in lists.collect()]
    named = s.createDataFrame([(k, x[0]) for k, x in enumerate(known)], "key int, event_type string")
    v = named.join(N.index_values([(x[1], WINDOW, x[2]) for x in known], NULLS, s), "key")
    return v.groupBy("event_type").agg(F.round(F.percentile("v", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("v", F.lit(0.95)), 6).alias("p95"), F.round(F.percentile("v", F.lit(0.99)), 6).alias("p99"), F.round(F.avg((F.col("v") >= 0.1).cast("double")), 6).alias("false_alarm"))


_NULL = f"""WITH {EDGES}, cum AS (SELECT event_type, b, n, sum(p) OVER (PARTITION BY event_type ORDER BY b ROWS UNBOUNDED PRECEDING) AS upto FROM envelope), l AS (SELECT event_type, list(upto ORDER BY b) AS upto, max(n) AS n FROM cum GROUP BY 1),
  sd AS (SELECT event_type, upto, 'ref' AS side, n FROM l UNION ALL SELECT event_type, upto, 'live', {WINDOW} FROM l),
  u AS (SELECT event_type, upto, side, n, rep, i, {draw_sql("side", "rep", "i")} / 4503599627370496::DOUBLE AS u FROM (SELECT *, unnest(range(0, n)) AS i FROM (SELECT *, unnest(range(0, {NULLS})) AS rep FROM sd))),
  k AS (SELECT event_type, rep, side, n, least(len(list_filter(upto, lambda c: c <= u)), len(upto) - 1) + 1 AS b, count(*) AS c FROM u GROUP BY 1, 2, 3, 4, 5),
  h AS (SELECT e.event_type, r.rep, e.b, greatest(coalesce(x.c / CAST(x.n AS DOUBLE), 0), 1e-6) AS live, greatest(coalesce(y.c / CAST(y.n AS DOUBLE), 0), 1e-6) AS ref FROM envelope e CROSS JOIN range({NULLS}) r(rep)
    LEFT JOIN k x ON x.event_type = e.event_type AND x.rep = r.rep AND x.b = e.b AND x.side = 'live' LEFT JOIN k y ON y.event_type = e.event_type AND y.rep = r.rep AND y.b = e.b AND y.side = 'ref'),
  v AS (SELECT event_type, rep, sum((live - ref) * ln(live / ref)) AS v FROM h GROUP BY 1, 2)
  SELECT event_type, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, round(avg(CASE WHEN v >= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS false_alarm FROM v GROUP BY 1"""


def _n_to_detect(s, d):
    tol = 0.25
    r = M.rates(M.confusion(scored_items(s, d), ["eval_set_id"], TAU)).where("flag_rate > 0")
    t = F.col("flag_rate")
    moved = t * (1 + tol)
    return r.select("eval_set_id", F.ceil(F.lit(1.96 * 1.96) * moved * (1 - moved) / F.pow(moved - t, F.lit(2.0))).cast("long").alias("n_needed"))


def _calibration(s, d):
    reps = R.replicates(_groups(s, d), ["eval_set_id"], REPS, "flag_rate", list(R.COUNTS))
    x = R.interval(reps, ["eval_set_id"], R.flag_rate())
    target, tol = 0.2, 0.25
    status = F.when(F.col("ci_low").isNull(), "UNKNOWN").when(F.lit(target).between(F.col("ci_low"), F.col("ci_high")), "CALIBRATED").otherwise("DRIFTED")
    return x.select("eval_set_id", status.alias("status"), ((F.col("ci_low") < target * (1 - tol)) | (F.col("ci_high") > target * (1 + tol))).alias("underpowered"))


def _closed_forms(s, d):
    """Null error of the rank statistic, one-sided upper bound at zero events, and the least clean sample."""
    c = M.confusion(scored_items(s, d), ["eval_set_id"], TAU).select("eval_set_id", (F.col("tp") + F.col("fn")).alias("p"), (F.col("fp") + F.col("tn")).alias("n"))
    return c.where("p > 0 and n > 0").select("eval_set_id", F.round(F.sqrt((F.col("p") + F.col("n") + 1) / (12.0 * F.col("p") * F.col("n"))), 9).alias("null_se"), F.round(1 - F.pow(F.lit(0.05), 1.0 / F.col("n")), 9).alias("zero_event_upper"), F.ceil(math.log(0.05) / F.log(1 - 1.0 / F.col("n"))).cast("long").alias("least_clean"))


def _widened(s, d):
    x = R.interval(R.replicates(_groups(s, d), ["eval_set_id"], REPS, "flag_rate", list(R.COUNTS)), ["eval_set_id"], R.flag_rate()).join(M.rates(M.confusion(scored_items(s, d), ["eval_set_id"], TAU)).select("eval_set_id", F.col("flag_rate").alias("v")), "eval_set_id")
    half = (F.col("ci_high") - F.col("ci_low")) / 2 * 1.5
    return x.select("eval_set_id", F.round(F.col("v") - half, 9).alias("symmetric_low"), F.round(F.col("v") + half, 9).alias("symmetric_high"), F.round(F.col("v") - 1.5 * (F.col("v") - F.col("ci_low")), 9).alias("each_low"), F.round(F.col("v") + 1.5 * (F.col("ci_high") - F.col("v")), 9).alias("each_high"))


_FLAG = f"{GROUPS}, {_reps_sql('flag_rate')}, v AS (SELECT eval_set_id, CAST(tp + fp AS DOUBLE) / (tp + fp + tn + fn) AS v FROM reps), q AS (SELECT eval_set_id, {quantile_sql(LOW)} AS lo, {quantile_sql(HIGH)} AS hi FROM v GROUP BY 1), pt AS (SELECT eval_set_id, CAST(sum(tp + fp) AS DOUBLE) / sum(tp + fp + tn + fn) AS x FROM grp GROUP BY 1)"

QUERIES = {
    "ag18_envelope": (lambda s, d: _envelope(s, d).select("event_type", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.round("p", 9).alias("p"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n_reference"), f"WITH {EDGES} SELECT event_type, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p, 9) AS p, round(mean, 6) AS mean, round(std, 6) AS std, n AS n_reference FROM envelope"),
    "sr01_psi": (lambda s, d: _psi(s, d).withColumn("psi", F.round("psi", 6)), f"WITH {PSI} SELECT event_type, n_live, n_reference, round(psi, 6) AS psi, bins_smoothed, bins_smoothed > 0 AND coalesce(sm / nullif(psi, 0), 0) > 0.5 AS driven_by_smoothing FROM psi"),
    "sr02_envelope_state": (lambda s, d: _psi(s, d).select("event_type", D.state(F.col("psi")).alias("state")), f"WITH {PSI} SELECT event_type, CASE WHEN isnan(psi) THEN 'SIGNIFICANT' WHEN psi < 0.1 THEN 'INSIDE' WHEN psi < 0.25 THEN 'MODERATE' ELSE 'SIGNIFICANT' END AS state FROM psi"),
    "sr04_ladder": (
        _ladder,
        f"""WITH {PSI}, st AS (SELECT event_type, CASE WHEN psi < 0.1 THEN 'INSIDE' WHEN psi < 0.25 THEN 'MODERATE' ELSE 'SIGNIFICANT' END AS state FROM psi), x AS (SELECT *, unnest(['VALID', 'STALE', 'REVOKED', 'REFUSED']) AS before FROM st),
        y AS (SELECT *, CASE WHEN before = 'REFUSED' THEN before WHEN state = 'INSIDE' THEN 'VALID' WHEN state = 'MODERATE' THEN 'STALE' ELSE 'REVOKED' END AS after FROM x) SELECT *, before <> after AS changed, CASE WHEN state = 'MODERATE' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS widen FROM y""",
    ),
    "jn11_value_bins": (lambda s, d: traffic(s, d).join(D.edges(traffic(s, d).where("not live"), KEY, "value"), KEY).select("event_id", D.bin_of(F.col("value"), F.col("edges")).cast("long").alias("bin")), f"WITH {EDGES.replace('SELECT t.event_type, live', 'SELECT t.event_id, t.event_type, live')} SELECT event_id, b - 1 AS bin FROM binned"),
    "wn03_window_rate": (_window_rate, f"WITH {TRAFFIC} SELECT event_id, count(*) OVER w AS n, round(avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER w, 9) AS error_rate FROM traffic WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 19 PRECEDING)"),
    "wn04_sliding_psi": (_sliding, _sliding_sql()),
    "wn09_eprocess": (_eprocess, _eprocess_sql()),
    "wn10_eprocess_state": (_resume, f"WITH {TRAFFIC}, x AS (SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS k, count(*) FILTER (live) AS n_live FROM traffic GROUP BY 1) SELECT *, round(k * {math.log1p(D.bets(0.5)[-1] * 0.5)!r}::DOUBLE + (n - k) * {math.log1p(-D.bets(0.5)[-1] * 0.5)!r}::DOUBLE, 6) AS log_wealth_last_bet FROM x"),
    "st01_bootstrap_recall": _bootstrap("recall"),
    "st01_bootstrap_precision": _bootstrap("precision"),
    "st18_cluster_flag_rate": _bootstrap("flag_rate"),
    "st07_seed_stability": (_seed_stability, _seed_stability_sql()),
    "st08_paired_difference": (_paired, _PAIRED),
    "st12_n_to_detect": (_n_to_detect, f"WITH {GROUPS}, pt AS (SELECT eval_set_id, CAST(sum(tp + fp) AS DOUBLE) / sum(tp + fp + tn + fn) AS t FROM grp GROUP BY 1), m AS (SELECT *, t * 1.25::DOUBLE AS mv FROM pt WHERE t > 0) SELECT eval_set_id, CAST(ceil({1.96 * 1.96!r}::DOUBLE * mv * (1 - mv) / pow(mv - t, 2)) AS BIGINT) AS n_needed FROM m"),
    "st13_calibration": (_calibration, f"WITH {_FLAG} SELECT eval_set_id, CASE WHEN lo IS NULL THEN 'UNKNOWN' WHEN 0.2 BETWEEN lo AND hi THEN 'CALIBRATED' ELSE 'DRIFTED' END AS status, lo < 0.15 OR hi > 0.25 AS underpowered FROM q"),
    "st14_null_psi": (_null_psi, _NULL),
    "st16_closed_forms": (_closed_forms, f"WITH {SCORED}, c AS (SELECT eval_set_id, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM scored GROUP BY 1) SELECT eval_set_id, round(sqrt((p + n + 1) / (12::DOUBLE * p * n)), 9) AS null_se, round(1 - pow(0.05::DOUBLE, 1::DOUBLE / n), 9) AS zero_event_upper, CAST(ceil({math.log(0.05)!r}::DOUBLE / ln(1 - 1::DOUBLE / n)) AS BIGINT) AS least_clean FROM c WHERE p > 0 AND n > 0"),
    "st19_widened_intervals": (_widened, f"WITH {_FLAG} SELECT q.eval_set_id, round(x - (hi - lo) / 2 * 1.5::DOUBLE, 9) AS symmetric_low, round(x + (hi - lo) / 2 * 1.5::DOUBLE, 9) AS symmetric_high, round(x - 1.5::DOUBLE * (x - lo), 9) AS each_low, round(x + 1.5::DOUBLE * (hi - x), 9) AS each_high FROM q JOIN pt ON pt.eval_set_id = q.eval_set_id"),
}
