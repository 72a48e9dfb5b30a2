"""Compositions of the operators: comparisons, selection-aware bounds, controls, reports, and derived flags."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from warrantlake.functions import text as T
from warrantlake.functions.rng import draw, draw_sql, uniform
from warrantlake.operators import drift as D
from warrantlake.operators import metrics as M
from warrantlake.operators import probe as P
from warrantlake.operators import ranges as G
from warrantlake.operators import resample as R
from warrantlake.operators import splits as S
from warrantlake.operators import thresholds as H
from warrantlake.plans.q_drift import GROUPS, PSI, REPS, TAU, _groups, _psi, _reps_sql, quantile_sql
from warrantlake.plans.q_metrics import BUDGET, KEYS, RATES
from warrantlake.plans.q_text import _ABSTAINS
from warrantlake.sources.views import SCORED, probe_items, scored_items, table

_HALVES = f"""{SCORED}, va AS (SELECT * FROM scored WHERE item_id % 2 = 0), te AS (SELECT * FROM scored WHERE item_id % 2 = 1)"""
REPEATS, IQR_SAMPLES = 1000, 20_000


def _item_draws(items, seed: str, *values: str):
    """eval_set_id, rep and values: for each replicate as many draws of the set's items, numbered by id, as there are."""
    n = G.numbered(items, ["eval_set_id"], F.col("item_id"), ["item_id"], "g").withColumn("g", F.col("g") - 1)
    sizes = items.groupBy("eval_set_id").agg(F.count("*").alias("groups"))
    return R.drawn_items(n.join(sizes, "eval_set_id"), ["eval_set_id"], REPEATS, seed, list(values))


def _selection_aware(s, d):
    """Recall on resampled test items at a threshold chosen again on resampled validation items."""
    items = scored_items(s, d)
    va, te = _item_draws(items.where("item_id % 2 = 0"), "sel-v", "score"), _item_draws(items.where("item_id % 2 = 1"), "sel-t", "score", "label")
    grain = va.groupBy("eval_set_id", "rep", "score").agg(F.count("*").alias("c"))
    down, whole = Window.partitionBy("eval_set_id", "rep").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("eval_set_id", "rep")
    chosen = grain.withColumns({"upto": F.sum("c").over(down), "n": F.sum("c").over(whole)}).groupBy("eval_set_id", "rep").agg(F.min(F.when(F.col("upto") / F.col("n") <= BUDGET, F.col("score"))).alias("threshold"))
    pinned = H.within_budget(items.where("item_id % 2 = 0"), KEYS, BUDGET).withColumnRenamed("threshold", "pinned")
    t = te.where("label = 1").groupBy("eval_set_id", "rep", "score").agg(F.count("*").alias("times")).join(chosen, ["eval_set_id", "rep"]).join(pinned, "eval_set_id")
    hit = lambda c: F.sum(F.when(F.col("score") >= F.col(c), F.col("times")).otherwise(0)) / F.sum("times")
    v = t.groupBy("eval_set_id", "rep").agg(hit("threshold").alias("a"), hit("pinned").alias("c"))
    q = lambda c, p: F.percentile(c, F.lit(p))
    x = v.groupBy("eval_set_id").agg(q("a", 0.025).alias("al"), q("a", 0.975).alias("ah"), q("c", 0.025).alias("cl"), q("c", 0.975).alias("ch"))
    return x.select("eval_set_id", F.round("al", 9).alias("aware_low"), F.round("ah", 9).alias("aware_high"), F.round("cl", 9).alias("pinned_low"), F.round("ch", 9).alias("pinned_high"), F.round(F.try_divide(F.col("ah") - F.col("al"), F.col("ch") - F.col("cl")), 6).alias("widening"))


def _drawn_sql(name: str, source: str, seed: str) -> str:
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY eval_set_id ORDER BY item_id) - 1 AS g, count(*) OVER (PARTITION BY eval_set_id) AS n FROM {source}),
    {name}_d AS (SELECT eval_set_id, rep, {draw_sql(f"'{seed}'", "rep", "i")} % n AS g FROM (SELECT eval_set_id, n, rep, unnest(range(0, n)) AS i FROM (SELECT eval_set_id, max(n) AS n, unnest(range(0, {REPEATS})) AS rep FROM {name}_n GROUP BY 1))),
    {name} AS (SELECT x.rep, y.* FROM {name}_d x JOIN {name}_n y ON y.eval_set_id = x.eval_set_id AND y.g = x.g)"""


_SELECTION = f"""WITH {_HALVES}, {_drawn_sql("bv", "va", "sel-v")}, {_drawn_sql("bt", "te", "sel-t")},
  gr AS (SELECT eval_set_id, rep, score, count(*) AS c FROM bv GROUP BY 1, 2, 3), cu AS (SELECT *, sum(c) OVER (PARTITION BY eval_set_id, rep ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS upto, sum(c) OVER (PARTITION BY eval_set_id, rep) AS n FROM gr),
  ch AS (SELECT eval_set_id, rep, min(score) FILTER (CAST(upto AS DOUBLE) / n <= {BUDGET}) AS threshold FROM cu GROUP BY 1, 2),
  pg AS (SELECT eval_set_id, score, sum(count(*)) OVER (PARTITION BY eval_set_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS upto, sum(count(*)) OVER (PARTITION BY eval_set_id) AS n FROM va GROUP BY 1, 2),
  pin AS (SELECT eval_set_id, min(score) FILTER (CAST(upto AS DOUBLE) / n <= {BUDGET}) AS pinned FROM pg GROUP BY 1),
  v AS (SELECT t.eval_set_id, t.rep, CAST(count(*) FILTER (score >= threshold) AS DOUBLE) / count(*) AS a, CAST(count(*) FILTER (score >= pinned) AS DOUBLE) / count(*) AS c FROM bt t JOIN ch ON ch.eval_set_id = t.eval_set_id AND ch.rep = t.rep JOIN pin ON pin.eval_set_id = t.eval_set_id WHERE label = 1 GROUP BY 1, 2),
  q AS (SELECT eval_set_id, quantile_cont(a, 0.025) AS al, quantile_cont(a, 0.975) AS ah, quantile_cont(c, 0.025) AS cl, quantile_cont(c, 0.975) AS ch FROM v GROUP BY 1)
  SELECT eval_set_id, round(al, 9) AS aware_low, round(ah, 9) AS aware_high, round(cl, 9) AS pinned_low, round(ch, 9) AS pinned_high, round((ah - al) / nullif(ch - cl, 0), 6) AS widening FROM q"""


def _two_regimes(s, d):
    """Two scores on the same items: recall at one pinned threshold, and at each score's own within the budget."""
    items = scored_items(s, d)
    other = items.withColumn("score", F.col("score") * (0.5 + uniform(F.lit("blur"), "item_id")))
    pinned = H.within_budget(items, KEYS, BUDGET).withColumnRenamed("threshold", "t")
    own = H.within_budget(other, KEYS, BUDGET).withColumnRenamed("threshold", "t")
    recall = lambda x, t: x.where("label = 1").join(t, KEYS).groupBy(*KEYS).agg(F.avg((F.col("score") >= F.col("t")).cast("double")).alias("r"))
    a, b, c = recall(items, pinned).withColumnRenamed("r", "a"), recall(other, pinned).withColumnRenamed("r", "b"), recall(other, own).withColumnRenamed("r", "c")
    return a.join(b, KEYS).join(c, KEYS).select(*KEYS, F.round(F.col("b") - F.col("a"), 9).alias("pinned_difference"), F.round(F.col("c") - F.col("a"), 9).alias("own_difference"))


_REGIMES = f"""WITH {SCORED}, it AS (SELECT *, score * (0.5::DOUBLE + {draw_sql("'blur'", "item_id")} / 4503599627370496::DOUBLE) AS other FROM scored),
  f AS (SELECT eval_set_id, score, sum(count(*)) OVER (PARTITION BY eval_set_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS upto, sum(count(*)) OVER (PARTITION BY eval_set_id) AS n FROM it GROUP BY 1, 2),
  g AS (SELECT eval_set_id, other, sum(count(*)) OVER (PARTITION BY eval_set_id ORDER BY other DESC ROWS UNBOUNDED PRECEDING) AS upto, sum(count(*)) OVER (PARTITION BY eval_set_id) AS n FROM it GROUP BY 1, 2),
  p AS (SELECT eval_set_id, min(score) FILTER (CAST(upto AS DOUBLE) / n <= {BUDGET}) AS t FROM f GROUP BY 1), o AS (SELECT eval_set_id, min(other) FILTER (CAST(upto AS DOUBLE) / n <= {BUDGET}) AS u FROM g GROUP BY 1),
  r AS (SELECT it.eval_set_id, avg(CASE WHEN score >= t THEN 1::DOUBLE ELSE 0 END) AS a, avg(CASE WHEN other >= t THEN 1::DOUBLE ELSE 0 END) AS b, avg(CASE WHEN other >= u THEN 1::DOUBLE ELSE 0 END) AS c FROM it JOIN p ON p.eval_set_id = it.eval_set_id JOIN o ON o.eval_set_id = it.eval_set_id WHERE label = 1 GROUP BY 1)
  SELECT eval_set_id, round(b - a, 9) AS pinned_difference, round(c - a, 9) AS own_difference FROM r"""


def _null_iqr(s, d):
    """Ratio of interquartile ranges of small samples of a set's scores to that of the whole set, by hash samples of 12."""
    items = scored_items(s, d)
    whole = items.groupBy("eval_set_id").agg((F.percentile("score", F.lit(0.75)) - F.percentile("score", F.lit(0.25))).alias("whole"))
    n = G.numbered(items, ["eval_set_id"], F.col("item_id"), ["item_id"], "g").withColumn("g", F.col("g") - 1)
    sizes = items.groupBy("eval_set_id").agg(F.count("*").alias("n"))
    draws = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(IQR_SAMPLES - 1)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("g", draw(F.lit("iqr"), "rep", "i") % F.col("n"))
    v = draws.join(n, ["eval_set_id", "g"]).groupBy("eval_set_id", "rep").agg((F.percentile("score", F.lit(0.75)) - F.percentile("score", F.lit(0.25))).alias("v")).join(whole, "eval_set_id").withColumn("ratio", F.try_divide("v", "whole"))
    return v.groupBy("eval_set_id").agg(F.round(F.percentile("ratio", F.lit(0.05)), 6).alias("p05"), F.round(F.percentile("ratio", F.lit(0.5)), 6).alias("p50"), F.round(F.avg((F.col("ratio") < 0.439).cast("double")), 6).alias("false_alarm"))


_IQR = f"""WITH {SCORED}, w AS (SELECT eval_set_id, count(*) AS n, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS whole FROM scored GROUP BY 1), nn AS (SELECT *, row_number() OVER (PARTITION BY eval_set_id ORDER BY item_id) - 1 AS g FROM scored),
  dr AS (SELECT eval_set_id, rep, {draw_sql("'iqr'", "rep", "i")} % n AS g, whole FROM w, range({IQR_SAMPLES}) a(rep), range(12) b(i)),
  v AS (SELECT dr.eval_set_id, rep, (quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) / nullif(max(whole), 0) AS ratio FROM dr JOIN nn ON nn.eval_set_id = dr.eval_set_id AND nn.g = dr.g GROUP BY 1, 2)
  SELECT eval_set_id, round(quantile_cont(ratio, 0.05), 6) AS p05, round(quantile_cont(ratio, 0.5), 6) AS p50, round(avg(CASE WHEN ratio < 0.439 THEN 1::DOUBLE ELSE 0 END), 6) AS false_alarm FROM v GROUP BY 1"""


def _null_summary(s, d):
    """A null statistic over repeats (areas by source): mean in band, its error, and the repeats that it would need."""
    areas = M.auroc(scored_items(s, d).withColumn("source", F.element_at(F.split("question_id", r"\|"), 2)), ["eval_set_id", "source"]).where("auroc is not null")
    x = areas.groupBy("eval_set_id").agg(F.count("*").alias("repeats"), F.avg("auroc").alias("m"), F.stddev_samp("auroc").alias("sd"))
    half = 0.05
    needed = F.ceil(F.pow(2 * F.col("sd") / half, F.lit(2.0))).cast("long")
    se = F.col("sd") / F.sqrt("repeats")
    verdict = F.when((F.abs(F.col("m") - 0.5) <= half) & (se <= half / 2), "pass").when(se > half / 2, "UNDERPOWERED").otherwise("fail")
    return x.select("eval_set_id", "repeats", F.round("m", 9).alias("mean"), needed.alias("needed"), verdict.alias("verdict"))


_NULL_SUMMARY = f"""WITH {SCORED}, k AS (SELECT *, string_split(question_id, '|')[2] AS source FROM scored), r AS (SELECT eval_set_id, source, label AS y, rank() OVER (PARTITION BY eval_set_id, source ORDER BY score) + (count(*) OVER (PARTITION BY eval_set_id, source, score) - 1) / 2::DOUBLE AS r FROM k),
  a AS (SELECT eval_set_id, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2::DOUBLE) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS v FROM r GROUP BY eval_set_id, source),
  x AS (SELECT eval_set_id, count(v) AS repeats, avg(v) AS m, stddev_samp(v) AS sd FROM a WHERE v IS NOT NULL GROUP BY 1)
  SELECT eval_set_id, repeats, round(m, 9) AS mean, CAST(ceil(pow(2 * sd / 0.05::DOUBLE, 2)) AS BIGINT) AS needed, CASE WHEN abs(m - 0.5) <= 0.05 AND sd / sqrt(repeats) <= 0.025 THEN 'pass' WHEN sd / sqrt(repeats) > 0.025 THEN 'UNDERPOWERED' ELSE 'fail' END AS verdict FROM x"""


def _overlap_free(s, d):
    """Greedy choice of shipment intervals of an order: dearest first, none that overlaps a kept one."""
    li = table(s, d, "lineitem").select("l_orderkey", F.struct((-F.round("l_extendedprice", 2)).alias("p"), F.unix_date(F.col("l_shipdate").cast("date")).alias("a"), F.col("l_linenumber").alias("l"), (F.unix_date(F.col("l_shipdate").cast("date")) + F.col("l_quantity").cast("int")).alias("b")).alias("x"))
    lists = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    empty = F.array().cast("array<struct<p:double,a:int,l:int,b:int>>")
    kept = F.aggregate("xs", empty, lambda done, x: F.when(F.exists(done, lambda k: (x["a"] < k["b"]) & (k["a"] < x["b"])), done).otherwise(F.concat(done, F.array(x))))
    return lists.select("l_orderkey", F.size(kept).cast("long").alias("kept"), F.size("xs").cast("long").alias("of"))


def _controls(s, d):
    """Permuted labels and Gaussian features against the true ones: held-out areas of three probes."""
    x = probe_items(s, d)
    train, held = x.where("vec_id % 3 <> 0"), x.where("vec_id % 3 = 0")
    noise = lambda df: df.withColumn("vec", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.sqrt(-2 * F.log(1 - uniform(F.lit("a"), F.col("vec_id"), i))) * F.cos(2 * math.pi * uniform(F.lit("b"), F.col("vec_id"), i))))
    parts = [("true", train, held), ("shuffled", P.shuffled(train, "vec_id", "c"), held), ("noise", noise(train), noise(held))]
    out = None
    for name, a, b in parts:
        area = M.auroc(P.score(P.fit(a, 1.0), b).withColumn("control", F.lit(name)), ["control"]).select("control", F.round("auroc", 3).alias("auroc"))
        out = area if out is None else out.unionByName(area)
    return out


def _padding(s, d):
    """Left-padded vectors (scaled a little) stand by their references, right-padded ones (shifted by a place) don't."""
    v = probe_items(s, d).select("vec_id", "vec", F.transform("vec", lambda x: x * 1.05).alias("left"), F.concat(F.slice("vec", F.lit(2), F.lit(63)), F.slice("vec", F.lit(1), F.lit(1))).alias("right"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    size = F.sqrt(dot("vec", "vec"))
    cosine = lambda c: dot("vec", c) / F.greatest(size * F.sqrt(dot(c, c)), F.lit(1e-12))
    apart = lambda c: F.sqrt(F.aggregate(F.zip_with("vec", c, lambda x, y: x - y), F.lit(0.0), lambda t, x: t + x * x)) / F.greatest(size, F.lit(1e-12))
    x = v.select("vec_id", cosine("left").alias("lc"), apart("left").alias("ld"), cosine("right").alias("rc"), apart("right").alias("rd"))
    same = lambda c, e: (F.col(c) >= 0.999) & (F.col(e) <= 0.1)
    return x.select("vec_id", F.round("lc", 6).alias("left_cosine"), F.round("ld", 6).alias("left_distance"), F.round("rc", 6).alias("right_cosine"), F.round("rd", 6).alias("right_distance"), same("lc", "ld").alias("left_accepted"), (~same("rc", "rd")).alias("right_rejected"))


def _psi_flags(s, d):
    p = _psi(s, d).withColumn("state", D.state(F.col("psi")))
    return p.select("event_type", (F.col("state") == "SIGNIFICANT").alias("revokes"), (F.col("state") == "MODERATE").alias("widens"), (F.col("state") == "INSIDE").alias("is_inside"), F.sha2(F.concat_ws("|", F.lit("0.1"), F.lit("0.25"), F.lit("200"), "state"), 256).alias("policy_hash"))


def _requests(s, d):
    """Spans of numbers in turns: first match, its length, whether anything was found."""
    c = table(s, d, "conversations")
    first = F.regexp_extract("text", "[0-9]+", 0)
    return c.select("conv_id", "turn", first.alias("span"), F.length(first).cast("long").alias("length"), (first != "").alias("found"))


QUERIES = {
    "st10_two_regimes": (_two_regimes, _REGIMES),
    "st11_selection_aware": (_selection_aware, _SELECTION),
    "st15_null_iqr_ratio": (_null_iqr, _IQR),
    "st17_area_summary": (_null_summary, _NULL_SUMMARY),
    "jn09_overlap_free": (
        _overlap_free,
        """WITH x AS (SELECT l_orderkey, [-round(l_extendedprice, 2), CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE), CAST(l_linenumber AS DOUBLE), date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + trunc(l_quantity)] AS x FROM lineitem),
        g AS (SELECT l_orderkey, list_sort(list(x)) AS xs FROM x GROUP BY 1), k AS (SELECT l_orderkey, len(xs) AS n, list_reduce(list_transform(xs, lambda x: [x]), lambda done, x: CASE WHEN len(list_filter(done, lambda k: x[1][2] < k[4] AND k[2] < x[1][4])) > 0 THEN done ELSE list_concat(done, x) END) AS kept FROM g)
        SELECT l_orderkey, len(kept) AS kept, n AS "of" FROM k""",
    ),
    "ud06_controls": (_controls, None),
    "df08_verdict_flags": (_psi_flags, f"WITH {PSI}, st AS (SELECT event_type, CASE WHEN psi < 0.1 THEN 'INSIDE' WHEN psi < 0.25 THEN 'MODERATE' ELSE 'SIGNIFICANT' END AS state FROM psi) SELECT event_type, state = 'SIGNIFICANT' AS revokes, state = 'MODERATE' AS widens, state = 'INSIDE' AS is_inside, sha256('0.1|0.25|200|' || state) AS policy_hash FROM st"),
    "df14_number_spans": (_requests, "SELECT conv_id, turn, regexp_extract(text, '[0-9]+') AS span, length(regexp_extract(text, '[0-9]+')) AS length, regexp_extract(text, '[0-9]+') <> '' AS found FROM conversations"),
    "df04_interval_ratio": (
        lambda s, d: R.interval(R.replicates(_groups(s, d), ["eval_set_id"], REPS, "recall", list(R.COUNTS)), ["eval_set_id"], R.recall()).select("eval_set_id", F.round(F.try_divide(F.col("ci_high") - F.col("ci_low"), F.col("ci_high") + F.col("ci_low")), 6).alias("relative_width")),
        f"WITH {GROUPS}, {_reps_sql('recall')}, v AS (SELECT eval_set_id, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS v FROM reps), q AS (SELECT eval_set_id, {quantile_sql((1 - 0.95) / 2)} AS lo, {quantile_sql((1 + 0.95) / 2)} AS hi FROM v GROUP BY 1) SELECT eval_set_id, round((hi - lo) / nullif(hi + lo, 0), 6) AS relative_width FROM q",
    ),
    "pf12_metrics_long": (
        lambda s, d: M.rates(M.confusion(scored_items(s, d), KEYS, TAU)).select(*KEYS, F.explode(F.filter(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in ("recall", "precision", "fpr", "flag_rate")]), lambda x: x["value"].isNotNull())).alias("m")).select(*KEYS, "m.metric", "m.value"),
        f"WITH {RATES}, l AS (SELECT eval_set_id, 'recall' AS metric, recall AS value FROM rates UNION ALL SELECT eval_set_id, 'precision', precision FROM rates UNION ALL SELECT eval_set_id, 'fpr', fpr FROM rates UNION ALL SELECT eval_set_id, 'flag_rate', flag_rate FROM rates) SELECT * FROM l WHERE value IS NOT NULL",
    ),
    "pl06_matched_budget": (
        lambda s, d: scored_items(s, d).join(H.within_budget(scored_items(s, d), KEYS, BUDGET), KEYS).groupBy(*KEYS).agg(F.count_if((F.col("score") >= F.col("threshold")) & (F.col("label") == 1)).alias("tp"), F.count_if(F.col("score") >= F.col("threshold")).alias("flagged"), F.count_if(F.col("label") == 1).alias("positives"), F.count("*").alias("n")).select(*KEYS, "tp", "flagged", F.round(F.try_divide(F.col("tp") * F.col("n").cast("double"), (F.col("positives") * F.col("flagged")).cast("double")), 9).alias("lift")),
        f"""WITH {SCORED}, f AS (SELECT eval_set_id, score, sum(count(*)) OVER (PARTITION BY eval_set_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS upto, sum(count(*)) OVER (PARTITION BY eval_set_id) AS n FROM scored GROUP BY 1, 2), p AS (SELECT eval_set_id, min(score) FILTER (CAST(upto AS DOUBLE) / n <= {BUDGET}) AS t FROM f GROUP BY 1),
        c AS (SELECT s.eval_set_id, count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t) AS flagged, count(*) FILTER (label = 1) AS positives, count(*) AS n FROM scored s JOIN p ON p.eval_set_id = s.eval_set_id GROUP BY 1) SELECT eval_set_id, tp, flagged, round(tp * CAST(n AS DOUBLE) / nullif(positives * flagged, 0), 9) AS lift FROM c""",
    ),
    "pl11_feasibility": (
        lambda s, d: M.rates(M.confusion(scored_items(s, d), KEYS, TAU)).select(*KEYS, "base_rate", "recall", F.explode(F.array(*[F.lit(m) for m in (0.02, 0.05, 0.1)])).alias("margin")).select(*KEYS, "margin", F.ceil(F.lit(H.Z95 * H.Z95) * F.col("recall") * (1 - F.col("recall")) / (F.col("margin") * F.col("margin"))).cast("long").alias("positives"), F.ceil(F.lit(H.Z95 * H.Z95) * F.col("recall") * (1 - F.col("recall")) / (F.col("margin") * F.col("margin")) / F.col("base_rate")).cast("long").alias("items")),
        f"WITH {RATES}, m AS (SELECT *, unnest([0.02, 0.05, 0.1]::DOUBLE[]) AS margin FROM rates), z AS (SELECT *, {H.Z95 * H.Z95!r}::DOUBLE * recall * (1 - recall) / (margin * margin) AS k FROM m) SELECT eval_set_id, margin, CAST(ceil(k) AS BIGINT) AS positives, CAST(ceil(k / base_rate) AS BIGINT) AS items FROM z",
    ),
    "so06_resplit": (
        lambda s, d: S.by_group(table(s, d, "orders").select("o_custkey", (F.col("o_custkey") % 5).alias("stratum")).distinct(), "o_custkey", "re", (0.5, 0.25, 0.25), ["stratum"]).groupBy("stratum", "split").agg(F.count("*").alias("groups")),
        f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, o_custkey) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM (SELECT DISTINCT o_custkey, o_custkey % 5 AS stratum, {draw_sql("'re'", "o_custkey")} AS h FROM orders))
        SELECT stratum, CASE WHEN r <= floor(n * 0.5::DOUBLE + 0.5) THEN 'train' WHEN r <= floor(n * 0.75::DOUBLE + 0.5) THEN 'validation' ELSE 'test' END AS split, count(*) AS groups FROM r GROUP BY 1, 2""",
    ),
    "so08_prepare": (
        lambda s, d: S.first_of(table(s, d, "documents").select(T.question(F.col("text")).alias("q"), "doc_id", "lang").where(F.length("q") > 0), "q", "doc_id").groupBy("lang").agg(F.count("*").alias("kept"), F.sum("copies").alias("rows"), F.max("copies").alias("most_copies")),
        r"""WITH n AS (SELECT trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_]', ' ', 'g'), ' +', ' ', 'g')) AS q, doc_id, lang FROM documents), f AS (SELECT arg_min(lang, doc_id) AS lang, count(*) AS copies FROM n WHERE length(q) > 0 GROUP BY q)
        SELECT lang, count(*) AS kept, CAST(sum(copies) AS BIGINT) AS rows, max(copies) AS most_copies FROM f GROUP BY 1""",
    ),
    "sf15_utc_parts": (lambda s, d: table(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("iso"), F.unix_timestamp("ts").alias("epoch")), "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS epoch FROM events"),
    "sf18_masked_mean": (
        lambda s, d: probe_items(s, d).select("vec_id", F.round(F.aggregate(F.filter("vec", lambda x, i: i % 3 == 0), F.lit(0.0), lambda a, x: a + x) / 22, 6).alias("masked_mean")),
        "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, round(list_sum(list_filter(v, lambda x, i: (i - 1) % 3 = 0)) / 22, 6) AS masked_mean FROM v",
    ),
    "jn15_length_order": (lambda s, d: G.numbered(table(s, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n")), ["role"], F.col("n"), ["n", "conv_id", "turn"], "place").select("conv_id", "turn", (F.col("place") - 1).alias("place")), "SELECT conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY length(text), conv_id, turn) - 1 AS place FROM conversations"),
    "ud05_padding_fault": (
        _padding,
        """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT vec_id, v, list_transform(v, lambda x: x * 1.05::DOUBLE) AS l, list_concat(v[2:64], v[1:1]) AS r FROM v),
        c AS (SELECT vec_id, list_dot_product(v, v) AS n, list_dot_product(v, l) / greatest(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(l, l)), 1e-12) AS lc, list_dot_product(v, r) / greatest(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(r, r)), 1e-12) AS rc,
          sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(v[i] - l[i], 2)))) / greatest(sqrt(list_dot_product(v, v)), 1e-12) AS ld, sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(v[i] - r[i], 2)))) / greatest(sqrt(list_dot_product(v, v)), 1e-12) AS rd FROM p)
        SELECT vec_id, round(lc, 6) AS left_cosine, round(ld, 6) AS left_distance, round(rc, 6) AS right_cosine, round(rd, 6) AS right_distance, lc >= 0.999 AND ld <= 0.1 AS left_accepted, NOT (rc >= 0.999 AND rd <= 0.1) AS right_rejected FROM c""",
    ),
    "ud19_labelled_frame": (
        lambda s, d: table(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", T.answer(F.col("text")).contains("the").alias("correct"), T.abstains(F.col("text")).alias("abstained")).withColumn("label", (~F.col("correct")).cast("int")),
        rf"""WITH n AS (SELECT conv_id, turn, ' ' || regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{{-~]', ' ', 'g'), '[ \t\n\r]+', '  ', 'g') || ' ' AS b, regexp_replace(lower(replace(text, '’', '''')), '\s+', ' ', 'g') AS t FROM conversations WHERE role = 'assistant'),
        m AS (SELECT *, contains(trim(regexp_replace(regexp_replace(b, ' (a|an|the) ', ' ', 'g'), ' +', ' ', 'g')), 'the') AS correct FROM n)
        SELECT conv_id, turn, correct, {_ABSTAINS} AS abstained, CASE WHEN correct THEN 0 ELSE 1 END AS label FROM m""",
    ),
}
