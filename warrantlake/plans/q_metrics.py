"""Metric and threshold queries over scored items, by evaluation set."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from warrantlake.operators import metrics as M
from warrantlake.operators import ranges as G
from warrantlake.operators import resample as R
from warrantlake.operators import thresholds as T
from warrantlake.sources.views import SCORED, scored_items

TAU, BUDGET, KEYS = 0.1, 0.2, ["eval_set_id"]

COUNTS = f"""{SCORED}, counts AS (
  SELECT eval_set_id, count(*) FILTER (score >= {TAU} AND label = 1) AS tp, count(*) FILTER (score >= {TAU} AND label = 0) AS fp,
         count(*) FILTER (score < {TAU} AND label = 0) AS tn, count(*) FILTER (score < {TAU} AND label = 1) AS fn
  FROM scored GROUP BY eval_set_id)"""
RATES = f"""{COUNTS}, rates AS (
  SELECT *, tp + fp + tn + fn AS n, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall,
         coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision, CAST(tp + fp AS DOUBLE) / (tp + fp + tn + fn) AS flag_rate,
         CAST(fp AS DOUBLE) / nullif(fp + tn, 0) AS fpr, CAST(tp + fn AS DOUBLE) / (tp + fp + tn + fn) AS base_rate FROM counts)"""
GRAIN = f"""{SCORED}, grain AS (
  SELECT eval_set_id, score, sum(label) AS pos, sum(1 - label) AS neg, count(*) AS c FROM scored GROUP BY 1, 2),
cum AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(c) OVER d AS upto, sum(pos) OVER w AS p, sum(neg) OVER w AS q, sum(c) OVER w AS n
  FROM grain WINDOW d AS (PARTITION BY eval_set_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY eval_set_id))"""
CURVE = f"""{GRAIN}, curve AS (
  SELECT eval_set_id, CAST('inf' AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr FROM (SELECT DISTINCT eval_set_id FROM grain)
  UNION ALL SELECT eval_set_id, score, CAST(fp AS DOUBLE) / nullif(q, 0), CAST(tp AS DOUBLE) / nullif(p, 0) FROM cum)"""


def _items(s, d):
    return scored_items(s, d)


def _rates(s, d):
    return M.rates(M.confusion(_items(s, d), KEYS, TAU))


def _curve(s, d):
    return M.roc(_items(s, d), KEYS)


def _auroc_sql(label: str = "label") -> str:
    return f"""ranked AS (SELECT eval_set_id, {label} AS y, rank() OVER (PARTITION BY eval_set_id ORDER BY score)
         + (count(*) OVER (PARTITION BY eval_set_id, score) - 1) / CAST(2 AS DOUBLE) AS r FROM scored),
area AS (SELECT eval_set_id, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / CAST(2 AS DOUBLE))
         / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS auroc FROM ranked GROUP BY 1)"""


def _metric_row(s, d):
    items = _items(s, d)
    r = M.rates(M.confusion(items, KEYS, TAU), zero_precision=False).join(M.auroc(items, KEYS), KEYS, "left")
    return r.select(
        *KEYS, "n", F.round("auroc", 9).alias("auroc"), "base_rate", "flag_rate", "recall", "precision",
        F.round(T.lift(F.col("recall"), F.col("flag_rate")), 9).alias("lift"), F.round(M.ratio(F.lit(1.0), F.col("base_rate")), 9).alias("ceiling"), "tp", "fp", "tn", "fn",
    )


def _slopes(s, d):
    curve = _curve(s, d)
    points = M.rates(M.confusion(_items(s, d), KEYS, TAU)).select(*KEYS, F.col("fpr").alias("at_fpr")).where("at_fpr is not null")
    return M.roc_slope(curve, KEYS, points).select(*KEYS, F.round("at_fpr", 9).alias("at_fpr"), F.round("slope", 6).alias("slope"), F.round("width", 9).alias("width"))


def _geometry(s, d):
    r = _rates(s, d)
    slopes = M.roc_slope(_curve(s, d), KEYS, r.select(*KEYS, F.col("fpr").alias("at_fpr")).where("at_fpr is not null"))
    b = F.col("base_rate")
    gain = F.try_divide(F.col("slope"), F.col("slope") * b + (1 - b)) / 100
    return r.join(slopes, KEYS).select(*KEYS, "fpr", F.col("recall").alias("tpr"), "flag_rate", F.round("slope", 6).alias("slope"), F.round(gain, 6).alias("recall_per_point"))


_SLOPE_SQL = f"""curve_points AS (SELECT c.eval_set_id, r.fpr AS at_fpr, c.fpr, c.tpr FROM curve c JOIN rates r ON c.eval_set_id = r.eval_set_id AND abs(c.fpr - r.fpr) <= 0.05),
slopes AS (SELECT eval_set_id, at_fpr, regr_slope(tpr, fpr) AS slope, max(fpr) - min(fpr) AS width FROM curve_points GROUP BY 1, 2)"""
_CURVE_RATES = CURVE + RATES.replace(SCORED, "")


def _projection(s, d, base_rate: float = 0.3):
    flag = F.lit(1 - base_rate) * F.col("fpr") + F.lit(base_rate) * F.col("tpr")
    ok = _curve(s, d).withColumn("flag_rate", F.round(flag, 12)).where(F.col("flag_rate") <= BUDGET)
    best = ok.groupBy(*KEYS).agg(F.max(F.struct("flag_rate", "tpr")).alias("b"))
    return best.select(*KEYS, F.round("b.flag_rate", 9).alias("flag_rate"), F.round("b.tpr", 9).alias("recall"), F.round(F.try_divide(F.col("b.tpr"), F.col("b.flag_rate")), 6).alias("lift"))


def _floors(s, d):
    risks = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 1.0)]))
    r = _rates(s, d).select(*KEYS, "base_rate", risks.alias("target_risk"))
    return r.withColumn("floor", F.round(T.abstention_floor(F.col("base_rate"), F.col("target_risk")), 9))


def _achieved(s, d):
    r = _rates(s, d).withColumn("residual", T.achieved_risk(F.col("base_rate"), F.col("recall"), F.col("flag_rate")))
    floor = T.abstention_floor(F.col("base_rate"), F.col("residual"))
    return r.select(*KEYS, F.round("residual", 9).alias("residual_risk"), F.round(floor, 9).alias("floor"), F.when(floor > 1e-9, F.round(F.col("flag_rate") / floor, 6)).alias("efficiency"))


def _volume(s, d):
    r = T.review_volume(_rates(s, d), 100_000)
    return r.select(*KEYS, *(F.round(c, 4).alias(c) for c in ("flagged", "true_flags", "false_flags", "missed")))


def _policies(s, d):
    """Judge everything, a random share, or what the score flags: judged and caught of 10,000 responses."""
    n, acc = 10_000, 0.9
    r = _rates(s, d)
    rows = F.explode(
        F.array(
            F.struct(F.lit("everything").alias("policy"), F.lit(float(n)).alias("judged"), (F.lit(n * acc) * F.col("base_rate")).alias("caught")),
            F.struct(F.lit("random").alias("policy"), (n * F.col("flag_rate")).alias("judged"), (n * acc * F.col("base_rate") * F.col("flag_rate")).alias("caught")),
            F.struct(F.lit("triggered").alias("policy"), (n * F.col("flag_rate")).alias("judged"), (n * acc * F.col("base_rate") * F.col("recall")).alias("caught")),
        )
    )
    return r.select(*KEYS, rows.alias("x")).select(*KEYS, "x.policy", F.round("x.judged", 6).alias("judged"), F.round("x.caught", 6).alias("caught"))


def _invariance(s, d):
    """Lift over a grid of error rates and judge accuracies: it depends on neither."""
    grid = F.explode(F.flatten(F.transform(F.array(F.lit(0.05), F.lit(0.2), F.lit(0.4)), lambda e: F.transform(F.array(F.lit(0.8), F.lit(1.0)), lambda a: F.struct(e.alias("e"), a.alias("a"))))))
    g = _rates(s, d).select(*KEYS, "recall", "flag_rate", grid.alias("g")).withColumns({"random": F.col("g.e") * F.col("g.a") * F.col("flag_rate"), "triggered": F.col("g.e") * F.col("g.a") * F.col("recall")})
    lifts = g.withColumn("lift", F.try_divide("triggered", "random"))
    return lifts.groupBy(*KEYS).agg(F.count("*").alias("cells"), F.round(F.max("lift") - F.min("lift"), 9).alias("spread"))


def _abstention(s, d):
    """Share, mean score by abstention (quality 0), and how well the score tells it."""
    items = _items(s, d).withColumn("label", 1 - F.col("hard"))
    base = items.groupBy(*KEYS).agg(F.count("*").alias("n"), F.round(F.avg(F.col("label").cast("double")), 9).alias("abstention_rate"), F.round(F.avg(F.when(F.col("label") == 1, F.col("score"))), 9).alias("mean_abstained"), F.round(F.avg(F.when(F.col("label") == 0, F.col("score"))), 9).alias("mean_answered"), (F.sum("label") < 30).alias("underpowered"))
    return base.join(M.auroc(items, KEYS).select(*KEYS, F.round("auroc", 9).alias("auroc")), KEYS, "left")


def _pivot(s, d):
    """Rank statistic by language (rows) and threshold family (columns): here by the source's last digit."""
    items = _items(s, d).withColumn("fold", F.concat(F.lit("f"), (F.col("item_id") % 3).cast("string")))
    return M.auroc(items, ["eval_set_id", "fold"]).groupBy("eval_set_id").pivot("fold", ["f0", "f1", "f2"]).agg(F.round(F.first("auroc"), 4))


def _top_two(s, d):
    """Midpoint of the two highest of the three rules' thresholds; null where they are equal."""
    items = _items(s, d)
    rules = T.within_budget(items, KEYS, BUDGET).unionByName(T.kth_largest(items, KEYS, BUDGET / 2)).unionByName(T.quantile(items, KEYS, BUDGET / 4))
    order = Window.partitionBy(*KEYS).orderBy(F.desc_nulls_last("threshold"))
    two = rules.withColumn("nth", F.row_number().over(order)).where("nth <= 2")
    return two.groupBy(*KEYS).agg(F.when(F.max("threshold") > F.min("threshold"), F.round(F.avg("threshold"), 9)).alias("probe_score"))


def _weighted(keep: bool):
    return lambda s, d: M.weighted_error(_items(s, d), KEYS, TAU, 1.0, 5.0, 2.0, keep).select(*KEYS, F.round("weighted_error", 9).alias("weighted_error"))


def _weighted_sql(keep: bool) -> str:
    w = [("benign", 1, "bf", keep), ("positive", 5, "miss", keep), ("hard_n", 2, "hf", False)]
    top = " + ".join(f"coalesce({k} * CAST({f} AS DOUBLE) / nullif({n}, 0), 0)" for n, k, f, _ in w)
    bottom = " + ".join(str(k) if a else f"CASE WHEN {n} > 0 THEN {k} ELSE 0 END" for n, k, f, a in w)
    return f"""WITH {SCORED}, c AS (SELECT eval_set_id, count(*) FILTER (label = 0 AND hard = 0) AS benign, count(*) FILTER (label = 0 AND hard = 0 AND score >= {TAU}) AS bf,
      count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 1 AND score < {TAU}) AS miss, count(*) FILTER (label = 0 AND hard = 1) AS hard_n, count(*) FILTER (label = 0 AND hard = 1 AND score >= {TAU}) AS hf FROM scored GROUP BY 1)
      SELECT eval_set_id, round(({top}) / nullif({bottom}, 0), 9) AS weighted_error FROM c"""


def _branch(s, d):
    """Which branch an area falls into, and whether it is below the floor of 0.55 (undefined counts as below)."""
    a = F.col("auroc")
    return M.auroc(_items(s, d), KEYS).select(*KEYS, F.when(a.isNull(), "C").when(a >= 0.6, "A").when(a >= 0.5, "B").otherwise("C").alias("branch"), F.coalesce(a <= 0.55, F.lit(True)).alias("below_floor"))


#: The band of wrong questions, the ratio of spreads below which scores are saturated, and the bar of an issue.
BAND, SATURATION, MIN_AUROC_LOW = (3, 9), 0.439, 0.55


def _pilot(s, d):
    """The pilot's ladder: questions that went wrong, the spread of scores against a reference set, the area's lower bound."""
    items = _items(s, d)
    wrong = items.groupBy(*KEYS).agg(F.count_distinct(F.when(F.col("label") == 1, F.col("question_id"))).alias("wrong_questions"))
    spread = G.quantiles(items, KEYS, "score", {"low": 0.25, "high": 0.75}).select(*KEYS, (F.col("high") - F.col("low")).alias("iqr"))
    whole = spread.where("eval_set_id = 'en'").select(F.col("iqr").alias("whole"))
    reps = R.replicate_auroc(items, R.numbered_groups(items, KEYS, "question_id", TAU), KEYS, "question_id", 1000, "block")
    low = R.interval(reps, KEYS, F.col("v")).select(*KEYS, "ci_low")
    r = wrong.join(spread, KEYS).join(low, KEYS, "left").crossJoin(F.broadcast(whole)).withColumn("ratio", F.try_divide("iqr", "whole"))
    branch = F.when(~F.col("wrong_questions").between(*BAND), "construction_defect").when(F.col("ratio") < SATURATION, "saturation").when(F.col("ci_low") < MIN_AUROC_LOW, "probe_does_not_transfer").otherwise("clears")
    return r.select(*KEYS, "wrong_questions", F.round("ratio", 6).alias("iqr_ratio"), F.round("ci_low", 9).alias("auroc_low"), branch.alias("branch"), (branch == "saturation").alias("consumes_retry"))


def _prompt_summary(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    chars, words = F.length("text"), F.size(F.filter(F.split("text", "[ \t-\r]+"), lambda w: w != ""))
    x = docs.select("lang", chars.alias("c"), words.alias("w"))
    plain = x.groupBy("lang").agg(F.count("*").alias("n"), *(e for k, c in (("chars", "c"), ("words", "w")) for e in (F.round(F.avg(c), 6).alias(f"{k}_mean"), F.min(c).cast("long").alias(f"{k}_min"), F.max(c).cast("long").alias(f"{k}_max"))))
    return plain.join(G.quantiles(x, ["lang"], "c", {"chars_median": 0.5}), "lang").join(G.quantiles(x, ["lang"], "w", {"words_median": 0.5}), "lang")


def _token_lengths(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select("source", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("t"))
    q = G.quantiles(docs, ["source"], "t", {"low": 0.25, "median": 0.5, "high": 0.75})
    plain = docs.groupBy("source").agg(F.round(F.avg("t"), 6).alias("mean"), F.min("t").cast("long").alias("least"), F.max("t").cast("long").alias("most"))
    return plain.join(q, "source").select("source", "mean", "median", (F.col("high") - F.col("low")).alias("iqr"), "least", "most")


def _latency(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    q = G.quantiles(e, ["event_type"], "value", {"median": 0.5, "p95": 0.95})
    return q.join(e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")), "event_type")


QUERIES = {
    "ag01_confusion": (lambda s, d: M.confusion(_items(s, d), KEYS, TAU), f"WITH {COUNTS} SELECT * FROM counts"),
    "ag02_recall": (lambda s, d: _rates(s, d).select(*KEYS, "recall"), f"WITH {RATES} SELECT eval_set_id, recall FROM rates"),
    "ag03_precision": (lambda s, d: _rates(s, d).select(*KEYS, "precision"), f"WITH {RATES} SELECT eval_set_id, precision FROM rates"),
    "ag04_flag_rate": (lambda s, d: _rates(s, d).select(*KEYS, "flag_rate"), f"WITH {RATES} SELECT eval_set_id, flag_rate FROM rates"),
    "ag05_fpr": (lambda s, d: _rates(s, d).select(*KEYS, "fpr"), f"WITH {RATES} SELECT eval_set_id, fpr FROM rates"),
    "ag06_auroc": (lambda s, d: M.auroc(_items(s, d), KEYS).select(*KEYS, F.round("auroc", 9).alias("auroc")), f"WITH {SCORED}, {_auroc_sql()} SELECT eval_set_id, round(auroc, 9) AS auroc FROM area"),
    "ag07_metric_row": (
        _metric_row,
        f"""WITH {RATES}, {_auroc_sql()} SELECT r.eval_set_id, n, round(auroc, 9) AS auroc, base_rate, flag_rate, recall, CASE WHEN tp + fp > 0 THEN precision END AS precision,
        round(recall / nullif(flag_rate, 0), 9) AS lift, round(1 / nullif(base_rate, 0), 9) AS ceiling, tp, fp, tn, fn FROM rates r LEFT JOIN area a ON r.eval_set_id = a.eval_set_id""",
    ),
    "ag08_weighted_error_present": (_weighted(False), _weighted_sql(False)),
    "ag09_weighted_error_policy": (_weighted(True), _weighted_sql(True)),
    "ag11_exact_counts": (lambda s, d: _items(s, d).groupBy("eval_set_id").agg(F.count_if((F.col("score") >= TAU) & (F.col("label") == 1)).alias("confirmed_errors"), F.count("*").alias("n")), f"WITH {SCORED} SELECT eval_set_id, count(*) FILTER (score >= {TAU} AND label = 1) AS confirmed_errors, count(*) AS n FROM scored GROUP BY 1"),
    "ag14_source_counts": (lambda s, d: s.read.parquet(f"{d}/documents.parquet").groupBy("source", "lang").agg(F.count("*").alias("n")), "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2"),
    "ag15_wrong_questions": (lambda s, d: _items(s, d).groupBy(*KEYS).agg(F.count_distinct(F.when(F.col("label") == 1, F.col("question_id"))).alias("wrong_questions")), f"WITH {SCORED} SELECT eval_set_id, count(DISTINCT CASE WHEN label = 1 THEN question_id END) AS wrong_questions FROM scored GROUP BY 1"),
    "ag16_base_rates": (
        lambda s, d: _items(s, d).groupBy(*KEYS).agg(M.ratio(F.sum("label"), F.count("*")).alias("base_rate"), M.ratio(F.sum(1 - F.col("hard")), F.count("*")).alias("abstention_rate")).withColumn("in_gate", F.col("base_rate").between(0.05, 0.95)),
        f"WITH {SCORED} SELECT eval_set_id, CAST(sum(label) AS DOUBLE) / count(*) AS base_rate, CAST(sum(1 - hard) AS DOUBLE) / count(*) AS abstention_rate, CAST(sum(label) AS DOUBLE) / count(*) BETWEEN 0.05 AND 0.95 AS in_gate FROM scored GROUP BY 1",
    ),
    "ag19_prompt_summary": (
        _prompt_summary,
        r"""WITH x AS (SELECT lang, length(text) AS c, len(list_filter(regexp_split_to_array(text, '[ \x09-\x0D]+'), lambda w: w <> '')) AS w FROM documents)
        SELECT lang, count(*) AS n, round(avg(c), 6) AS chars_mean, quantile_cont(CAST(c AS DOUBLE), 0.5) AS chars_median, min(c) AS chars_min, max(c) AS chars_max,
        round(avg(w), 6) AS words_mean, quantile_cont(CAST(w AS DOUBLE), 0.5) AS words_median, CAST(min(w) AS BIGINT) AS words_min, CAST(max(w) AS BIGINT) AS words_max FROM x GROUP BY 1""",
    ),
    "ag20_token_lengths": (
        _token_lengths,
        r"""WITH x AS (SELECT source, CAST(len(regexp_extract_all(text, '[^\x09-\x0D ]+')) AS DOUBLE) AS t FROM documents)
        SELECT source, round(avg(t), 6) AS mean, quantile_cont(t, 0.5) AS median, quantile_cont(t, 0.75) - quantile_cont(t, 0.25) AS iqr, CAST(min(t) AS BIGINT) AS least, CAST(max(t) AS BIGINT) AS most FROM x GROUP BY 1""",
    ),
    "ag21_abstention": (
        _abstention,
        f"""WITH {SCORED}, {_auroc_sql("1 - hard")}, b AS (SELECT eval_set_id, count(*) AS n, round(avg(CAST(1 - hard AS DOUBLE)), 9) AS abstention_rate, round(avg(score) FILTER (hard = 0), 9) AS mean_abstained,
        round(avg(score) FILTER (hard = 1), 9) AS mean_answered, sum(1 - hard) < 30 AS underpowered FROM scored GROUP BY 1) SELECT b.*, round(auroc, 9) AS auroc FROM b LEFT JOIN area a ON a.eval_set_id = b.eval_set_id""",
    ),
    "ag22_latency_percentiles": (_latency, "SELECT event_type, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.95) AS p95, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1"),
    "ag23_policy_table": (
        _policies,
        f"""WITH {RATES} SELECT eval_set_id, 'everything' AS policy, CAST(10000 AS DOUBLE) AS judged, round(9000 * base_rate, 6) AS caught FROM rates
        UNION ALL SELECT eval_set_id, 'random', round(10000 * flag_rate, 6), round(9000 * base_rate * flag_rate, 6) FROM rates
        UNION ALL SELECT eval_set_id, 'triggered', round(10000 * flag_rate, 6), round(9000 * base_rate * recall, 6) FROM rates""",
    ),
    "ag24_fold_pivot": (
        _pivot,
        f"""WITH {SCORED}, ranked AS (SELECT eval_set_id, item_id % 3 AS fold, label AS y, rank() OVER (PARTITION BY eval_set_id, item_id % 3 ORDER BY score) + (count(*) OVER (PARTITION BY eval_set_id, item_id % 3, score) - 1) / CAST(2 AS DOUBLE) AS r FROM scored),
        area AS (SELECT eval_set_id, fold, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / CAST(2 AS DOUBLE)) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS a FROM ranked GROUP BY 1, 2)
        SELECT eval_set_id, round(max(a) FILTER (fold = 0), 4) AS f0, round(max(a) FILTER (fold = 1), 4) AS f1, round(max(a) FILTER (fold = 2), 4) AS f2 FROM area GROUP BY 1""",
    ),
    "wn01_average_rank": (lambda s, d: M.average_ranks(_items(s, d), KEYS), f"WITH {SCORED} SELECT DISTINCT eval_set_id, score, count(*) OVER (PARTITION BY eval_set_id, score) AS ties, rank() OVER (PARTITION BY eval_set_id ORDER BY score) + (count(*) OVER (PARTITION BY eval_set_id, score) - 1) / CAST(2 AS DOUBLE) AS avg_rank FROM scored"),
    "wn02_running_counts": (lambda s, d: M.confusion_at_every_score(_items(s, d), KEYS), f"WITH {GRAIN} SELECT eval_set_id, score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(q - fp AS BIGINT) AS tn, CAST(p - tp AS BIGINT) AS fn FROM cum"),
    "th01_threshold_budget": (lambda s, d: T.within_budget(_items(s, d), KEYS, BUDGET), f"WITH {GRAIN} SELECT eval_set_id, min(score) FILTER (CAST(upto AS DOUBLE) / n <= {BUDGET}) AS threshold FROM cum GROUP BY 1"),
    "th02_kth_threshold": (lambda s, d: T.kth_largest(_items(s, d), KEYS, BUDGET), f"WITH {SCORED}, r AS (SELECT eval_set_id, score, row_number() OVER (PARTITION BY eval_set_id ORDER BY score DESC) AS nth, count(*) OVER (PARTITION BY eval_set_id) AS n FROM scored) SELECT eval_set_id, max(score) AS threshold FROM r WHERE nth = greatest(1, CAST(round_even({BUDGET} * n, 0) AS BIGINT)) GROUP BY 1"),
    "th03_quantile_threshold": (lambda s, d: T.quantile(_items(s, d), KEYS, BUDGET).select(*KEYS, F.round("threshold", 9).alias("threshold")), f"WITH {SCORED} SELECT eval_set_id, round(quantile_cont(score, {1 - BUDGET}), 9) AS threshold FROM scored GROUP BY 1"),
    "th04_roc_curve": (_curve, f"WITH {CURVE} SELECT * FROM curve"),
    "th04_roc_area": (lambda s, d: M.roc_area(_items(s, d), KEYS).select(*KEYS, F.round("area", 9).alias("area")), f"WITH {SCORED}, {_auroc_sql()} SELECT eval_set_id, round(auroc, 9) AS area FROM area"),
    "th05_roc_slope": (_slopes, f"WITH {_CURVE_RATES}, {_SLOPE_SQL} SELECT eval_set_id, round(at_fpr, 9) AS at_fpr, round(slope, 6) AS slope, round(width, 9) AS width FROM slopes"),
    "th06_op_geometry": (_geometry, f"WITH {_CURVE_RATES}, {_SLOPE_SQL} SELECT r.eval_set_id, fpr, recall AS tpr, flag_rate, round(slope, 6) AS slope, round(slope / nullif(slope * base_rate + (1 - base_rate), 0) / 100, 6) AS recall_per_point FROM rates r JOIN slopes s ON r.eval_set_id = s.eval_set_id"),
    "th08_lift": (lambda s, d: _rates(s, d).select(*KEYS, F.round(T.lift(F.col("recall"), F.col("flag_rate")), 9).alias("lift")), f"WITH {RATES} SELECT eval_set_id, round(recall / nullif(flag_rate, 0), 9) AS lift FROM rates"),
    "th09_lift_ceiling": (
        lambda s, d: _rates(s, d).select(*KEYS, F.round(T.lift_ceiling(F.col("base_rate"), F.col("flag_rate")), 9).alias("ceiling"), F.round(F.try_divide(T.lift(F.col("recall"), F.col("flag_rate")), T.lift_ceiling(F.col("base_rate"), F.col("flag_rate"))), 9).alias("share")),
        f"WITH {RATES} SELECT eval_set_id, round(1 / nullif(greatest(base_rate, flag_rate), 0), 9) AS ceiling, round(recall / nullif(flag_rate, 0) * greatest(base_rate, flag_rate), 9) AS share FROM rates",
    ),
    "th10_lift_from_precision": (lambda s, d: _rates(s, d).select(*KEYS, F.round(M.ratio(F.col("precision"), F.col("base_rate")), 9).alias("lift"), F.round(M.ratio(F.lit(1.0), F.col("base_rate")), 9).alias("ceiling")), f"WITH {RATES} SELECT eval_set_id, round(precision / nullif(base_rate, 0), 9) AS lift, round(1 / nullif(base_rate, 0), 9) AS ceiling FROM rates"),
    "th11_projection": (
        _projection,
        f"""WITH {CURVE}, p AS (SELECT eval_set_id, round(0.7 * fpr + 0.3 * tpr, 12) AS f, tpr FROM curve), b AS (SELECT eval_set_id, arg_max(f, (f, tpr)) AS f, max((f, tpr)) AS m FROM p WHERE f <= {BUDGET} GROUP BY 1)
        SELECT eval_set_id, round(f, 9) AS flag_rate, round(m[2], 9) AS recall, round(m[2] / nullif(f, 0), 6) AS lift FROM (SELECT eval_set_id, f, [struct_extract(m, 1), struct_extract(m, 2)] AS m FROM b)""",
    ),
    "th12_lift_invariance": (_invariance, f"WITH {RATES} SELECT eval_set_id, CAST(6 AS BIGINT) AS cells, CASE WHEN flag_rate > 0 AND recall IS NOT NULL THEN CAST(0 AS DOUBLE) END AS spread FROM rates"),
    "th13_abstention_floor": (_floors, f"WITH {RATES} SELECT eval_set_id, base_rate, target_risk, CASE WHEN target_risk < 1 THEN round(greatest(0, (base_rate - target_risk) / (1 - target_risk)), 9) END AS floor FROM rates, (SELECT unnest([0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 1.0]::DOUBLE[]) AS target_risk)"),
    "th14_achieved_risk": (_achieved, f"WITH {RATES}, x AS (SELECT *, base_rate * (1 - recall) / nullif(1 - flag_rate, 0) AS r FROM rates), y AS (SELECT *, CASE WHEN r < 1 THEN greatest(0, (base_rate - r) / (1 - r)) END AS fl FROM x) SELECT eval_set_id, round(r, 9) AS residual_risk, round(fl, 9) AS floor, CASE WHEN fl > 1e-9 THEN round(flag_rate / fl, 6) END AS efficiency FROM y"),
    "th15_review_volume": (_volume, f"WITH {RATES} SELECT eval_set_id, round(flag_rate * 100000, 4) AS flagged, round(base_rate * recall * 100000, 4) AS true_flags, round(greatest(0, flag_rate * 100000 - base_rate * recall * 100000), 4) AS false_flags, round(greatest(0, base_rate * 100000 - base_rate * recall * 100000), 4) AS missed FROM rates"),
    "th16_sample_size": (lambda s, d: _rates(s, d).select(*KEYS, T.sample_size(F.col("recall"), 0.05, 1.5).cast("long").alias("items")), f"WITH {RATES} SELECT eval_set_id, CAST(ceil(1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE * recall * (1 - recall) / (0.05::DOUBLE * 0.05::DOUBLE) * 1.5::DOUBLE) AS BIGINT) AS items FROM rates"),
    "th18_fixed_cut_points": (_branch, f"WITH {SCORED}, {_auroc_sql()} SELECT eval_set_id, CASE WHEN auroc >= 0.6 THEN 'A' WHEN auroc >= 0.5 THEN 'B' ELSE 'C' END AS branch, coalesce(auroc <= 0.55, true) AS below_floor FROM area"),
    "th04_midpoint_of_three_rules": (
        _top_two,
        f"""WITH {GRAIN}, k AS (SELECT eval_set_id, score, row_number() OVER (PARTITION BY eval_set_id ORDER BY score DESC) AS nth, count(*) OVER (PARTITION BY eval_set_id) AS n FROM scored),
        t AS (SELECT eval_set_id, min(score) FILTER (CAST(upto AS DOUBLE) / n <= {BUDGET}) AS x FROM cum GROUP BY 1
          UNION ALL SELECT eval_set_id, score FROM k WHERE nth = greatest(1, CAST(round_even({BUDGET / 2} * n, 0) AS BIGINT))
          UNION ALL SELECT eval_set_id, quantile_cont(score, {1 - BUDGET / 4}) FROM scored GROUP BY 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY eval_set_id ORDER BY x DESC NULLS LAST) AS nth FROM t)
        SELECT eval_set_id, CASE WHEN max(x) > min(x) THEN round(avg(x), 9) END AS probe_score FROM r WHERE nth <= 2 GROUP BY 1""",
    ),
    "jn08_least_weighted_error": (
        lambda s, d: T.least_weighted_error(_items(s, d), KEYS, 1.0, 5.0),
        f"""WITH {GRAIN}, o AS (SELECT eval_set_id, score AS threshold, round((1 * CAST(fp AS DOUBLE) / nullif(q, 0) + 5 * (1 - CAST(tp AS DOUBLE) / nullif(p, 0))) / 6, 9) AS objective FROM cum),
        r AS (SELECT *, row_number() OVER (PARTITION BY eval_set_id ORDER BY objective, threshold) AS nth FROM o WHERE objective IS NOT NULL) SELECT eval_set_id, objective, threshold FROM r WHERE nth = 1""",
    ),
}
