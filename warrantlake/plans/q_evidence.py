"""Metric blocks, issues and refusals, frozen scores and claims, over scored items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warrantlake.functions import bounds as B
from warrantlake.functions.rng import draw_sql
from warrantlake.operators import evidence as E
from warrantlake.operators import resample as R
from warrantlake.plans.q_drift import GROUPS, HIGH, LOW, REPS, TAU, _groups, quantile_sql
from warrantlake.plans.q_metrics import BAND, MIN_AUROC_LOW, SATURATION, _pilot
from warrantlake.sources.shared import written
from warrantlake.sources.views import SCORED, scored_items

KEYS, UNIT = ["eval_set_id"], "question_id"
#: Profile, and least items, of the refusals by source.
MIN_RECALL, MAX_FPR, LEAST_N = 0.1, 0.6, 5


def _block(s: SparkSession, d: str) -> DataFrame:
    return E.metric_block(scored_items(s, d), KEYS, UNIT, TAU, REPS, "block")


def _rounded(block: DataFrame, keys: list[str]) -> DataFrame:
    return block.select(*keys, "metric", "kind", "n", *(F.round(c, 9).alias(c) for c in ("value", "ci_low", "ci_high")))


def _auroc(s, d):
    items = scored_items(s, d)
    reps = R.replicate_auroc(items, _groups(s, d), KEYS, UNIT, REPS, "block")
    return R.interval(reps, KEYS, F.col("v")).select(*KEYS, F.round("ci_low", 9).alias("ci_low"), F.round("ci_high", 9).alias("ci_high"), "replicates", "undefined")


def block_sql(key: str = "eval_set_id", unit: str = "question_id", seed: str = "block") -> str:
    """``metrics``: the rows of the metric block."""
    exact = B.low_sql("k", "o"), B.high_sql("k", "o")
    return f"""{SCORED}, gr AS (SELECT {key} AS s, {unit} AS u, count(*) FILTER (score >= {TAU} AND label = 1) AS tp, count(*) FILTER (score >= {TAU} AND label = 0) AS fp, count(*) FILTER (score < {TAU} AND label = 0) AS tn, count(*) FILTER (score < {TAU} AND label = 1) AS fn,
      row_number() OVER (PARTITION BY {key} ORDER BY {unit}) - 1 AS g, count(*) OVER (PARTITION BY {key}) AS groups FROM scored GROUP BY 1, 2),
    sz AS (SELECT s, max(groups) AS groups FROM gr GROUP BY 1), dr AS (SELECT s, groups, rep, unnest(range(0, groups)) AS i FROM (SELECT *, unnest(range(0, {REPS})) AS rep FROM sz)),
    dw AS (SELECT s, rep, {draw_sql(f"'{seed}'", "rep", "i")} % groups AS g FROM dr),
    rp AS (SELECT w.s, w.rep, sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM dw w JOIN gr x ON x.s = w.s AND x.g = w.g GROUP BY 1, 2),
    it AS (SELECT x.s, x.g, score, label FROM scored c JOIN gr x ON x.s = c.{key} AND x.u = c.{unit}), ra AS (SELECT w.s, w.rep, score, label FROM dw w JOIN it ON it.s = w.s AND it.g = w.g),
    rk AS (SELECT *, rank() OVER (PARTITION BY s, rep ORDER BY score) + (count(*) OVER (PARTITION BY s, rep, score) - 1) / 2::DOUBLE AS r FROM ra),
    ar AS (SELECT s, rep, (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2::DOUBLE) / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0) AS v FROM rk GROUP BY 1, 2),
    pk AS (SELECT *, rank() OVER (PARTITION BY s ORDER BY score) + (count(*) OVER (PARTITION BY s, score) - 1) / 2::DOUBLE AS r FROM it),
    ap AS (SELECT s, (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2::DOUBLE) / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0) AS auroc FROM pk GROUP BY 1),
    c AS (SELECT s, sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM gr GROUP BY 1),
    lg AS (SELECT s, CAST(NULL AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS o, 'auroc' AS metric, auroc AS value FROM ap UNION ALL SELECT s, tp, tp + fn, 'recall', CAST(tp AS DOUBLE) / nullif(tp + fn, 0) FROM c
      UNION ALL SELECT s, tp, tp + fp, 'precision', coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) FROM c UNION ALL SELECT s, fp, fp + tn, 'fpr', CAST(fp AS DOUBLE) / nullif(fp + tn, 0) FROM c
      UNION ALL SELECT s, tp + fp, tp + fp + tn + fn, 'flag_rate', CAST(tp + fp AS DOUBLE) / (tp + fp + tn + fn) FROM c),
    dv AS (SELECT s, rep, 'auroc' AS metric, v FROM ar UNION ALL SELECT s, rep, 'recall', CAST(tp AS DOUBLE) / nullif(tp + fn, 0) FROM rp UNION ALL SELECT s, rep, 'precision', CAST(tp AS DOUBLE) / nullif(tp + fp, 0) FROM rp
      UNION ALL SELECT s, rep, 'fpr', CAST(fp AS DOUBLE) / nullif(fp + tn, 0) FROM rp UNION ALL SELECT s, rep, 'flag_rate', CAST(tp + fp AS DOUBLE) / (tp + fp + tn + fn) FROM rp),
    iv AS (SELECT s, metric, {quantile_sql(LOW)} AS lo, {quantile_sql(HIGH)} AS hi, {quantile_sql(0.95)} AS one FROM dv GROUP BY 1, 2),
    md AS (SELECT lg.*, tp + fn AS p, fp + tn AS q, lo, hi, one, lg.k IS NOT NULL AND coalesce(hi - lo < 1e-12, true) AS flat, tp + fn = 0 AND lg.metric = 'fpr' AS side, lg.metric = 'precision' AND o = 0 AS nothing
      FROM lg JOIN c ON c.s = lg.s LEFT JOIN iv ON iv.s = lg.s AND iv.metric = lg.metric WHERE value IS NOT NULL AND NOT ((tp + fn = 0 OR fp + tn = 0) AND lg.metric IN ('auroc', 'recall', 'precision'))),
    me AS (SELECT s, CASE WHEN side THEN 'fpr_hard_negatives' ELSE metric END AS metric, p + q AS n, value,
      CASE WHEN nothing OR side THEN 0.0::DOUBLE WHEN flat THEN {exact[0]} ELSE lo END AS lo, CASE WHEN nothing THEN 1.0::DOUBLE WHEN side THEN CASE WHEN flat THEN {B.high_sql("k", "o", 0.05)} ELSE one END WHEN flat THEN {exact[1]} ELSE hi END AS hi FROM md),
    metrics AS (SELECT s, metric, 'ESTIMATED' AS kind, CAST(n AS BIGINT) AS n, value, least(lo, value) AS ci_low, greatest(hi, value) AS ci_high FROM me
      UNION ALL SELECT s, 'confirmed_errors', 'EXACT', CAST(tp + fp AS BIGINT), CAST(tp AS DOUBLE), NULL, NULL FROM c)"""


_ROUNDED = "metric, kind, n, round(value, 9) AS value, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high"


def _source_facts(items: DataFrame) -> DataFrame:
    """Each source's items, its controls (which of five failed, how many were reported), and what its profile declares."""
    n = items.groupBy("question_id").agg(F.count("*").alias("n_test"), F.sum("hard").alias("hard"))
    names = F.array(*[F.lit(c) for c in ("padding_fault", "label_shuffle", "null_feature", "canary", "determinism")])
    failed = F.filter(names, lambda c, i: (F.col("hard") + i) % 11 == 10)
    return n.select("question_id", "n_test", failed.alias("failed"), F.when(F.col("n_test") % 9 == 0, 4).otherwise(5).alias("reported"), F.when(F.col("n_test") % 2 == 0, MIN_RECALL).alias("min_recall"), F.when(F.col("n_test") % 3 != 0, MAX_FPR).alias("max_fpr"))


def _refusals(s, d):
    """A warrant for each source of each language: issued, or refused with every criterion that it misses."""
    items = scored_items(s, d)
    block = E.metric_block(items, ["question_id"], "item_id", TAU, REPS, "issue")
    x = E.wide(block, ["question_id"]).join(_source_facts(items), "question_id")
    reasons = E.refusals(F.col("n_test"), F.col("failed"), F.col("reported"), LEAST_N, F.col("min_recall"), F.col("max_fpr"))
    return x.select("question_id", "n_test", reasons.alias("r")).select("question_id", "n_test", F.when(F.size("r") == 0, "VALID").otherwise("REFUSED").alias("status"), F.concat_ws("; ", "r").alias("reasons"))


_REFUSALS = f"""WITH {block_sql("question_id", "item_id", "issue")},
  f AS (SELECT question_id, count(*) AS n_test, sum(hard) AS h, CASE WHEN count(*) % 9 = 0 THEN 4 ELSE 5 END AS reported, CASE WHEN count(*) % 2 = 0 THEN {MIN_RECALL}::DOUBLE END AS min_recall, CASE WHEN count(*) % 3 <> 0 THEN {MAX_FPR}::DOUBLE END AS max_fpr FROM scored GROUP BY 1),
  w AS (SELECT s, max(ci_low) FILTER (metric = 'auroc') AS au, count(*) FILTER (metric = 'auroc') AS has_au, max(ci_low) FILTER (metric = 'recall') AS rl, count(*) FILTER (metric = 'recall') AS has_r, max(value) FILTER (metric = 'flag_rate') AS fr,
    count(*) FILTER (metric = 'fpr_hard_negatives') AS has_h, max(ci_high) FILTER (metric = 'fpr_hard_negatives') AS hh FROM metrics GROUP BY 1),
  r AS (SELECT question_id, n_test, list_concat(list_transform(list_filter([0, 1, 2, 3, 4], lambda i: (h + i) % 11 = 10), lambda i: 'control:' || ['padding_fault', 'label_shuffle', 'null_feature', 'canary', 'determinism'][i + 1]), list_filter([CASE WHEN reported <> 5 THEN 'control_suite' END, CASE WHEN n_test < {LEAST_N} THEN 'n_test' END,
    CASE WHEN has_au = 0 AND max_fpr IS NULL THEN 'single_class_envelope' END, CASE WHEN has_au > 0 AND coalesce(au <= {E.MIN_AUROC_LOW}, true) THEN 'auroc_lower_ci' END, CASE WHEN has_r > 0 AND fr > 0 AND coalesce(rl / fr <= {E.MIN_LIFT_LOW}, true) THEN 'lift_lower_ci' END,
    CASE WHEN min_recall IS NOT NULL AND has_r = 0 THEN 'recall_undefined' END, CASE WHEN min_recall IS NOT NULL AND has_r > 0 AND coalesce(rl < min_recall, true) THEN 'recall_lower_ci' END,
    CASE WHEN max_fpr IS NOT NULL AND has_h = 0 THEN 'fpr_hard_negatives' END, CASE WHEN max_fpr IS NOT NULL AND has_h > 0 AND hh > max_fpr THEN 'fpr_hard_negatives_upper_ci' END], lambda x: x IS NOT NULL)) AS r FROM f JOIN w ON w.s = f.question_id)
  SELECT question_id, n_test, CASE WHEN len(r) = 0 THEN 'VALID' ELSE 'REFUSED' END AS status, array_to_string(r, '; ') AS reasons FROM r"""


def _rows(s, d):
    """The row bootstrap: items, not questions, are drawn; lift and its ceiling beside the flag rate."""
    items = scored_items(s, d)
    groups = R.numbered_groups(items, KEYS, "item_id", TAU)
    reps = R.replicates(groups, KEYS, REPS, "rows", list(R.COUNTS))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    base, rate = F.try_divide((F.col("tp") + F.col("fn")).cast("double"), n.cast("double")), R.flag_rate()
    stats = {"flag_rate": rate, "lift": F.try_divide(R.recall(), rate), "ceiling": F.try_divide(F.lit(1.0), F.greatest(base, rate))}
    long = reps.select(*KEYS, "rep", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in stats.items()])).alias("x")).select(*KEYS, "rep", "x.*")
    return R.interval(long, [*KEYS, "metric"], F.col("v")).select(*KEYS, "metric", F.round("ci_low", 9).alias("ci_low"), F.round("ci_high", 9).alias("ci_high"), "undefined")


_ROWS = f"""WITH {GROUPS.replace("question_id, count", "item_id, count").replace("ORDER BY question_id", "ORDER BY item_id")}, sz AS (SELECT eval_set_id, max(groups) AS groups FROM grp GROUP BY 1),
  dr AS (SELECT eval_set_id, groups, rep, unnest(range(0, groups)) AS i FROM (SELECT *, unnest(range(0, {REPS})) AS rep FROM sz)), dw AS (SELECT eval_set_id, rep, {draw_sql("'rows'", "rep", "i")} % groups AS g FROM dr),
  rp AS (SELECT w.eval_set_id, w.rep, sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM dw w JOIN grp x ON x.eval_set_id = w.eval_set_id AND x.g = w.g GROUP BY 1, 2),
  st AS (SELECT eval_set_id, rep, CAST(tp + fp AS DOUBLE) / (tp + fp + tn + fn) AS fr, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS rc, CAST(tp + fn AS DOUBLE) / (tp + fp + tn + fn) AS b FROM rp),
  lg AS (SELECT eval_set_id, 'flag_rate' AS metric, fr AS v FROM st UNION ALL SELECT eval_set_id, 'lift', rc / nullif(fr, 0) FROM st UNION ALL SELECT eval_set_id, 'ceiling', 1 / nullif(greatest(b, fr), 0) FROM st)
  SELECT eval_set_id, metric, round({quantile_sql(LOW)}, 9) AS ci_low, round({quantile_sql(HIGH)}, 9) AS ci_high, count(*) FILTER (v IS NULL) AS undefined FROM lg GROUP BY 1, 2"""


def _frozen(s, d) -> tuple[DataFrame, DataFrame]:
    """Scores written once, and a content hash of each set's rows that doesn't depend on their order."""
    scores = written(scored_items(s, d).select("item_id", *KEYS, UNIT, "label", "hard", "score"), "scores")
    return scores, written(_content(scores), "hashes")


def _content(scores: DataFrame) -> DataFrame:
    row = F.conv(F.substring(F.md5(F.concat_ws("|", "item_id", UNIT, "label", "score")), 1, 12), 16, 10).cast("decimal(38,0)")
    return scores.groupBy(*KEYS).agg(F.count("*").alias("rows"), F.sum(row).alias("content"))


def values_agree(a: str, b: str):
    """Both absent, or equal but for rounding."""
    x, y = F.col(a), F.col(b)
    return F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(F.abs(x - y) <= F.greatest(1e-12 * F.greatest(F.abs(x), F.abs(y)), F.lit(1e-15)))


def _recompute(s, d):
    """Committed metrics against those recomputed from frozen scores whose content hash still holds.

    Two faults are planted: a committed recall of one set is moved by a millionth, and a score of another is changed.
    """
    scores, hashes = _frozen(s, d)
    block = written(_block(s, d), "block")
    moved = (F.col("eval_set_id") == "de") & (F.col("metric") == "recall")
    committed = block.withColumn("value", F.when(moved, F.col("value") + 1e-6).otherwise(F.col("value")))
    read = scores.withColumn("score", F.when((F.col("eval_set_id") == "es") & (F.col("label") == 1), F.col("score") + 0.01).otherwise(F.col("score")))
    sound = _content(read).join(hashes, [*KEYS, "rows", "content"], "left_semi").select(*KEYS)
    again = E.metric_block(read.join(sound, KEYS, "left_semi"), KEYS, UNIT, TAU, REPS, "block")
    pairs = committed.alias("c").join(again.select(*KEYS, "metric", *(F.col(c).alias(f"new_{c}") for c in ("value", "ci_low", "ci_high")), F.lit(True).alias("found")), [*KEYS, "metric"], "left")
    pairs = pairs.join(sound.withColumn("sound", F.lit(True)), KEYS, "left")
    same = values_agree("value", "new_value") & values_agree("ci_low", "new_ci_low") & values_agree("ci_high", "new_ci_high")
    outcome = F.when(F.col("sound").isNull(), "scores changed").when(F.col("found").isNull(), "only committed").when(same, "agrees").otherwise("differs")
    return pairs.select(*KEYS, "metric", outcome.alias("outcome"))


def _claims(s, d):
    """Claims quoted in a text table against the artifacts that they name, at the quoted precision.

    The table's lines and the artifacts are written and read back; some claims are edited, one names no artifact.
    """
    b = _block(s, d).where("kind = 'ESTIMATED'")
    entry = F.struct("metric", F.struct("value", "ci_low", "ci_high").alias("b"))
    artifacts = b.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(entry)).alias("metrics"))
    artifacts = written(artifacts.select(F.concat(F.lit("results/"), "eval_set_id", F.lit(".json")).alias("artifact"), F.to_json(F.struct("metrics")).alias("document")), "artifacts")
    quoted = lambda c, edit: F.format_string("%.3f", F.bround(F.col(c), 3) + edit)
    value = quoted("value", F.when((F.col("eval_set_id") == "de") & (F.col("metric") == "flag_rate"), 0.001).otherwise(0.0))
    low = quoted("ci_low", F.when((F.col("eval_set_id") == "en") & (F.col("metric") == "precision"), 0.01).otherwise(0.0))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.concat_ws(" ", "eval_set_id", "metric"), value, F.concat(F.lit("["), low, F.lit(", "), quoted("ci_high", F.lit(0.0)), F.lit("]")), F.concat(F.lit("results/"), "eval_set_id", F.lit(".json")), F.concat(F.lit("metrics."), "metric", F.lit(".value"))), F.lit(" |"))
    other = s.createDataFrame([("# Results",), ("| Claim | Value | 95 % | Artifact | Field |",), ("| --- | --- | --- | --- | --- |",), ("| none | 1.000 | - | results/none.json | metrics.recall.value |",), ("| en gone | 1.000 | - | results/en.json | metrics.gone.value |",)], "text string")
    lines = written(b.select(line.alias("text")).unionByName(other), "claims")
    cells = F.transform(F.split("text", r"\|"), lambda x: F.trim(x))
    rows = lines.where(F.startswith("text", F.lit("|")) & ~F.startswith("text", F.lit("| ---"))).select(cells.alias("x")).where("x[1] <> 'Claim'")
    claims = rows.select(*(F.col("x")[i + 1].alias(n) for i, n in enumerate(("claim", "value", "interval", "artifact", "field"))))
    x = claims.join(artifacts, "artifact", "left")
    found = lambda field: F.expr(f"get_json_object(document, concat('$.', {field}))").cast("double")
    x = x.withColumns({"found": found("field"), **{b: found(f"regexp_replace(field, '[.]value$', '.{b}')") for b in ("ci_low", "ci_high")}})
    near = lambda a, b: F.bround(F.col(a), 3) == F.bround(b.cast("double"), 3)
    bound = lambda i: F.regexp_extract("interval", r"\[([-0-9.]+), ([-0-9.]+)\]", i)
    outcome = F.when(F.col("document").isNull(), "no artifact").when(F.col("found").isNull(), "no field").when(~near("found", F.col("value")), "value").when(F.col("interval") == "-", "matches").when(~near("ci_low", bound(1)), "interval low").when(~near("ci_high", bound(2)), "interval high").otherwise("matches")
    return x.select("claim", outcome.alias("outcome"))


def _canary(s, d):
    """Recall on each source's canaries, its hard positives: only a full one passes, and none without canaries."""
    items = scored_items(s, d)
    c = items.where("label = 1 and hard = 1").groupBy("question_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= TAU).alias("k"))
    x = items.select("question_id").distinct().join(c, "question_id", "left")
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0))
    return x.select("question_id", n.alias("canaries"), F.coalesce(F.try_divide(k.cast("double"), n.cast("double")), F.lit(0.0)).alias("recall"), ((n > 0) & (k == n)).alias("passed"))


QUERIES = {
    "ag10_metric_block": (lambda s, d: _rounded(_block(s, d), KEYS), f"WITH {block_sql()} SELECT s AS eval_set_id, {_ROUNDED} FROM metrics"),
    "st01_bootstrap_auroc": (_auroc, f"WITH {block_sql()} SELECT s AS eval_set_id, round({quantile_sql(LOW)}, 9) AS ci_low, round({quantile_sql(HIGH)}, 9) AS ci_high, count(v) AS replicates, count(*) FILTER (v IS NULL) AS undefined FROM ar GROUP BY 1"),
    "st18_row_bootstrap": (_rows, _ROWS),
    "sr14_refusals": (_refusals, _REFUSALS),
    "sr20_recompute": (_recompute, f"WITH {block_sql()} SELECT s AS eval_set_id, metric, CASE WHEN s = 'es' THEN 'scores changed' WHEN s = 'de' AND metric = 'recall' THEN 'differs' ELSE 'agrees' END AS outcome FROM metrics"),
    "jn13_claims": (
        _claims,
        f"""WITH {block_sql()} SELECT s || ' ' || metric AS claim, CASE WHEN s = 'de' AND metric = 'flag_rate' THEN 'value' WHEN s = 'en' AND metric = 'precision' THEN 'interval low' ELSE 'matches' END AS outcome FROM metrics WHERE kind = 'ESTIMATED'
        UNION ALL SELECT 'none', 'no artifact' UNION ALL SELECT 'en gone', 'no field'""",
    ),
    "ud08_canary": (
        _canary,
        f"""WITH {SCORED}, a AS (SELECT DISTINCT question_id FROM scored), c AS (SELECT question_id, count(*) AS n, count(*) FILTER (score >= {TAU}) AS k FROM scored WHERE label = 1 AND hard = 1 GROUP BY 1)
        SELECT a.question_id, coalesce(n, 0) AS canaries, CASE WHEN n > 0 THEN CAST(k AS DOUBLE) / n ELSE 0 END AS recall, coalesce(n > 0 AND k = n, false) AS passed FROM a LEFT JOIN c ON c.question_id = a.question_id""",
    ),
    "th17_pilot_ladder": (
        _pilot,
        f"""WITH {block_sql()}, w AS (SELECT eval_set_id, count(DISTINCT CASE WHEN label = 1 THEN question_id END) AS wrong_questions, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr FROM scored GROUP BY 1),
        l AS (SELECT s, {quantile_sql(LOW)} AS ci_low FROM ar GROUP BY 1), x AS (SELECT w.*, ci_low, iqr / nullif((SELECT iqr FROM w WHERE eval_set_id = 'en'), 0) AS ratio FROM w LEFT JOIN l ON l.s = w.eval_set_id),
        b AS (SELECT *, CASE WHEN wrong_questions NOT BETWEEN {BAND[0]} AND {BAND[1]} THEN 'construction_defect' WHEN ratio < {SATURATION} THEN 'saturation' WHEN ci_low < {MIN_AUROC_LOW} THEN 'probe_does_not_transfer' ELSE 'clears' END AS branch FROM x)
        SELECT eval_set_id, wrong_questions, round(ratio, 6) AS iqr_ratio, round(ci_low, 9) AS auroc_low, branch, branch = 'saturation' AS consumes_retry FROM b""",
    ),
    "sf19_render": (
        lambda s, d: _block(s, d).where("kind = 'ESTIMATED'").select(*KEYS, "metric", F.format_string("%.2f [%.2f, %.2f] (95%% CI, n=%d)", *(F.bround(c, 2) for c in ("value", "ci_low", "ci_high")), "n").alias("text")),
        f"WITH {block_sql()} SELECT s AS eval_set_id, metric, printf('%.2f [%.2f, %.2f] (95%% CI, n=%d)', round_even(value, 2), round_even(ci_low, 2), round_even(ci_high, 2), n) AS text FROM metrics WHERE kind = 'ESTIMATED'",
    ),
}
