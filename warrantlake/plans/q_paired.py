"""Two models on what both held out, in both threshold regimes, at 2000 draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warrantlake.functions.rng import draw_sql, uniform
from warrantlake.operators import paired as P
from warrantlake.operators import splits as S
from warrantlake.sources.views import SCORED, scored_items

KEYS, DRAWS, LEAST, BUDGETS, FRACTIONS = ["eval_set_id"], 2000, 18, [0.05, 0.2], (0.25, 0.1, 0.65)


def _items(s: SparkSession, d: str) -> DataFrame:
    """Scored items with the score as baseline, a blurred one as variant, and clusters of questions."""
    x = scored_items(s, d)
    cluster = F.concat_ws("|", "question_id", (F.col("item_id") % 20).cast("string"))
    return x.select("eval_set_id", "item_id", cluster.alias("cluster"), "label", F.col("score").alias("baseline"), (F.col("score") * (0.5 + uniform(F.lit("blur"), "item_id"))).alias("variant"))


def _splits(items: DataFrame, seed: str) -> DataFrame:
    return S.by_group(items.select("eval_set_id", "item_id"), "item_id", seed, FRACTIONS, ["eval_set_id"])


def _rounded(df: DataFrame, *exact: str) -> DataFrame:
    return df.select(*(F.col(c) if c in exact or t != "double" else F.round(c, 9).alias(c) for c, t in df.dtypes))


def _compared(s: SparkSession, d: str) -> DataFrame:
    items = _items(s, d)
    return _rounded(P.compare_models(items, _splits(items, "old"), _splits(items, "new"), KEYS, "item_id", "cluster", BUDGETS, DRAWS, "regimes", LEAST))


def _cuts(s: SparkSession, d: str) -> DataFrame:
    """Both models' thresholds for each budget, each fitted on its own training split."""
    items = _items(s, d)
    own = lambda seed, model: items.join(_splits(items, seed).where("split = 'train'").select("eval_set_id", "item_id"), ["eval_set_id", "item_id"], "left_semi").select(*KEYS, F.col(model).alias("baseline"), F.col(model).alias("variant"), "label")
    a = P.thresholds(own("old", "baseline"), KEYS, BUDGETS).select(*KEYS, "budget", "baseline")
    return a.join(P.thresholds(own("new", "variant"), KEYS, BUDGETS).select(*KEYS, "budget", "variant"), [*KEYS, "budget"], "full")


def _rank(seed: str) -> str:
    return f"row_number() OVER (PARTITION BY eval_set_id ORDER BY {draw_sql(f"'{seed}'", 'item_id')}, item_id)"


def _part(r: str) -> str:
    return f"CASE WHEN {r} <= floor(n * {FRACTIONS[0]}::DOUBLE + 0.5) THEN 'train' WHEN {r} <= floor(n * {FRACTIONS[0] + FRACTIONS[1]!r}::DOUBLE + 0.5) THEN 'validation' ELSE 'test' END"


_ITEMS = f"""{SCORED}, it AS (SELECT eval_set_id, item_id, question_id || '|' || CAST(item_id % 20 AS VARCHAR) AS cluster, label, score AS baseline, score * (0.5::DOUBLE + {draw_sql("'blur'", "item_id")} / 4503599627370496::DOUBLE) AS variant FROM scored),
rk AS (SELECT *, {_rank("old")} AS r1, {_rank("new")} AS r2, count(*) OVER (PARTITION BY eval_set_id) AS n FROM it), sp AS (SELECT *, {_part("r1")} AS was, {_part("r2")} AS now FROM rk)"""
_VALUES = ", ".join(f"({b}::DOUBLE)" for b in BUDGETS)
_TOLD = "quantile_cont(v, 0.025::DOUBLE) AS lo, quantile_cont(v, 0.975::DOUBLE) AS hi, stddev_samp(v) AS se"

_COMPARED = f"""WITH {_ITEMS}, rel AS (SELECT eval_set_id, count(*) FILTER (was = 'test' AND now = 'test') AS n_paired FROM sp GROUP BY 1),
pd AS (SELECT sp.* FROM sp JOIN rel ON rel.eval_set_id = sp.eval_set_id WHERE was = 'test' AND now = 'test' AND n_paired >= {LEAST}),
lg AS (SELECT eval_set_id, 'baseline' AS model, baseline AS score FROM it UNION ALL SELECT eval_set_id, 'variant', variant FROM it),
ft AS (SELECT eval_set_id, model, score, sum(count(*)) OVER (PARTITION BY eval_set_id, model ORDER BY score DESC) AS upto, sum(count(*)) OVER (PARTITION BY eval_set_id, model) AS n FROM lg GROUP BY 1, 2, 3),
cuts AS (SELECT eval_set_id, budget, min(score) FILTER (model = 'baseline' AND CAST(upto AS DOUBLE) / n <= budget) AS tb, min(score) FILTER (model = 'variant' AND CAST(upto AS DOUBLE) / n <= budget) AS tv FROM ft, (VALUES {_VALUES}) b(budget) GROUP BY 1, 2),
cnt AS (SELECT p.eval_set_id, cluster, regime, budget, count(*) AS p, count(*) FILTER (baseline >= tb) AS a, count(*) FILTER (variant >= CASE regime WHEN 'pinned' THEN tb ELSE tv END) AS b
  FROM pd p JOIN cuts c ON c.eval_set_id = p.eval_set_id, (VALUES ('pinned'), ('own')) r(regime) WHERE label = 1 GROUP BY 1, 2, 3, 4),
grp AS (SELECT eval_set_id, cluster, row_number() OVER (PARTITION BY eval_set_id ORDER BY {draw_sql("'g'", "cluster")}, cluster) - 1 AS g, count(*) OVER (PARTITION BY eval_set_id) AS groups FROM (SELECT DISTINCT eval_set_id, cluster FROM pd)),
dr AS (SELECT eval_set_id, groups, rep, unnest(range(0, groups)) AS i FROM (SELECT *, unnest(range(0, {DRAWS})) AS rep FROM (SELECT DISTINCT eval_set_id, groups FROM grp))),
dw AS (SELECT d.eval_set_id, rep, d.g, cluster, count(*) AS t FROM (SELECT eval_set_id, rep, {draw_sql("'regimes'", "rep", "i")} % groups AS g FROM dr) d JOIN grp ON grp.eval_set_id = d.eval_set_id AND grp.g = d.g GROUP BY 1, 2, 3, 4),
ro AS (SELECT eval_set_id, regime, 'recall@' || CAST(budget AS VARCHAR) AS quantity, CAST(sum(a) AS DOUBLE) / nullif(sum(p), 0) AS baseline, CAST(sum(b) AS DOUBLE) / nullif(sum(p), 0) AS variant FROM cnt GROUP BY 1, 2, 3),
rv AS (SELECT c.eval_set_id, regime, 'recall@' || CAST(budget AS VARCHAR) AS quantity, rep, CAST(sum(b * t) AS DOUBLE) / nullif(sum(p * t), 0) - CAST(sum(a * t) AS DOUBLE) / nullif(sum(p * t), 0) AS v FROM dw JOIN cnt c ON c.eval_set_id = dw.eval_set_id AND c.cluster = dw.cluster GROUP BY 1, 2, 3, 4),
pl AS (SELECT eval_set_id, cluster, label, 'baseline' AS model, baseline AS score FROM pd UNION ALL SELECT eval_set_id, cluster, label, 'variant', variant FROM pd),
gr AS (SELECT eval_set_id, cluster, model, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM pl GROUP BY 1, 2, 3, 4),
ow AS (SELECT *, pos * (2 * sum(neg) OVER (PARTITION BY eval_set_id, model ORDER BY score) - neg) AS won FROM (SELECT eval_set_id, model, score, sum(pos) AS pos, sum(neg) AS neg FROM gr GROUP BY 1, 2, 3)),
oa AS (SELECT eval_set_id, model, CAST(sum(won) AS DOUBLE) / nullif(2 * sum(pos) * sum(neg), 0) AS v FROM ow GROUP BY 1, 2),
ao AS (SELECT eval_set_id, max(v) FILTER (model = 'baseline') AS baseline, max(v) FILTER (model = 'variant') AS variant FROM oa GROUP BY 1),
mt AS (SELECT g.eval_set_id, model, rep, score, sum(pos * t) AS pos, sum(neg * t) AS neg FROM dw JOIN gr g ON g.eval_set_id = dw.eval_set_id AND g.cluster = dw.cluster GROUP BY 1, 2, 3, 4),
wn AS (SELECT *, pos * (2 * sum(neg) OVER (PARTITION BY eval_set_id, model, rep ORDER BY score) - neg) AS won FROM mt),
av AS (SELECT eval_set_id, rep, max(v) FILTER (model = 'variant') - max(v) FILTER (model = 'baseline') AS v FROM (SELECT eval_set_id, model, rep, CAST(sum(won) AS DOUBLE) / nullif(2 * sum(pos) * sum(neg), 0) AS v FROM wn GROUP BY 1, 2, 3) GROUP BY 1, 2),
s AS (SELECT o.eval_set_id, o.regime, o.quantity, baseline, variant, lo, hi, se FROM ro o JOIN (SELECT eval_set_id, regime, quantity, {_TOLD} FROM rv GROUP BY 1, 2, 3) q ON q.eval_set_id = o.eval_set_id AND q.regime = o.regime AND q.quantity = o.quantity
  UNION ALL SELECT o.eval_set_id, regime, 'auroc', baseline, variant, lo, hi, se FROM ao o JOIN (SELECT eval_set_id, {_TOLD} FROM av GROUP BY 1) q ON q.eval_set_id = o.eval_set_id, (VALUES ('pinned'), ('own')) r(regime))
SELECT s.eval_set_id, regime, quantity, round(baseline, 9) AS baseline, round(variant, 9) AS variant, round(variant - baseline, 9) AS difference, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high, round(se, 9) AS standard_error, round((1.96 + 0.8416)::DOUBLE * se, 9) AS minimum_detectable, n_paired,
  CASE WHEN lo > 0 OR hi < 0 THEN 'difference' WHEN (1.96 + 0.8416)::DOUBLE * se <= {P.BOUND} THEN 'bounded' ELSE 'UNDERPOWERED' END AS verdict FROM s JOIN rel ON rel.eval_set_id = s.eval_set_id
UNION ALL SELECT eval_set_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, n_paired, 'REFUSED' FROM rel WHERE n_paired < {LEAST}"""


def _own(seed: str, score: str) -> str:
    return f"""(SELECT eval_set_id, budget, min(score) FILTER (CAST(upto AS DOUBLE) / n <= budget) AS t FROM (SELECT eval_set_id, {score} AS score, sum(count(*)) OVER (PARTITION BY eval_set_id ORDER BY {score} DESC) AS upto, sum(count(*)) OVER (PARTITION BY eval_set_id) AS n
      FROM sp WHERE {seed} = 'train' GROUP BY 1, 2), (VALUES {_VALUES}) b(budget) GROUP BY 1, 2)"""


QUERIES = {
    "st10_paired_regimes": (_compared, _COMPARED),
    "df03_model_thresholds": (_cuts, f"WITH {_ITEMS} SELECT a.eval_set_id, a.budget, a.t AS baseline, b.t AS variant FROM {_own('was', 'baseline')} a JOIN {_own('now', 'variant')} b ON b.eval_set_id = a.eval_set_id AND b.budget = a.budget"),
}
