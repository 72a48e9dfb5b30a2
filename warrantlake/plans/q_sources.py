"""Split tables and scoring logs that are written and read back, label categories, sweeps, and overrides by their body."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warrantlake.functions.rng import draw_sql
from warrantlake.operators import categories as K
from warrantlake.operators import ledger as L
from warrantlake.operators import splits as S
from warrantlake.operators import thresholds as H
from warrantlake.operators import validation as V
from warrantlake.plans.q_paired import _part
from warrantlake.plans.q_validate import _parts
from warrantlake.sources import scorings as G
from warrantlake.sources import splits as P
from warrantlake.sources.shared import fresh_path
from warrantlake.sources.views import SCORED, TRAFFIC, scored_items, table, traffic

FRACTIONS, BUDGETS = (0.25, 0.1, 0.65), [0.05, 0.1, 0.2]


def _splits(s: SparkSession, d: str) -> DataFrame:
    """Splits of scored items by their text's id, written, read back and asserted; half of the items have no aliases."""
    items = scored_items(s, d).select("item_id", F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("group"), F.when(F.col("item_id") % 2 == 0, F.array("question_id")).alias("aliases"))
    path = fresh_path(s, "splits")
    P.save(S.by_group(items, "group", "io17", FRACTIONS), path)
    return P.load(s, path).select("item_id", "split", F.size("aliases").alias("n_aliases"))


def _scorings(s: SparkSession, d: str) -> DataFrame:
    """Events as scorings of their user's set: those of the first half-month start the log, the others are appended."""
    e = traffic(s, d).select(F.col("user_id").cast("string").alias("test_set"), F.col("event_id").cast("string").alias("record"), "ts", "event_id", "live")
    path, lead = fresh_path(s, "scorings"), F.unix_micros(F.col("ts").cast("timestamp"))
    G.append(e.where("not live"), path, lead, ["ts", "event_id"], first=True)
    G.append(e.where("live"), path, lead, ["ts", "event_id"])
    log = G.read(s, path)
    return log.join(G.counts(log), "test_set").select("test_set", "scoring", "record", "n_scorings")


def _categories(s: SparkSession, d: str) -> DataFrame:
    """Detectors named by language against sources, some of them stand-ins; the last sources declare nothing."""
    docs = table(s, d, "documents")
    number = F.substring("source", 4, 9).cast("int")
    meaning = F.when(number % 3 == 0, "toxicity").when(number % 3 == 1, "identifier")
    declared = docs.where(number < 15).select(F.col("source").alias("eval_set_id"), meaning.alias("category")).distinct()
    suffix = F.when(F.col("lang") == "en", "").when(F.col("lang") == "de", "-synthetic").when(F.col("lang") == "fr", "-fixture").otherwise("-fixture-synthetic")
    pairs = docs.where("lang is not null").select(F.concat("source", suffix).alias("eval_set_id"), F.when(F.col("doc_id") % 3 == 0, "toxicity").when(F.col("doc_id") % 3 == 1, "identifier").alias("detector_category"))
    return K.compatible(pairs, declared).groupBy("eval_set_id", "detector_category", "category", "outcome").agg(F.count("*").alias("n"))


def _probe_scores(s: SparkSession, d: str) -> DataFrame:
    return H.probe_score(H.within_budgets(scored_items(s, d), ["eval_set_id"], BUDGETS), ["eval_set_id"]).withColumn("probe_score", F.round("probe_score", 9))


def _swept(s: SparkSession, d: str) -> DataFrame:
    """A layer is a block of sixteen components."""
    train, validation = _parts(s, d)
    rows = V.sweep(train, validation, {i: F.slice("vec", 1 + 16 * i, 16) for i in range(4)})
    best = V.best_setting(rows)
    return s.createDataFrame([(*r[:2], None if r[2] is None else round(r[2], 9), r == best) for r in rows], "layer int, c double, auroc double, best boolean")


def _pivoted(s: SparkSession, d: str) -> DataFrame:
    names = {c: f"c_{c:g}".replace(".", "_").replace("-", "m") for c in V.GRID}
    named = F.coalesce(*(F.when(F.col("c") == c, name) for c, name in names.items()))
    return _swept(s, d).withColumn("c", named).groupBy("layer").pivot("c", list(names.values())).agg(F.first("auroc"))


def _overrides(s: SparkSession, d: str) -> DataFrame:
    """A third of all orders override their customer's certificate; every seventh body names none."""
    o = table(s, d, "orders")
    named = F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("C-"), F.col("o_custkey").cast("string")))
    body = F.to_json(F.struct(named.alias("certificate_id"), F.col("o_orderstatus").alias("direction")))
    records = o.select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, "override").otherwise("certificate").alias("kind"), body.alias("body"))
    certificates = table(s, d, "customer").where("c_custkey % 5 <> 0").select(F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("certificate_id"), "c_mktsegment")
    return L.overrides_of(records, certificates).select("certificate_id", "seq", "c_mktsegment", F.get_json_object("body", "$.direction").alias("direction"))


_STAND_IN = "CASE lang WHEN 'en' THEN '' WHEN 'de' THEN '-synthetic' WHEN 'fr' THEN '-fixture' ELSE '-fixture-synthetic' END"
_OF = lambda c: f"CASE {c} % 3 WHEN 0 THEN 'toxicity' WHEN 1 THEN 'identifier' END"

QUERIES = {
    "io17_splits": (
        _splits,
        f"WITH {SCORED}, rk AS (SELECT item_id, row_number() OVER (ORDER BY {draw_sql("'io17'", "'q' || CAST(item_id AS VARCHAR)")}, 'q' || CAST(item_id AS VARCHAR)) AS r, count(*) OVER () AS n FROM scored) SELECT item_id, {_part('r')} AS split, CAST(1 - item_id % 2 AS INTEGER) AS n_aliases FROM rk",
    ),
    "io21_scoring_log": (
        _scorings,
        f"WITH {TRAFFIC} SELECT CAST(user_id AS VARCHAR) AS test_set, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS scoring, CAST(event_id AS VARCHAR) AS record, count(*) OVER (PARTITION BY user_id) AS n_scorings FROM traffic",
    ),
    "pf13_label_category": (
        _categories,
        f"""WITH p AS (SELECT CAST(substr(source, 4) AS INTEGER) AS k, source || {_STAND_IN} AS eval_set_id, {_OF('doc_id')} AS detector_category FROM documents WHERE lang IS NOT NULL), c AS (SELECT *, CASE WHEN k < 15 THEN {_OF('k')} END AS category FROM p)
        SELECT eval_set_id, detector_category, category, CASE WHEN k >= 15 THEN 'undeclared' WHEN detector_category <> category THEN 'mismatch' ELSE 'compatible' END AS outcome, count(*) AS n FROM c GROUP BY ALL""",
    ),
    "th20_probe_score": (
        _probe_scores,
        f"""WITH {SCORED}, g AS (SELECT eval_set_id, score, sum(count(*)) OVER (PARTITION BY eval_set_id ORDER BY score DESC) AS upto, sum(count(*)) OVER (PARTITION BY eval_set_id) AS n FROM scored GROUP BY 1, 2),
        t AS (SELECT eval_set_id, budget, min(score) FILTER (CAST(upto AS DOUBLE) / n <= budget) AS x FROM g, (VALUES {", ".join(f"({b}::DOUBLE)" for b in BUDGETS)}) b(budget) GROUP BY 1, 2),
        l AS (SELECT eval_set_id, list_reverse_sort(list(x) FILTER (x IS NOT NULL)) AS v FROM t GROUP BY 1), q AS (SELECT *, CASE WHEN coalesce(len(v), 0) < 2 THEN 'fewer than two thresholds' WHEN v[1] = v[2] THEN 'the two highest thresholds are equal' END AS problem FROM l)
        SELECT eval_set_id, CASE WHEN problem IS NULL THEN round((v[1] + v[2]) / 2, 9) END AS probe_score, problem FROM q""",
    ),
    "tk03_best_setting": (_swept, None),
    "ag24_auroc_pivot": (_pivoted, None),
    "jn07_overrides_of_certificate": (
        _overrides,
        "SELECT 'C-' || CAST(o_custkey AS VARCHAR) AS certificate_id, o_orderkey AS seq, c_mktsegment, o_orderstatus AS direction FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 AND c_custkey % 5 <> 0",
    ),
}
