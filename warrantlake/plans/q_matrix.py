"""Matrix, routing and policy queries over warrants made of line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from warrantlake.operators import matrix as X
from warrantlake.operators.metrics import ratio
from warrantlake.sources.views import WARRANTS, warrant_facts

NOW, DAYS, N, RECALL, FPR = "1998-11-01", 900, 3, 0.15, 0.75
KEY = ["detector_id", "operating_point_id", "envelope_id"]


def _w(bound: str, k: str) -> str:
    z = "1.959963984540054::DOUBLE"
    return f"((CAST({k} AS DOUBLE) / n + {z} * {z} / (2 * n) {bound} {z} * sqrt(CAST({k} AS DOUBLE) / n * (1 - CAST({k} AS DOUBLE) / n) / n + {z} * {z} / (4 * n * n))) / (1 + {z} * {z} / n))"


ISSUED = f"""{WARRANTS}, bounds AS (SELECT *, CAST(hits AS DOUBLE) / n AS recall, {_w("-", "hits")} AS recall_low, {_w("+", "hits")} AS recall_high, {_w("+", "false_flags")} AS fpr_high FROM warrants),
issued AS (SELECT *, list_filter([CASE WHEN n < {N} THEN 'too few items' END, CASE WHEN recall_low < {RECALL} THEN 'recall bound below minimum' END, CASE WHEN fpr_high > {FPR} THEN 'false-positive bound above ceiling' END], lambda x: x IS NOT NULL) AS reasons FROM bounds),
st AS (SELECT *, CASE WHEN len(reasons) = 0 THEN 'VALID' ELSE 'REFUSED' END AS first_status FROM issued),
cells AS (SELECT * EXCLUDE (first_status), CASE WHEN first_status = 'VALID' AND TIMESTAMP '{NOW}' >= issued_at + INTERVAL {DAYS} DAY THEN 'STALE' ELSE first_status END AS status FROM st),
op AS (SELECT detector_id, min(operating_point_id) AS operating_point_id FROM cells GROUP BY 1),
one AS (SELECT c.* FROM cells c JOIN op ON op.detector_id = c.detector_id AND op.operating_point_id = c.operating_point_id),
axes AS (SELECT detector_id, envelope_id FROM (SELECT DISTINCT detector_id FROM cells), (SELECT DISTINCT envelope_id FROM cells)),
full_m AS (SELECT a.detector_id, a.envelope_id, operating_point_id, coalesce(status, 'UNVALIDATED') AS status FROM axes a LEFT JOIN one o ON o.detector_id = a.detector_id AND o.envelope_id = a.envelope_id)"""


def _issued(s, d):
    return X.issue(warrant_facts(s, d), least_n=N, min_recall=RECALL, max_fpr=FPR)


def _cells(s, d):
    return X.cell_status(_issued(s, d), NOW, DAYS)


def _full(s, d):
    cells = _cells(s, d)
    return X.full_matrix(X.first_operating_point(cells).select(*KEY, "status"), cells, cells)


def _summary(s, d):
    names = s.createDataFrame([(x,) for x in X.STATUSES], "status string")
    return names.join(_full(s, d).groupBy("status").agg(F.count("*").alias("c")), "status", "left").select("status", F.coalesce("c", F.lit(0)).alias("cells"))


def _requirements(s, d):
    """Two requirements for each supplier nation's bundle."""
    sup = s.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("B"), F.col("s_nationkey").cast("string")).alias("bundle"), F.concat(F.lit("D"), F.col("s_suppkey").cast("string")).alias("detector_id"), (F.col("s_suppkey") % 7).alias("y"))
    return sup.select("bundle", "detector_id", F.lit("P-A").alias("operating_point_id"), F.concat(F.lit("E"), (1992 + F.col("y")).cast("string"), F.lit("-0"), (1 + F.col("y")).cast("string")).alias("envelope_id")).distinct()


_REQ = "req AS (SELECT DISTINCT 'B' || CAST(s_nationkey AS VARCHAR) AS bundle, 'D' || CAST(s_suppkey AS VARCHAR) AS detector_id, 'P-A' AS operating_point_id, 'E' || CAST(1992 + s_suppkey % 7 AS VARCHAR) || '-0' || CAST(1 + s_suppkey % 7 AS VARCHAR) AS envelope_id FROM supplier)"


def _resolved(s, d):
    x = _requirements(s, d).join(_cells(s, d).select(*KEY, "status", "recall_low", "fpr_high", "n"), KEY, "left")
    fails = F.array_compact(
        F.array(
            F.when(F.col("status").isNull(), "absent").when(F.col("status") != "VALID", F.concat(F.lit("status "), F.col("status"))),
            F.when(F.col("recall_low") < 0.2, "recall"),
            F.when(F.coalesce(F.col("fpr_high"), F.lit(1.0)) > 0.7, "fpr"),
            F.when(F.col("n") < 5, "power"),
        )
    )
    return x.withColumn("fails", fails)


_RESOLVED = f"""{ISSUED}, {_REQ}, j AS (SELECT r.*, c.status, c.recall_low, c.fpr_high, c.n FROM req r LEFT JOIN cells c ON c.detector_id = r.detector_id AND c.operating_point_id = r.operating_point_id AND c.envelope_id = r.envelope_id),
res AS (SELECT *, list_filter([CASE WHEN status IS NULL THEN 'absent' WHEN status <> 'VALID' THEN 'status ' || status END, CASE WHEN recall_low < 0.2 THEN 'recall' END, CASE WHEN coalesce(fpr_high, 1.0) > 0.7 THEN 'fpr' END, CASE WHEN n < 5 THEN 'power' END], lambda x: x IS NOT NULL) AS fails FROM j)"""


def _verdicts(s, d):
    """One verdict per turn of a conversation: detector by role, status and firing by its text's length."""
    c = s.read.parquet(f"{d}/conversations.parquet")
    n = F.length("text")
    return c.select("conv_id", "turn", F.when(n % 4 == 0, "STALE").otherwise("VALID").alias("status"), (n % 3 == 0).alias("fired"), F.get(F.array(*[F.lit(a) for a in X.ACTIONS]), (n % 5).cast("int")).alias("action"))


_VERDICTS = "ver AS (SELECT conv_id, turn, CASE WHEN length(text) % 4 = 0 THEN 'STALE' ELSE 'VALID' END AS status, length(text) % 3 = 0 AS fired, length(text) % 5 + 1 AS r FROM conversations)"
_ACTION_LIST = "['ALLOW', 'REDACT', 'CONFIRM', 'ESCALATE', 'BLOCK']"


def _rules(s, d):
    c = s.read.parquet(f"{d}/conversations.parquet").withColumn("n", F.length("text"))
    rules = [(100, (F.col("n") % 11 == 0), "BLOCK"), (60, F.col("text").rlike("[0-9]{3}"), "REDACT"), (55, F.col("n") > 400, "ESCALATE"), (50, F.col("role") == "system", "CONFIRM")]
    return X.decide(c, rules, ["conv_id", "turn"])


def _profiles(s, d):
    """One request under three profiles: actions by budget, and how many differ."""
    c = s.read.parquet(f"{d}/conversations.parquet").withColumn("score", (F.length("text") % 100) / 100.0)
    p = F.explode(F.array(*[F.struct(F.lit(n).alias("profile"), F.lit(t).alias("threshold"), F.lit(a).alias("act")) for n, t, a in (("strict", 0.3, "BLOCK"), ("internal", 0.6, "REDACT"), ("support", 0.9, "ESCALATE"))]))
    x = c.select("conv_id", "turn", "score", p.alias("p")).withColumn("action", F.when(F.col("score") >= F.col("p.threshold"), F.col("p.act")).otherwise("ALLOW"))
    return x.groupBy("conv_id", "turn").agg(F.count_distinct("action").alias("distinct_actions"))


def _invalidate(s, d):
    """Warrants against the pinned model of their detector: other or no pin revokes, refused stay."""
    pins = s.read.parquet(f"{d}/supplier.parquet").groupBy(F.concat(F.lit("D"), F.col("s_suppkey").cast("string")).alias("detector_id")).agg(F.min("s_nationkey").alias("pin"))
    x = _cells(s, d).join(pins, "detector_id", "left")
    live = 0
    status = F.when(F.col("status") == "REFUSED", "REFUSED").when(~F.col("pin").eqNullSafe(F.lit(live)), "REVOKED").otherwise(F.col("status"))
    return x.select(*KEY, "status", status.alias("after"), F.when(F.col("status") == "REFUSED", "refused already").when(F.col("pin").isNull(), "no pinned model").when(F.col("pin") != live, "another model").otherwise("unchanged").alias("reason"))


def _overlaps(s, d):
    """Warrants of one detector and envelope whose recall intervals overlap, each pair once."""
    c = _cells(s, d).select(*KEY, "recall_low", "recall_high")
    a, b = c.alias("a"), c.alias("b")
    on = (F.col("a.detector_id") == F.col("b.detector_id")) & (F.col("a.envelope_id") == F.col("b.envelope_id")) & (F.col("a.operating_point_id") < F.col("b.operating_point_id"))
    return a.join(b, on).select(F.col("a.detector_id").alias("detector_id"), F.col("a.envelope_id").alias("envelope_id"), F.col("a.operating_point_id").alias("one"), F.col("b.operating_point_id").alias("other"), ((F.col("a.recall_high") >= F.col("b.recall_low")) & (F.col("b.recall_high") >= F.col("a.recall_low"))).alias("overlap"))


def _diff(s, d):
    """Committed rates against recomputed ones: a full join with tolerant equality."""
    facts = warrant_facts(s, d)
    committed = facts.where("n % 11 <> 1").select(*KEY, (ratio(F.col("hits"), F.col("n")) + F.when(F.col("n") % 13 == 0, 1e-6).otherwise(0.0)).alias("was"))
    again = facts.where("n % 17 <> 1").select(*KEY, ratio(F.col("hits"), F.col("n")).alias("now"))
    x = committed.join(again, KEY, "full")
    same = F.abs(F.col("was") - F.col("now")) <= F.greatest(1e-12 * F.greatest(F.abs("was"), F.abs("now")), F.lit(1e-15))
    return x.select(*KEY, F.when(F.col("was").isNull(), "only now").when(F.col("now").isNull(), "only committed").when(same, "agrees").otherwise("differs").alias("outcome"))


_SEL = ", ".join(KEY)


def _tiers(s, d):
    """The access tier of each detector."""
    return s.read.parquet(f"{d}/supplier.parquet").groupBy(F.concat(F.lit("D"), F.col("s_suppkey").cast("string")).alias("detector_id")).agg((F.min("s_nationkey") % 3).alias("tier"))


QUERIES = {
    "sr14_issue": (lambda s, d: _issued(s, d).select(*KEY, F.round("recall_low", 9).alias("recall_low"), F.concat_ws("; ", "reasons").alias("reasons"), "status"), f"WITH {ISSUED} SELECT {_SEL}, round(recall_low, 9) AS recall_low, array_to_string(reasons, '; ') AS reasons, first_status AS status FROM st"),
    "df01_cell_status": (lambda s, d: _cells(s, d).select(*KEY, "status"), f"WITH {ISSUED} SELECT {_SEL}, status FROM cells"),
    "jn03_matrix_summary": (_summary, f"WITH {ISSUED}, names AS (SELECT unnest(['REFUSED', 'REVOKED', 'UNVALIDATED', 'STALE', 'VALID']) AS status) SELECT n.status, count(f.status) AS cells FROM names n LEFT JOIN full_m f ON f.status = n.status GROUP BY 1"),
    "jn03_full_matrix": (lambda s, d: _full(s, d).select("detector_id", "envelope_id", "operating_point_id", "status"), f"WITH {ISSUED} SELECT * FROM full_m"),
    "jn04_unvalidated": (
        lambda s, d: _cells(s, d).select("detector_id").distinct().join(_cells(s, d).where("envelope_id = 'E2001-11'"), "detector_id", "left_anti"),
        f"WITH {ISSUED} SELECT DISTINCT detector_id FROM cells c WHERE NOT EXISTS (SELECT 1 FROM cells x WHERE x.detector_id = c.detector_id AND x.envelope_id = 'E2001-11')",
    ),
    "jn05_cell_lookup": (lambda s, d: _requirements(s, d).join(_cells(s, d).select(*KEY, "status"), KEY, "left").select("bundle", *KEY, F.coalesce("status", F.lit("UNVALIDATED")).alias("status")), f"WITH {_RESOLVED} SELECT bundle, {_SEL}, coalesce(status, 'UNVALIDATED') AS status FROM j"),
    "jn06_resolve_bundle": (
        lambda s, d: _resolved(s, d).groupBy("bundle").agg(F.count("*").alias("requirements"), (F.sum(F.size("fails")) == 0).alias("usable"), F.sum(F.size("fails")).alias("failures")),
        f"WITH {_RESOLVED} SELECT bundle, count(*) AS requirements, sum(len(fails)) = 0 AS usable, CAST(sum(len(fails)) AS BIGINT) AS failures FROM res GROUP BY 1",
    ),
    "sr13_load_checks": (lambda s, d: _resolved(s, d).select("bundle", *KEY, F.concat_ws("; ", "fails").alias("fails")), f"WITH {_RESOLVED} SELECT bundle, {_SEL}, array_to_string(fails, '; ') AS fails FROM res"),
    "jn10_interval_overlap": (_overlaps, f"WITH {ISSUED} SELECT a.detector_id, a.envelope_id, a.operating_point_id AS one, b.operating_point_id AS other, a.recall_high >= b.recall_low AND b.recall_high >= a.recall_low AS overlap FROM cells a JOIN cells b ON a.detector_id = b.detector_id AND a.envelope_id = b.envelope_id AND a.operating_point_id < b.operating_point_id"),
    "jn12_model_change": (
        _invalidate,
        f"""WITH {ISSUED}, pins AS (SELECT 'D' || CAST(s_suppkey AS VARCHAR) AS detector_id, min(s_nationkey) AS pin FROM supplier GROUP BY 1)
        SELECT c.detector_id, operating_point_id, envelope_id, status, CASE WHEN status = 'REFUSED' THEN 'REFUSED' WHEN pin IS DISTINCT FROM 0 THEN 'REVOKED' ELSE status END AS after,
        CASE WHEN status = 'REFUSED' THEN 'refused already' WHEN pin IS NULL THEN 'no pinned model' WHEN pin <> 0 THEN 'another model' ELSE 'unchanged' END AS reason FROM cells c LEFT JOIN pins p ON p.detector_id = c.detector_id""",
    ),
    "jn14_metric_diff": (
        _diff,
        f"""WITH {WARRANTS}, a AS (SELECT {_SEL}, CAST(hits AS DOUBLE) / n + CASE WHEN n % 13 = 0 THEN 1e-6::DOUBLE ELSE 0::DOUBLE END AS was FROM warrants WHERE n % 11 <> 1), b AS (SELECT {_SEL}, CAST(hits AS DOUBLE) / n AS now FROM warrants WHERE n % 17 <> 1)
        SELECT {_SEL}, CASE WHEN was IS NULL THEN 'only now' WHEN now IS NULL THEN 'only committed' WHEN abs(was - now) <= greatest(1e-12::DOUBLE * greatest(abs(was), abs(now)), 1e-15::DOUBLE) THEN 'agrees' ELSE 'differs' END AS outcome FROM a FULL JOIN b USING ({_SEL})""",
    ),
    "pf04_valid_warrants": (lambda s, d: _cells(s, d).where("envelope_id = 'E1997-03' and status = 'VALID'").select(*KEY), f"WITH {ISSUED} SELECT {_SEL} FROM cells WHERE envelope_id = 'E1997-03' AND status = 'VALID'"),
    "pf05_envelope_cells": (lambda s, d: _cells(s, d).where("envelope_id = 'E1995-03'").select("detector_id", "operating_point_id", "status"), f"WITH {ISSUED} SELECT detector_id, operating_point_id, status FROM cells WHERE envelope_id = 'E1995-03'"),
    "pf08_profile_accepts": (
        lambda s, d: _cells(s, d).select(*KEY, X.accepts(0.3, 0.5)[0].alias("accepted"), X.accepts(0.3, 0.5)[1].alias("reason")),
        f"WITH {ISSUED} SELECT {_SEL}, NOT (recall_low < 0.3 OR fpr_high > 0.5) AS accepted, CASE WHEN recall_low < 0.3 THEN 'recall bound too low' WHEN fpr_high > 0.5 THEN 'false-positive bound too high' ELSE 'accepted' END AS reason FROM cells",
    ),
    "pf09_warrant_age": (lambda s, d: _cells(s, d).select(*KEY, F.datediff(F.lit(NOW).cast("timestamp"), F.col("issued_at")).cast("long").alias("age_days"), (F.col("status") == "VALID").alias("reliable")), f"WITH {ISSUED} SELECT {_SEL}, date_diff('day', issued_at, TIMESTAMP '{NOW}') AS age_days, status = 'VALID' AS reliable FROM cells"),
    "pf11_claimed_bounds": (
        lambda s, d: _cells(s, d).select(F.explode(F.map_from_arrays(F.array(*[F.concat_ws("|", *KEY, F.lit(n)) for n in ("recall", "fpr")]), F.array(F.round("recall_low", 6), F.round("fpr_high", 6)))).alias("claim", "bound")),
        f"WITH {ISSUED} SELECT detector_id || '|' || operating_point_id || '|' || envelope_id || '|recall' AS claim, round(recall_low, 6) AS bound FROM cells UNION ALL SELECT detector_id || '|' || operating_point_id || '|' || envelope_id || '|fpr', round(fpr_high, 6) FROM cells",
    ),
    "tk01_route": (
        lambda s, d: X.route(_cells(s, d), RECALL, FPR),
        f"""WITH {ISSUED}, e AS (SELECT *, row_number() OVER (PARTITION BY envelope_id ORDER BY CASE WHEN status = 'VALID' AND recall_low >= {RECALL} AND fpr_high <= {FPR} THEN 0 ELSE 1 END, -recall_low, recall_high - recall_low, detector_id, operating_point_id) AS nth,
          count(*) OVER (PARTITION BY envelope_id) AS considered, status = 'VALID' AND recall_low >= {RECALL} AND fpr_high <= {FPR} AS ok FROM cells)
        SELECT envelope_id, considered, CASE WHEN ok THEN detector_id ELSE 'conservative-default' END AS detector_id, CASE WHEN ok THEN operating_point_id END AS operating_point_id FROM e WHERE nth = 1""",
    ),
    "tk06_most_restrictive": (lambda s, d: _verdicts(s, d).groupBy("conv_id").agg(F.max_by("action", X.rank(X.ACTIONS, F.col("action"))).alias("action")), f"WITH {_VERDICTS} SELECT conv_id, {_ACTION_LIST}[max(r)] AS action FROM ver GROUP BY 1"),
    "tk07_weakest_status": (
        lambda s, d: _full(s, d).groupBy("envelope_id").agg(F.min_by("status", X.rank(X.STATUSES, F.col("status"))).alias("weakest")),
        f"WITH {ISSUED} SELECT envelope_id, ['REFUSED', 'REVOKED', 'UNVALIDATED', 'STALE', 'VALID'][min(list_position(['REFUSED', 'REVOKED', 'UNVALIDATED', 'STALE', 'VALID'], status))] AS weakest FROM full_m GROUP BY 1",
    ),
    "sr11_compose": (
        lambda s, d: X.compose(_verdicts(s, d), "conv_id", "CONFIRM"),
        f"""WITH {_VERDICTS}, a AS (SELECT conv_id, count(*) FILTER (status = 'VALID') AS valid, count(*) FILTER (status = 'VALID' AND fired) AS valid_fired, count(*) FILTER (status <> 'VALID' AND fired) AS other_fired, max(r) FILTER (status = 'VALID' AND fired) AS top FROM ver GROUP BY 1)
        SELECT conv_id, valid, valid_fired, other_fired, {_ACTION_LIST}[CASE WHEN valid = 0 THEN 3 WHEN other_fired > 0 THEN greatest(coalesce(top, 1), 3) WHEN valid_fired = 0 THEN 1 ELSE top END] AS action FROM a""",
    ),
    "sr12_rules": (
        _rules,
        r"""WITH h AS (SELECT conv_id, turn, length(text) % 11 = 0 AS a, regexp_matches(text, '[0-9]{3}') AS b, length(text) > 400 AS c, role = 'system' AS e FROM conversations)
        SELECT conv_id, turn, CASE WHEN a THEN 'BLOCK' WHEN b THEN 'REDACT' WHEN c THEN 'ESCALATE' WHEN e THEN 'CONFIRM' ELSE 'ALLOW' END AS action, CAST(a AS BIGINT) + CAST(b AS BIGINT) + CAST(c AS BIGINT) + CAST(e AS BIGINT) AS rules_held FROM h""",
    ),
    "sr19_profile_comparison": (_profiles, "WITH x AS (SELECT conv_id, turn, (length(text) % 100) / 100::DOUBLE AS score FROM conversations), y AS (SELECT conv_id, turn, unnest([CASE WHEN score >= 0.3 THEN 'BLOCK' ELSE 'ALLOW' END, CASE WHEN score >= 0.6 THEN 'REDACT' ELSE 'ALLOW' END, CASE WHEN score >= 0.9 THEN 'ESCALATE' ELSE 'ALLOW' END]) AS a FROM x) SELECT conv_id, turn, count(DISTINCT a) AS distinct_actions FROM y GROUP BY 1, 2"),
    "sr10_overrun": (lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("value") > 80).alias("over_budget"), F.round(F.greatest(F.lit(0.0), F.col("value") - 80), 9).alias("overrun")), "SELECT event_id, value > 80 AS over_budget, round(greatest(0, value - 80), 9) AS overrun FROM events"),
    "df12_warrant_id": (
        lambda s, d: _cells(s, d).select(*KEY, F.concat_ws("|", *KEY).alias("key"), F.concat(F.lit("W-"), F.substring(F.sha2(F.concat_ws("|", *KEY, F.lit("v1")), 256), 1, 16)).alias("warrant_id")),
        f"WITH {ISSUED} SELECT {_SEL}, concat_ws('|', {_SEL}) AS key, 'W-' || substr(sha256(concat_ws('|', {_SEL}, 'v1')), 1, 16) AS warrant_id FROM cells",
    ),
    "df13_status_flags": (lambda s, d: _full(s, d).groupBy("status").agg(F.count("*").alias("cells")).withColumns({"can_be_relied_upon": F.col("status") == "VALID", "was_ever_measured": F.col("status") != "UNVALIDATED"}), f"WITH {ISSUED} SELECT status, count(*) AS cells, status = 'VALID' AS can_be_relied_upon, status <> 'UNVALIDATED' AS was_ever_measured FROM full_m GROUP BY 1"),
    "pf15_measured": (
        lambda s, d: _cells(s, d).select(*KEY, F.when(F.col("operating_point_id") == "P-A", "measured").when(F.col("operating_point_id") == "P-N", "fixture").alias("data_source")).withColumn("measured", F.col("data_source").eqNullSafe(F.lit("measured"))).groupBy("envelope_id", "measured").agg(F.count("*").alias("warrants")),
        f"WITH {ISSUED} SELECT envelope_id, operating_point_id = 'P-A' AS measured, count(*) AS warrants FROM cells GROUP BY 1, 2",
    ),
    "pf16_pinned_tier": (
        lambda s, d: _cells(s, d).join(_tiers(s, d), "detector_id").where("tier = 1").select(*KEY, "status"),
        f"WITH {ISSUED}, t AS (SELECT 'D' || CAST(s_suppkey AS VARCHAR) AS detector_id, min(s_nationkey) % 3 AS tier FROM supplier GROUP BY 1) SELECT c.detector_id, operating_point_id, envelope_id, status FROM cells c JOIN t ON t.detector_id = c.detector_id WHERE tier = 1",
    ),
    "ud14_validation_queue": (
        lambda s, d: _requirements(s, d).join(_cells(s, d).select(*KEY), KEY, "left_anti").select("bundle", *KEY),
        f"WITH {ISSUED}, {_REQ} SELECT bundle, {_SEL} FROM req r WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.detector_id = r.detector_id AND c.operating_point_id = r.operating_point_id AND c.envelope_id = r.envelope_id)",
    ),
}
