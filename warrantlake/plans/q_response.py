"""Responses to drift of each supplier's warrants, watched on one user's events, and certificates of live requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warrantlake.operators import matrix as X
from warrantlake.operators import response as C
from warrantlake.plans.q_matrix import DAYS, ISSUED, NOW, _issued
from warrantlake.plans.q_nullband import last_windows, windows_sql
from warrantlake.plans.q_paired import _rounded
from warrantlake.sources.views import TRAFFIC, table, traffic

POLICY = C.Policy(window=60, min_recall=0.2, max_fpr=0.7)
BUDGET = 80.0


def _watched(s: SparkSession, d: str) -> DataFrame:
    """Issued warrants; detector k serves user k, whose traffic is in an envelope of its own."""
    number = F.substring("detector_id", 2, 18).cast("int")
    live = F.concat(F.lit("E"), (1991 + number % 7).cast("string"), F.lit("-0"), (1 + number % 9).cast("string"))
    aged = X.cell_status(_issued(s, d).select(*C.KEY, *C.BOUNDS, "issued_at", "status"), NOW, DAYS)
    return aged.select(*C.KEY, *C.BOUNDS, F.when(F.col("status") == "STALE", "VALID").otherwise(F.col("status")).alias("status"), (F.col("status") == "STALE").alias("expired"), number.alias("shard"), live.alias("live_envelope_id"))


def _responses(s: SparkSession, d: str, wanted: DataFrame | None = None) -> DataFrame:
    return C.respond(_watched(s, d), last_windows(s, d, F.col("user_id"), POLICY.window), "shard", POLICY, wanted)


def _certificates(s: SparkSession, d: str) -> DataFrame:
    """A live event is a request of its user, served by one of the detector's points on one of five envelopes."""
    e = traffic(s, d).where("live")
    point = F.concat(F.lit("P-"), F.get(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("event_id") % 3).cast("int")))
    month = F.concat(F.lit("E"), (1993 + F.col("event_id") % 5).cast("string"), F.lit("-0"), (1 + F.col("event_id") % 9).cast("string"))
    requests = e.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("session_id"), F.col("ts").alias("decided_at"), F.col("value").alias("elapsed"), F.lit(BUDGET).alias("budget"), F.concat(F.lit("D"), F.col("user_id").cast("string")).alias("detector_id"), point.alias("operating_point_id"), month.alias("envelope_id"))
    return C.certify(requests, _responses(s, d, requests.select(*C.KEY).distinct()), POLICY)


def _flat(df: DataFrame, *lists: str) -> DataFrame:
    return _rounded(df.withColumns({c: F.concat_ws("; ", c) for c in lists}))


_SAY = C.UNCHECKED
_OK = f"recall_low >= {POLICY.min_recall} AND fpr_high <= {POLICY.max_fpr}"
_CLAIM = lambda c, own: f"round(CASE WHEN after IN ('VALID', 'STALE') THEN {own} WHEN after = 'REVOKED' AND o_d IS NOT NULL THEN o_{c} END, 9) AS claimed_{c}"
_WIDE = lambda c: f"recall + ({c} - recall) * CASE WHEN after = 'STALE' THEN {POLICY.widen}::DOUBLE ELSE 1 END"
_RESPONSES = f"""{ISSUED}, {TRAFFIC}, {windows_sql("user_id", POLICY.window)}, fin AS (SELECT * FROM verdict QUALIFY row_number() OVER (PARTITION BY shard ORDER BY ts DESC, event_id DESC) = 1),
wt AS (SELECT i.*, 'E' || CAST(1991 + k % 7 AS VARCHAR) || '-0' || CAST(1 + k % 9 AS VARCHAR) AS live_envelope_id FROM (SELECT st.*, CAST(substr(detector_id, 2) AS INTEGER) AS k, first_status = 'VALID' AND TIMESTAMP '{NOW}' >= issued_at + INTERVAL {DAYS} DAY AS expired FROM st) i),
la AS (SELECT wt.*, first_status AS before, coalesce(f.state, 'INSUFFICIENT_DATA') AS state, f.driver, f.unobserved, coalesce(f.smoothed, false) AS smoothed,
  CASE WHEN first_status = 'REFUSED' OR coalesce(f.state, 'INSUFFICIENT_DATA') = 'INSUFFICIENT_DATA' THEN first_status WHEN f.state = 'INSIDE' THEN 'VALID' WHEN f.state = 'MODERATE' THEN 'STALE' ELSE 'REVOKED' END AS laddered FROM wt LEFT JOIN fin f ON f.shard = k),
mv AS (SELECT *, CASE WHEN expired AND laddered = 'VALID' THEN 'STALE' ELSE laddered END AS after FROM la),
ax AS (SELECT envelope_id AS e, count(*) AS considered FROM mv GROUP BY 1),
be AS (SELECT envelope_id AS e, detector_id AS o_d, operating_point_id AS o_p, recall AS o_recall, recall_low AS o_recall_low, recall_high AS o_recall_high, fpr_high AS o_fpr_high FROM mv WHERE after = 'VALID' AND {_OK}
  QUALIFY row_number() OVER (PARTITION BY envelope_id ORDER BY recall_low DESC, recall_high - recall_low, detector_id, operating_point_id) = 1),
rs AS (SELECT mv.*, ax.considered AS seen, be.* EXCLUDE (e) FROM mv LEFT JOIN ax ON ax.e = live_envelope_id LEFT JOIN be ON be.e = live_envelope_id),
resp AS (SELECT detector_id, operating_point_id, envelope_id, k AS shard, live_envelope_id, before, state, driver, after,
  CASE WHEN after IN ('VALID', 'STALE') THEN detector_id || '|' || operating_point_id || '|' || envelope_id WHEN after = 'REVOKED' THEN o_d || '|' || o_p || '|' || live_envelope_id END AS cited,
  CASE WHEN after = 'REVOKED' AND o_d IS NOT NULL THEN 'VALID' ELSE after END AS weakest, CASE WHEN after = 'VALID' OR after = 'REVOKED' AND o_d IS NOT NULL THEN 'ALLOW' ELSE 'ESCALATE' END AS action,
  CASE WHEN after = 'REVOKED' THEN coalesce(seen, 0) END AS considered, {_CLAIM("recall", "recall")}, {_CLAIM("recall_low", _WIDE("recall_low"))}, {_CLAIM("recall_high", _WIDE("recall_high"))}, {_CLAIM("fpr_high", "fpr_high")},
  array_to_string(list_filter(['{_SAY["joint"]}', CASE WHEN len(unobserved) > 0 THEN '{_SAY["unobserved"]}' || array_to_string(list_sort(unobserved), ', ') END, CASE WHEN smoothed THEN '{_SAY["smoothing"]}' || driver END,
    CASE WHEN after = 'REVOKED' AND seen IS NULL THEN '{_SAY["off_axis"]}' || live_envelope_id END, CASE WHEN after = 'REVOKED' AND seen IS NOT NULL AND o_d IS NULL THEN '{_SAY["uncovered"]}' || live_envelope_id END,
    CASE WHEN after = 'STALE' THEN '{_SAY["widened"]}' END, CASE WHEN after IN ('VALID', 'STALE') AND live_envelope_id <> envelope_id THEN '{_SAY["moved"]}' || envelope_id END], lambda n: n IS NOT NULL), '; ') AS unchecked FROM rs)"""
_CERTIFICATES = f"""WITH {_RESPONSES}, rq AS (SELECT event_id AS request_id, user_id AS session_id, ts AS decided_at, value, 'D' || CAST(user_id AS VARCHAR) AS d, 'P-' || ['A', 'N', 'R'][event_id % 3 + 1] AS p, 'E' || CAST(1993 + event_id % 5 AS VARCHAR) || '-0' || CAST(1 + event_id % 9 AS VARCHAR) AS e FROM traffic WHERE live),
j AS (SELECT rq.*, r.*, r.after IS NOT NULL AS filed, CASE WHEN r.after IS NULL THEN 'ladder-UNFILED' ELSE 'ladder-' || r.state END AS rule_id FROM rq LEFT JOIN resp r ON r.detector_id = d AND r.operating_point_id = p AND r.envelope_id = e)
SELECT sha256(concat_ws('|', CAST(request_id AS VARCHAR), d, p, e, rule_id, '{POLICY.digest}')) AS certificate_id, request_id, session_id, decided_at, coalesce(cited, '') AS warrants_relied_upon, coalesce(weakest, 'UNVALIDATED') AS weakest, CASE WHEN filed THEN action ELSE '{POLICY.default}' END AS action,
  CASE WHEN filed THEN 'envelope:' || state ELSE 'envelope:none' END AS triggered_by, rule_id, live_envelope_id, driver, {", ".join(f"claimed_{c}" for c in C.BOUNDS)}, CASE WHEN filed THEN unchecked ELSE '{_SAY["unfiled"]}' END AS unchecked, coalesce(value > {BUDGET}, false) AS over_budget, '{POLICY.digest}' AS policy_hash FROM j"""

QUERIES = {
    "sr05_drift_response": (lambda s, d: _flat(_responses(s, d), "unchecked"), f"WITH {_RESPONSES} SELECT * FROM resp"),
    "sr06_certificates": (lambda s, d: _flat(_certificates(s, d), "warrants_relied_upon", "unchecked"), _CERTIFICATES),
}
