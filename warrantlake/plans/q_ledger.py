"""Ledger queries over orders as an append-only log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from warrantlake.functions.rng import draw, draw_sql
from warrantlake.operators import ledger as L
from warrantlake.sources.views import LEDGER, ledger_records


def _led(s, d):
    return ledger_records(s, d)


def _tampered(s, d):
    """Chains per session, with one body in 50 and one link in 70 changed after the fact."""
    rows = L.chained(_led(s, d).select("session_id", "seq", "body"), "session_id")
    return rows.withColumns({"body": F.when(F.col("seq") % 50 == 7, F.concat("body", F.lit("!"))).otherwise(F.col("body")), "prev_hash": F.when(F.col("seq") % 70 == 3, F.lit("0")).otherwise(F.col("prev_hash"))})


_CHAINS = f"""{LEDGER}, g AS (SELECT session_id, list(seq ORDER BY seq) AS seqs, list(body ORDER BY seq) AS bodies FROM ledger GROUP BY 1),
r AS (SELECT session_id, unnest(range(1, len(seqs) + 1)) AS i, seqs, bodies FROM g),
chain AS (SELECT session_id, seqs[i] AS seq, bodies[i] AS body,
  CASE WHEN i = 1 THEN 'GENESIS' ELSE list_reduce(bodies[1:i-1], lambda a, b: sha256(a || b), 'GENESIS') END AS prev_hash, list_reduce(bodies[1:i], lambda a, b: sha256(a || b), 'GENESIS') AS self_hash FROM r)"""


def _overrides(s, d):
    o = _led(s, d)
    return o.select(
        "kind", F.when(F.col("warrant_status") == "F", "none").when(F.col("seq") % 2 == 0, "false_negative").otherwise("false_positive").alias("direction"), ((F.col("seq") % 4 + 1).cast("double") / 4).alias("selection_probability"), "session_id",
        F.when(F.col("amount") > 150000, "boundary").otherwise("random").alias("stratum"),
    )


_OVERRIDES = f"""{LEDGER}, ov AS (SELECT kind, CASE WHEN warrant_status = 'F' THEN 'none' WHEN seq % 2 = 0 THEN 'false_negative' ELSE 'false_positive' END AS direction,
  CAST(seq % 4 + 1 AS DOUBLE) / 4 AS p, session_id, CASE WHEN amount > 150000 THEN 'boundary' ELSE 'random' END AS stratum FROM ledger)"""


def _stream_sample(s, d):
    """A hash-ordered sample of events as a replayable stream: index, and sessions of ten."""
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", "event_type")
    first = e.withColumn("h", draw(F.lit("stream"), "event_id")).orderBy("h", "event_id").limit(300)
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("event_id")) - 1
    return first.select("event_id", "event_type", n.cast("long").alias("index")).withColumn("session", F.floor(F.col("index") / 10).cast("long"))


def _fields(prefix: str = "") -> str:
    return ", ".join(f"{prefix}{c}" for c in ("seq", "kind", "session_id", "record_key", "created_at", "warrant_status", "detector_versions", "amount", "body"))


QUERIES = {
    "io04_ledger_scan": (lambda s, d: _led(s, d).select("seq", "kind", "session_id", "body"), f"WITH {LEDGER} SELECT seq, kind, session_id, body FROM ledger"),
    "io05_point_lookup": (lambda s, d: _led(s, d).where((F.col("kind") == "urgent") & (F.col("record_key") == "K-13")), f"WITH {LEDGER} SELECT {_fields()} FROM ledger WHERE kind = 'urgent' AND record_key = 'K-13'"),
    "io06_kinds_with_failures": (lambda s, d: _led(s, d).select("kind").distinct().join(_led(s, d).where("warrant_status = 'P'"), "kind", "left_semi"), f"WITH {LEDGER} SELECT DISTINCT kind FROM ledger l WHERE EXISTS (SELECT 1 FROM ledger x WHERE x.kind = l.kind AND x.warrant_status = 'P')"),
    "pf01_ledger_query": (lambda s, d: L.query(_led(s, d), kind="high", since="1995-03-01", until="1996-09-01", detector_version="0.1.0", warrant_status="F"), f"WITH {LEDGER} SELECT {_fields()} FROM ledger WHERE kind = 'high' AND created_at >= TIMESTAMP '1995-03-01' AND created_at < TIMESTAMP '1996-09-01' AND contains(detector_versions, '0.1.0') AND warrant_status = 'F'"),
    "pf01_exact_version": (lambda s, d: L.with_version(_led(s, d), "0.1.0").select("seq", "detector_versions"), f"WITH {LEDGER} SELECT seq, detector_versions FROM ledger WHERE list_contains(string_split(detector_versions, ','), '0.1.0')"),
    "pf02_session": (lambda s, d: L.query(_led(s, d), kind="urgent", session_id=10), f"WITH {LEDGER} SELECT {_fields()} FROM ledger WHERE kind = 'urgent' AND session_id = 10"),
    "pf03_key_rows": (lambda s, d: _led(s, d).where("record_key = 'K-5' and kind = 'low' and warrant_status = 'O'").select("seq", "body"), f"WITH {LEDGER} SELECT seq, body FROM ledger WHERE record_key = 'K-5' AND kind = 'low' AND warrant_status = 'O'"),
    "wn05_latest_per_key": (lambda s, d: L.latest(_led(s, d).select("session_id", "kind", "seq", "warrant_status", "body"), ["session_id", "kind"]), f"WITH {LEDGER}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, kind ORDER BY seq DESC) AS nth FROM ledger) SELECT session_id, kind, seq, warrant_status, body FROM r WHERE nth = 1"),
    "wn06_chain_heads": (lambda s, d: L.head(_led(s, d), "session_id"), f"WITH {LEDGER} SELECT session_id, count(*) AS records, list_reduce(list(body ORDER BY seq), lambda a, b: sha256(a || b), 'GENESIS') AS head_hash FROM ledger GROUP BY 1"),
    "wn06_chain_breaks": (
        lambda s, d: L.breaks(_tampered(s, d), "session_id"),
        f"""WITH {_CHAINS}, t AS (SELECT session_id, seq, CASE WHEN seq % 50 = 7 THEN body || '!' ELSE body END AS body, CASE WHEN seq % 70 = 3 THEN '0' ELSE prev_hash END AS prev_hash, self_hash FROM chain),
        x AS (SELECT *, lag(self_hash) OVER w AS expected, row_number() OVER w AS nth FROM t WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
        y AS (SELECT session_id, seq, sha256(prev_hash || body) <> self_hash AS bad_hash, CASE WHEN nth = 1 THEN prev_hash <> 'GENESIS' ELSE prev_hash IS DISTINCT FROM expected END AS bad_link FROM x)
        SELECT session_id, seq, concat_ws('+', CASE WHEN bad_hash THEN 'hash' END, CASE WHEN bad_link THEN 'link' END) AS reason FROM y WHERE bad_hash OR bad_link""",
    ),
    "wn07_declared_purge": (
        # The ledger's first thousand records are gone; sessions of even id declare the anchor at which their chain now begins.
        lambda s, d: _purged_breaks(s, d),
        f"""WITH {_CHAINS}, kept AS (SELECT * FROM chain WHERE seq > 1000),
        f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS nth FROM kept)
        SELECT session_id, seq, 'link' AS reason FROM f WHERE nth = 1 AND prev_hash <> 'GENESIS' AND session_id % 2 = 1""",
    ),
    "wn08_stream_sample": (
        _stream_sample,
        f"""WITH p AS (SELECT event_id, event_type FROM events ORDER BY {draw_sql("'stream'", "event_id")}, event_id LIMIT 300), n AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS index FROM p) SELECT *, index // 10 AS session FROM n""",
    ),
    "so11_purge_summary": (
        lambda s, d: L.purge_summary(_led(s, d), datetime(1994, 1, 1), datetime(2000, 1, 1)),
        f"WITH {LEDGER}, x AS (SELECT * FROM ledger WHERE created_at < TIMESTAMP '1994-01-01') SELECT count(*) AS records, min(seq) AS first_seq, max(seq) AS last_seq, sha256(arg_max(body, seq)) AS last_hash_removed FROM x",
    ),
    "ag12_count_by_kind": (lambda s, d: _led(s, d).groupBy("kind").agg(F.count("*").alias("n")), f"WITH {LEDGER} SELECT kind, count(*) AS n FROM ledger GROUP BY 1"),
    "ag13_override_summary": (
        lambda s, d: L.override_summary(_overrides(s, d), ["stratum"]),
        f"WITH {_OVERRIDES} SELECT stratum, count(*) AS n, count(*) FILTER (direction = 'none') AS upheld, count(*) FILTER (direction <> 'none') AS overridden, round(coalesce(sum(1 / p) FILTER (direction = 'false_negative'), 0), 6) AS weighted_false_negatives, round(coalesce(sum(1 / p) FILTER (direction = 'false_positive'), 0), 6) AS weighted_false_positives FROM ov GROUP BY 1",
    ),
    "ag26_one_hash": (lambda s, d: _led(s, d).groupBy("session_id").agg((F.count_distinct(F.sha2("detector_versions", 256)) == 1).alias("consistent")), f"WITH {LEDGER} SELECT session_id, count(DISTINCT sha256(detector_versions)) = 1 AS consistent FROM ledger GROUP BY 1"),
    "jn07_overrides_of_session": (
        lambda s, d: _overrides(s, d).where("direction <> 'none'").groupBy("session_id").agg(F.count("*").alias("overrides")).join(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("session_id"), "c_mktsegment"), "session_id"),
        f"WITH {_OVERRIDES} SELECT session_id, count(*) AS overrides, any_value(c_mktsegment) AS c_mktsegment FROM ov JOIN customer ON c_custkey = session_id WHERE direction <> 'none' GROUP BY 1",
    ),
    "df10_last_body": (
        lambda s, d: _led(s, d).groupBy("kind").agg(F.max_by("body", "seq").alias("last_body"), F.min("seq").alias("first_seq"), (F.min("seq") > 8).alias("truncated")),
        f"WITH {LEDGER} SELECT kind, arg_max(body, seq) AS last_body, min(seq) AS first_seq, min(seq) > 8 AS truncated FROM ledger GROUP BY 1",
    ),
    "df11_override_weight": (lambda s, d: _overrides(s, d).groupBy("direction", "selection_probability").agg(F.count("*").alias("n")).withColumns({"weight": 1 / F.col("selection_probability"), "is_false_negative": F.col("direction") == "false_negative"}), f"WITH {_OVERRIDES} SELECT direction, p AS selection_probability, count(*) AS n, 1 / p AS weight, direction = 'false_negative' AS is_false_negative FROM ov GROUP BY 1, 2"),
}


def _purged_breaks(s, d):
    rows = L.chained(_led(s, d).select("session_id", "seq", "body"), "session_id")
    gone = rows.where("seq <= 1000").groupBy("session_id").agg(F.max_by("self_hash", "seq").alias("anchor"))
    return L.breaks(rows.where("seq > 1000"), "session_id", gone.where("session_id % 2 = 0"))
