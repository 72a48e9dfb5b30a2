"""The request loop over the live events as a stream, and betting processes that resume from a stored state."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warrantlake.operators import drift as D
from warrantlake.operators import matrix as X
from warrantlake.operators import ranges as G
from warrantlake.plans.q_drift import EDGES
from warrantlake.sources.shared import written
from warrantlake.sources.views import TRAFFIC, traffic
from warrantlake.streaming import session

#: Requests of a window, certified rate of false flags, and requests of one micro-batch.
WINDOW, P0, BATCH = 80, 0.065, 20_000
EXPIRES, SOON, NOTES = "2024-03-01", "2024-01-18", ("no warrant is relied upon", "bounds are widened: the window has shifted", "the warrant has expired", "the window is too short for a verdict", "false flags exceed the certified rate")


def _requests(s: SparkSession, d: str) -> DataFrame:
    """Live events as requests: the event's type is the warrant's detector, its value the score and the monitored feature."""
    x = traffic(s, d).where("live")
    return x.select(F.concat(F.lit("W-"), "event_type").alias("warrant_id"), F.col("event_id").alias("request_id"), F.col("user_id").alias("session_id"), "ts", "value", F.col("value").alias("score"))


def _warrants(s: SparkSession, d: str) -> DataFrame:
    """One warrant for each type, from the reference half: envelope, threshold at its 90th percentile, and bounds."""
    ref = traffic(s, d).where("not live")
    bins = D.envelope(ref, ["event_type"], "value").groupBy("event_type").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("lo", "hi"))))).alias("edges"), F.transform(F.array_sort(F.collect_list(F.struct("bin", "p"))), lambda b: b["p"]).alias("probabilities"))
    cut = G.quantiles(ref, ["event_type"], "value", {"threshold": 0.9})
    counts = ref.join(F.broadcast(cut), "event_type").groupBy("event_type", "threshold").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= F.col("threshold")).alias("hits"))
    known = counts.join(bins, "event_type").withColumns({"recall_low": X.wilson(F.col("hits"), F.col("n"), -1), "recall_high": X.wilson(F.col("hits"), F.col("n"), 1)})
    return known.select(
        F.concat(F.lit("W-"), "event_type").alias("warrant_id"), "threshold", "edges", "probabilities", "recall_low", "recall_high",
        F.when(F.col("event_type") == "error", "REFUSED").otherwise("VALID").alias("status"), F.when(F.col("event_type") == "view", SOON).otherwise(EXPIRES).cast("timestamp").alias("expires_at"),
    )


def in_arrival_order(requests: DataFrame, per_file: int) -> DataFrame:
    """The requests as a stream of files that come one a micro-batch, in the order of ``ts``, each of bounded size."""
    spark = requests.sparkSession
    n = max(1, -(-requests.count() // per_file))
    held = written(requests.repartitionByRange(n, "ts").sortWithinPartitions("ts", "request_id"), "requests")
    names = sorted(held.inputFiles())
    for at, name in enumerate(names):  # files are taken by their times, which parallel writers leave in no order
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).setTimes(path, 1_700_000_000_000 + 1000 * at, -1)
    return spark.readStream.schema(held.schema).option("maxFilesPerTrigger", 1).parquet(names[0].rpartition("/")[0])


def _loop(s: SparkSession, d: str) -> DataFrame:
    requests, warrants = _requests(s, d), written(_warrants(s, d), "warrants")
    base = s.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-")
    folder = f"{base.rstrip('/')}/session-{uuid.uuid4().hex}"
    made = f"{folder}/certificates"

    def sink(answers: DataFrame, batch_id: int) -> None:
        session.certificates(answers, requests, warrants, WINDOW).write.mode("overwrite").parquet(f"{made}/batch={batch_id}")

    session.run(s, in_arrival_order(requests, BATCH), requests, warrants, WINDOW, P0, f"{folder}/state", sink)
    x = s.read.parquet(made)
    return x.select(
        "request_id", "session_id", "cited", "flagged", "state", F.round("psi", 6).alias("psi"), "n_window", F.round("log_wealth", 6).alias("log_wealth"), "revoked", "weakest_status",
        F.round("recall_low", 9).alias("recall_low"), F.round("recall_high", 9).alias("recall_high"), "action", "rule", F.concat_ws("; ", "unchecked").alias("unchecked"),
    )


def _logs(p0: float) -> str:
    return ", ".join(f"k * {math.log1p(b * (1 - p0))!r}::DOUBLE + (n - k) * {math.log1p(-b * p0)!r}::DOUBLE" for b in D.bets(p0))


_MIX = "list_max(g) + ln(list_sum(list_transform(g, lambda v: exp(v - list_max(g)))) / 40)"


def _wilson(sign: str) -> str:
    z = f"{X.Z95!r}::DOUBLE"
    return f"((hits::DOUBLE / n + {z} * {z} / (2 * n) {sign} {z} * sqrt(hits::DOUBLE / n * (1 - hits::DOUBLE / n) / n + {z} * {z} / (4 * n * n))) / (1 + {z} * {z} / n))"


_LOOP = f"""WITH {EDGES}, q AS (SELECT event_type, quantile_cont(value, 0.9) AS threshold FROM traffic WHERE NOT live GROUP BY 1),
h AS (SELECT t.event_type, threshold, count(*) AS n, count(*) FILTER (value >= threshold) AS hits FROM traffic t JOIN q ON q.event_type = t.event_type WHERE NOT live GROUP BY 1, 2),
w AS (SELECT h.event_type, threshold, probs, {_wilson("-")} AS low, {_wilson("+")} AS high FROM h JOIN (SELECT event_type, list(p ORDER BY b) AS probs FROM envelope GROUP BY 1) p ON p.event_type = h.event_type),
lv AS (SELECT t.event_id, t.ts, t.user_id, t.event_type, value >= threshold AS flagged, probs, low, high, greatest(1, least(len(e) - 1, len(list_filter(e, lambda c: c <= value)))) AS b
  FROM traffic t JOIN w ON w.event_type = t.event_type JOIN cuts c ON c.event_type = t.event_type WHERE live),
r AS (SELECT *, [{", ".join(f"count(*) FILTER (b = {i}) OVER f" for i in range(1, 9))}] AS counts, count(*) OVER f AS n_window, count(*) OVER a AS n, count(*) FILTER (flagged) OVER a AS k FROM lv
  WINDOW f AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), a AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, CASE WHEN n_window >= {WINDOW} THEN list_sum(list_transform(range(1, len(probs) + 1), lambda i: (greatest(counts[i] / n_window::DOUBLE, 1e-6) - greatest(probs[i], 1e-6)) * ln(greatest(counts[i] / n_window::DOUBLE, 1e-6) / greatest(probs[i], 1e-6)))) END AS psi,
  [{_logs(P0)}] AS g FROM r),
m AS (SELECT *, {_MIX} AS lw, CASE WHEN psi IS NULL THEN 'INSUFFICIENT_DATA' WHEN psi < 0.1 THEN 'INSIDE' WHEN psi < 0.25 THEN 'MODERATE' ELSE 'SIGNIFICANT' END AS state FROM p),
v AS (SELECT *, max(lw) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= {math.log(20)!r}::DOUBLE AS revoked, ts >= CASE WHEN event_type = 'view' THEN TIMESTAMP '{SOON}' ELSE TIMESTAMP '{EXPIRES}' END AS expired FROM m),
s AS (SELECT *, CASE WHEN event_type = 'error' THEN 'REFUSED' WHEN revoked THEN 'REVOKED' WHEN expired THEN 'UNVALIDATED' WHEN state IN ('INSIDE', 'INSUFFICIENT_DATA') THEN 'VALID' WHEN state = 'MODERATE' THEN 'STALE' ELSE 'REVOKED' END AS weakest_status FROM v),
t AS (SELECT *, weakest_status IN ('VALID', 'STALE') AS relied, CASE WHEN weakest_status = 'STALE' THEN 1.5::DOUBLE ELSE 1::DOUBLE END AS f FROM s)
SELECT event_id AS request_id, user_id AS session_id, CASE WHEN relied THEN 'W-' || event_type END AS cited, flagged, state, round(psi, 6) AS psi, n_window::INTEGER AS n_window, round(lw, 6) AS log_wealth, revoked, weakest_status,
  CASE WHEN relied THEN round(greatest((low + high) / 2 - f * ((high - low) / 2), 0), 9) END AS recall_low, CASE WHEN relied THEN round(least((low + high) / 2 + f * ((high - low) / 2), 1), 9) END AS recall_high,
  CASE WHEN flagged OR NOT relied THEN 'ESCALATE' ELSE 'ALLOW' END AS action, CASE WHEN flagged THEN 'flagged' WHEN NOT relied THEN 'unwarranted' END AS rule,
  array_to_string(list_filter([CASE WHEN NOT relied THEN '{NOTES[0]}' END, CASE WHEN weakest_status = 'STALE' THEN '{NOTES[1]}' END, CASE WHEN expired THEN '{NOTES[2]}' END, CASE WHEN state = 'INSUFFICIENT_DATA' THEN '{NOTES[3]}' END, CASE WHEN revoked THEN '{NOTES[4]}' END], lambda x: x IS NOT NULL), '; ') AS unchecked
FROM t"""


def _resumed(s: SparkSession, d: str) -> DataFrame:
    """The reference half bet on first, its state written; the live half goes on from there."""
    x = traffic(s, d).withColumn("shard", F.col("user_id") % 8)
    how = ("shard", F.unix_micros(F.col("ts").cast("timestamp")), ["ts", "event_id"], F.col("event_type") == "error")
    grid = D.Grid(0.15)
    state = written(D.wagers(x.where("not live"), *how, grid), "wagers")
    after = D.resumed(x.where("live"), *how, grid, state)
    return after.select("event_id", "n", "k", F.round("log_wealth", 6).alias("log_wealth"), "revoked")


_RESUMED = f"""WITH {TRAFFIC}, r AS (SELECT event_id, ts, user_id % 8 AS shard, live, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS k, count(*) OVER w AS n FROM traffic WINDOW w AS (PARTITION BY user_id % 8 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, [{_logs(0.15)}] AS g FROM r), m AS (SELECT *, {_MIX} AS lw FROM l),
v AS (SELECT event_id, live, n, k, round(lw, 6) AS log_wealth, max(lw) OVER (PARTITION BY shard ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= {math.log(20)!r}::DOUBLE AS revoked FROM m)
SELECT event_id, n, k, log_wealth, revoked FROM v WHERE live"""

QUERIES = {
    "sr08_request_loop": (_loop, _LOOP),
    "wn10_resumed": (_resumed, _RESUMED),
}
