"""The request loop as a Structured Streaming job: observe, score, verdict, certificate, chained append.

Each request meets its warrant in a stream-static join, so thresholds, envelopes and bounds are columns, and many
warrants are no driver-side table. What needs memory is kept by key in typed state of ``transformWithStateInPandas``:
a ring of the last envelope bins with the number of requests seen, and the counts of the betting process with the
grid of stakes that they belong to. A restart resumes both from the checkpoint. Counts mean nothing under another
grid, so a job whose grid isn't the recorded one is refused, and so is one whose window isn't the ring's.

A request counts in its window before it is certified. Flags, the ladder, bounds and the action are column
expressions behind the stateful step. The sink appends a batch's certificates to the hash-chained ledger in arrival
order; a batch that is there already is skipped, so a job killed at any point and restarted leaves the chain of one
run. A key's rows of one micro-batch meet in one task, as their order is what is computed: bound batches by the
source's ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``, and give warrants of much traffic shards as further keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from warrantlake.operators import drift as D
from warrantlake.operators.ledger import append
from warrantlake.operators.nullband import refuse_noisy

#: The state store that typed state needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
RING, WAGER = "window int, bins array<int>, seen long", "p0 double, low double, high double, stakes int, n long, k long, most double"
OBSERVED = "warrant_id string, request_id long, n_window int, psi double, log_wealth double, revoked boolean"
ALPHA = 0.05
#: What a certificate needs of a request beside its answer.
CARRIED = ("session_id", "ts", "score")


class Observer(StatefulProcessor):
    """Keeps a warrant's ring and wager; answers each request with its window's PSI and the wealth after it."""

    def __init__(self, window: int, p0: float, low: float = 0.01, stakes: int = 40, alpha: float = ALPHA, carried: tuple[str, ...] = ()):
        self.carried = carried
        self.window, self.alpha = window, alpha
        self.grid = D.Grid(p0, low, stakes)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", RING)
        self.wager = handle.getValueState("wager", WAGER)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "request_id"])
        window, held, seen = self.ring.get() if self.ring.exists() else (self.window, [], 0)
        if window != self.window:
            raise ValueError(f"the window of {key[0]} was {window} requests and is {self.window}; the ring can't be resumed")
        n, k, most = self.resumed(key)
        expected = np.maximum(np.array(batch["probabilities"].iloc[0], float), D.EPSILON)
        bins = np.concatenate((np.array(held, np.int64), batch["bin"].to_numpy(np.int64)))
        upto = np.concatenate((np.zeros((1, len(expected)), np.int64), np.cumsum(bins[:, None] == np.arange(len(expected)), axis=0)))
        at = np.arange(len(held), len(bins)) + 1
        counts = upto[at] - upto[np.maximum(at - self.window, 0)]
        size = np.minimum(at, self.window)
        share = np.maximum(counts / size[:, None], D.EPSILON)
        psi = ((share - expected) * np.log(share / expected)).sum(axis=1)
        fired = np.cumsum(batch["false_flag"].to_numpy(np.int64)) + k
        total = n + 1 + np.arange(len(batch))
        wealth = self.grid.log_wealth(fired, total)
        peak = np.maximum.accumulate(np.concatenate(([most], wealth)))[1:]
        self.ring.update((self.window, bins[-self.window :].tolist(), seen + len(batch)))
        self.wager.update((self.grid.p0, self.grid.low, self.grid.high, self.grid.stakes, int(total[-1]), int(fired[-1]), float(peak[-1])))
        yield pd.DataFrame({"warrant_id": key[0], "request_id": batch["request_id"], "n_window": size.astype(np.int32), "psi": np.where(size < self.window, np.nan, psi), "log_wealth": wealth, "revoked": peak >= math.log(1 / self.alpha), **{c: batch[c] for c in self.carried}})

    def resumed(self, key: tuple) -> tuple[int, int, float]:
        """Counts and highest log wealth so far; refused if they belong to another grid of stakes."""
        if not self.wager.exists():
            return 0, 0, -math.inf
        p0, low, high, stakes, n, k, most = self.wager.get()
        self.grid.check({"p0": p0, "low": low, "high": high, "stakes": stakes}, str(key[0]))
        return n, k, most

    def close(self) -> None:
        pass


def observed(requests: DataFrame, warrants: DataFrame, window: int, p0: float, stakes: int = 40) -> DataFrame:
    """``OBSERVED`` for each request (warrant_id, request_id, ts, value, score) of a stream; with a session_id also ``CARRIED``."""
    carried = CARRIED if "session_id" in requests.columns else ()
    known = requests.join(warrants.select("warrant_id", "threshold", "edges", "probabilities"), "warrant_id")
    fed = known.select("warrant_id", "request_id", "ts", D.bin_of(F.col("value"), F.col("edges")).cast("int").alias("bin"), (F.col("score") >= F.col("threshold")).cast("int").alias("false_flag"), "probabilities", *(c for c in carried if c != "ts"))
    shape = StructType([*StructType.fromDDL(OBSERVED).fields, *(requests.schema[c] for c in carried)])
    return fed.groupBy("warrant_id").transformWithStateInPandas(statefulProcessor=Observer(window, p0, stakes=stakes, carried=carried), outputStructType=shape, outputMode="Append", timeMode="None")


def certificates(answers: DataFrame, requests: DataFrame, warrants: DataFrame, window: int, widen: float = 1.5) -> DataFrame:
    """One certificate for each answered request.

    The ladder turns the warrant's status by the window's verdict, and latched wealth revokes. A warrant that is
    valid or stale, and not expired, is cited with its bounds, widened around their middle when stale; any other is
    not cited and nothing is claimed. A flagged request is escalated, and so is one without a warrant to rely on.
    Answers that carry their request aren't joined with all ``requests``, which every batch would read again.
    """
    known = answers if set(CARRIED) <= set(answers.columns) else answers.join(requests.select("request_id", *CARRIED), "request_id")
    x = known.join(F.broadcast(warrants), "warrant_id")
    state = F.when(F.col("n_window") < window, "INSUFFICIENT_DATA").otherwise(D.state(F.col("psi")))
    x = x.withColumn("state", state)
    expired = F.col("ts") >= F.col("expires_at")
    status = F.when(F.col("status") == "REFUSED", "REFUSED").when(F.col("revoked"), "REVOKED").when(expired, "UNVALIDATED").otherwise(D.ladder(F.col("status"), F.col("state")))
    x = x.withColumns({"weakest_status": status, "flagged": F.col("score") >= F.col("threshold")})
    relied, stale = F.col("weakest_status").isin("VALID", "STALE"), F.col("weakest_status") == "STALE"
    middle, half = (F.col("recall_low") + F.col("recall_high")) / 2, (F.col("recall_high") - F.col("recall_low")) / 2
    factor = F.when(stale, widen).otherwise(1.0)
    notes = F.array_compact(F.array(
        F.when(~relied, "no warrant is relied upon"), F.when(stale, "bounds are widened: the window has shifted"), F.when(expired, "the warrant has expired"),
        F.when(F.col("state") == "INSUFFICIENT_DATA", "the window is too short for a verdict"), F.when(F.col("revoked"), "false flags exceed the certified rate"),
    ))
    return x.select(
        "request_id", "session_id", "ts", F.when(relied, F.col("warrant_id")).alias("cited"), "score", "flagged", "state", "psi", "n_window", "log_wealth", "revoked", "weakest_status",
        F.when(relied, F.greatest(middle - factor * half, F.lit(0.0))).alias("recall_low"), F.when(relied, F.least(middle + factor * half, F.lit(1.0))).alias("recall_high"),
        F.when(F.col("flagged") | ~relied, "ESCALATE").otherwise("ALLOW").alias("action"),
        F.when(F.col("flagged"), "flagged").when(~relied, "unwarranted").alias("rule"), notes.alias("unchecked"),
    )


def to_ledger(path: str, requests: DataFrame, warrants: DataFrame, window: int):
    """A ``foreachBatch`` sink: the certificates of a batch, chained in arrival order after those that are there."""

    def write(answers: DataFrame, batch_id: int) -> None:
        made = certificates(answers, requests, warrants, window)
        arrival = F.format_string("%020d-%020d", F.unix_micros(F.col("ts").cast("timestamp")), F.col("request_id"))
        records = made.select(F.lit("certificate").alias("kind"), arrival.alias("record_id"), F.to_json(F.struct(*made.columns)).alias("body"))
        try:
            append(answers.sparkSession, path, records)
        except ValueError as refused:
            if "duplicate" not in str(refused):
                raise

    return write


def run(spark: SparkSession, stream: DataFrame, requests: DataFrame, warrants: DataFrame, window: int, p0: float, checkpoint: str, sink, stakes: int = 40, most_false_alarms: float | None = None, n_reference: int = 1000) -> None:
    """Takes what the stream has now, through state kept at ``checkpoint``, and returns.

    With ``most_false_alarms`` a window that would leave the stable band too often on unmoved traffic is refused first.
    """
    if most_false_alarms is not None:
        settings = warrants.select("warrant_id", "probabilities", F.lit(window).alias("n"), F.lit(n_reference).alias("n_reference"), F.lit(D.STABLE).alias("stable"))
        refuse_noisy(settings, ["warrant_id"], most_false_alarms)
    before, tasks = spark.conf.get(STORE[0], None), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(*STORE)
    # A task without a warrant would open and commit a store in every batch all the same.
    spark.conf.set("spark.sql.shuffle.partitions", max(1, min(int(tasks), warrants.count())))
    try:
        query = observed(stream, warrants, window, p0, stakes).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
