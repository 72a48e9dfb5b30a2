"""Live monitoring as a Structured Streaming job: a ring of the last rows per key, verdicts, a chained ledger.

Events are grouped by key; each key's state is its last ``window`` categories and its row count. Every row yields
the drift state of its window, once that is full. ``run`` appends the verdicts to a hash-chained ledger by
micro-batches; a batch that was appended already (same batch id) is skipped, so a retry changes nothing.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from warrantlake.operators.drift import EPSILON, SIGNIFICANT, STABLE
from warrantlake.operators.ledger import append

VERDICT = "shard long, event_id long, n long, psi double, state string"


def psi_of(counts: dict[str, int], expected: dict[str, float]) -> float:
    n = sum(counts.values())
    total = 0.0
    for name, share in expected.items():
        a, e = max(counts.get(name, 0) / n, EPSILON), max(share, EPSILON)
        total += (a - e) * math.log(a / e)
    return total


def verdicts(events: DataFrame, expected: dict[str, float], window: int) -> DataFrame:
    """(``VERDICT``) for each event of a streaming frame (shard, ts, event_id, event_type), in arrival order of a batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring, seen = (deque(state.get[0]), state.get[1]) if state.exists else (deque(), 0)
        counts = Counter(ring)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event_id, kind in zip(rows["event_id"], rows["event_type"], strict=True):
            ring.append(kind)
            counts[kind] += 1
            if len(ring) > window:
                counts[ring.popleft()] -= 1
            seen += 1
            value = psi_of(counts, expected)
            state_name = "INSUFFICIENT_DATA" if len(ring) < window else "INSIDE" if value < STABLE else "MODERATE" if value < SIGNIFICANT else "SIGNIFICANT"
            out.append((key[0], event_id, len(ring), value, state_name))
        state.update((list(ring), seen))
        yield pd.DataFrame(out, columns=["shard", "event_id", "n", "psi", "state"])

    return events.groupBy("shard").applyInPandasWithState(step, VERDICT, "ring array<string>, seen long", "append", GroupStateTimeout.NoTimeout)


def source(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Event files of a folder as a stream."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.select((F.col("user_id") % 4).alias("shard"), "ts", "event_id", "event_type")


def to_ledger(path: str):
    """A ``foreachBatch`` sink: not-inside verdicts become chained ledger records of the batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        records = batch.where("state in ('MODERATE', 'SIGNIFICANT')").select(F.lit("certificate").alias("kind"), F.concat_ws("-", F.lit(f"{batch_id:08d}"), "event_id").alias("record_id"), F.to_json(F.struct("shard", "event_id", "state")).alias("body"))
        try:
            append(spark, path, records)
        except ValueError as refused:
            if "duplicate" not in str(refused):
                raise

    return write
