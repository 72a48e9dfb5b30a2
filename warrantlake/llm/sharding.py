"""Sharding by histogram sort: shards of near-equal bytes.

Rows are ordered by a hash of their text, then by a hash of their id, then by a number of their own, so copies lie
side by side and any boundary can lie between two rows, even of a group of copies of one or no id. Candidate boundaries ("probes") are laid into the interval that holds each
wanted splitter; one pass counts the exact bytes and rows between neighbouring probes over all partitions, with
the least and greatest key met there; the intervals shrink to what was met, and new probes are laid, until every
splitter is within its tolerance or between two rows. Then the rows are exchanged once, into the ranges
between splitters, where each gets its place.

The driver holds probes and their counts alone: a number fixed by the count of ranges, not by rows. Law
``bytes``. Nulls: a null text has no bytes and size 1; null ids hash like any other. Rows of equal id and text, or of
null id, are dealt like others: their numbers are written with their keys, so that every pass sees the same ones. An empty table gives no rows; with fewer rows than shards some shards are empty. Very long
texts are rows of their size. Only ``doc_id`` and ``text`` are read, so other columns may have any name; those that
``write_shards`` writes may not be called ``shard``, ``_row`` or ``_range``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warrantlake.llm.common import written

SHARDS, PROBES = 8, 24
#: Allowed distance of a shard's boundary from its target, and of a range's within a shard, as shares of one.
TOLERANCE, LOOSE = 0.0005, 0.2
ROWS_OF_RANGE, RANGES_OF_SHARD = 20_000, 512
#: Parts of a key, each a signed long: the text's hash, the id's, and the row's number.
PARTS = ("k", "t", "r")
WIDTH = 8 * len(PARTS)
_END, _SIGN = 1 << (8 * WIDTH), np.uint64(1 << 63)


def keys(columns: pa.RecordBatch | pd.DataFrame) -> np.ndarray:
    """The parts of keys as bytes that sort alike."""
    parts = np.empty((len(columns["k"]), len(PARTS)), ">u8")
    for at, name in enumerate(PARTS):
        parts[:, at] = np.asarray(columns[name]).astype(np.int64).view(np.uint64) ^ _SIGN
    return parts.view(f"S{WIDTH}").ravel()


def _bytes(value: int) -> bytes:
    return value.to_bytes(WIDTH, "big")


def histogram(rows: DataFrame, probes: list[int]) -> list[tuple[int, int, int | None, int | None]]:
    """(bytes, rows, least key, greatest key) below the first probe, between neighbours, and from the last on."""
    shipped = np.array([_bytes(p) for p in probes], f"S{WIDTH}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = keys({name: batch.column(name).to_numpy() for name in PARTS})
            order = np.argsort(key, kind="stable")
            key, size = key[order], np.concatenate(([0], np.cumsum(batch.column("size").to_numpy()[order])))
            cuts = np.concatenate(([0], np.searchsorted(key, shipped, side="left"), [len(key)]))
            met = np.flatnonzero(np.diff(cuts))
            first, last = key[cuts[met]], key[cuts[met + 1] - 1]
            pad = lambda a: pa.array([x.ljust(WIDTH, b"\0") for x in a.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(size[cuts[met + 1]] - size[cuts[met]]), pa.array(np.diff(cuts)[met]), pad(first), pad(last)], ["bin", "bytes", "rows", "low", "high"])

    found = rows.select(*PARTS, "size").mapInArrow(count, "bin long, bytes long, rows long, low binary, high binary")
    out: list = [(0, 0, None, None)] * (len(probes) + 1)
    for r in found.groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
        out[r["bin"]] = (r["bytes"], r["rows"], int.from_bytes(r["low"], "big"), int.from_bytes(r["high"], "big"))
    return out


class _Splitter:
    """A wanted boundary: ``target`` bytes below it, to be found in (low, high)."""

    def __init__(self, target: float, slack: float, total: int):
        self.target, self.slack = target, slack
        self.low, self.high, self.below_low, self.below_high = 0, _END, 0, total
        self.found: int | None = None

    def probes(self) -> list[int]:
        width = self.high - self.low
        return sorted({self.low + width * i // (PROBES + 1) for i in range(1, PROBES + 1)} - {self.low} | {self.low + 1}) if width > 1 else []

    def refine(self, probes: list[int], below: list[int], bins: list) -> None:
        """Take the neighbouring probes around the target, then the keys met between them."""
        left, right = bisect_left(probes, self.low + 1), bisect_left(probes, self.high)
        for at in range(left, right):
            if below[at] <= self.target:
                self.low, self.below_low = probes[at], below[at]
            elif probes[at] < self.high:
                self.high, self.below_high = probes[at], below[at]
                break
        at = bisect_left(probes, self.low + 1) if self.low else 0
        held = bins[at]
        if held[2] is not None and (at == len(probes) or self.high <= probes[at]):
            self.low, self.high = max(self.low, held[2]), min(self.high, held[3] + 1)
        best = min((abs(self.below_low - self.target), self.low), (abs(self.below_high - self.target), self.high))
        if best[0] <= self.slack or self.high - self.low <= 1:
            self.found = best[1]


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> tuple[list[int], list[int], int]:
    """Keys that part the ranges, the rows of each range, and the ranges of a shard."""
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    of_shard = min(RANGES_OF_SHARD, max(1, -(-total["rows"] // (shards * ROWS_OF_RANGE))))
    ranges, size = shards * of_shard, total["bytes"] or 0
    wanted = [_Splitter(size * j / ranges, (tolerance if j % of_shard == 0 else LOOSE / of_shard) * size / shards, size) for j in range(1, ranges)]
    while open_ := [s for s in wanted if s.found is None]:
        probes = sorted({p for s in open_ for p in s.probes()})
        if not probes:
            break
        bins = histogram(rows, probes)
        below = np.cumsum([b[0] for b in bins]).tolist()
        for s in open_:
            s.refine(probes, below, bins)
    cuts, last = [], 0
    for s in wanted:
        last = max(last, s.low if s.found is None else s.found)
        cuts.append(last)
    inside = [min(c, _END - 1) for c in cuts]
    distinct = sorted(set(inside))
    counts = np.zeros(ranges, np.int64)
    for held, at in zip(histogram(rows, distinct), [0, *(np.searchsorted(np.array(inside, object), d, side="right") for d in distinct)], strict=True):
        counts[at] += held[1]
    return inside, counts.tolist(), of_shard


def keyed(docs: DataFrame, row: Column) -> DataFrame:
    """Ids, sizes and keys; ``row`` tells rows apart, and is to be written before it is used."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k"), F.xxhash64("doc_id").alias("t"), row.alias("r"))


def range_column(k: Column, t: Column, r: Column, cuts: list[int]) -> Column:
    """The range of a row: how many splitters its key isn't below."""
    shipped = np.array([_bytes(c) for c in cuts], f"S{WIDTH}")

    @F.pandas_udf("int")
    def ranged(k: pd.Series, t: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shipped, keys({"k": k, "t": t, "r": r}), side="right").astype(np.int32))

    return ranged(k, t, r)


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; a shard's slots are 0, 1, 2 ... in key order."""
    rows = written(keyed(docs, F.monotonically_increasing_id()), "keys")
    cuts, counts, of_shard = splitters(rows, shards, tolerance)
    before = np.array([sum(counts[r - r % of_shard : r]) for r in range(len(counts))])

    @F.pandas_udf("long")
    def base(ranges: pd.Series) -> pd.Series:
        return pd.Series(before[ranges.to_numpy()])

    placed = rows.withColumn("range", range_column(*(F.col(c) for c in PARTS), cuts))
    order = Window.partitionBy("range").orderBy(*PARTS)
    return (
        placed.withColumn("nth", F.row_number().over(order))
        .withColumn("slot", base("range") + F.col("nth") - 1)
        .select("doc_id", "size", "text_crc32", F.floor(F.col("range") / of_shard).cast("int").alias("shard"), "slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Whole rows of ``docs``, under ``path/shard=N``: one exchange, by range."""
    held = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    cuts, _, of_shard = splitters(written(keyed(held, F.col("_row")), "keys"), shards)
    text = F.coalesce("text", F.lit(""))
    placed = held.withColumn("_range", range_column(F.xxhash64(text), F.xxhash64("doc_id"), F.col("_row"), cuts))
    placed.repartition("_range").withColumn("shard", F.floor(F.col("_range") / of_shard)).drop("_range", "_row").write.partitionBy("shard").parquet(path)


def op2_histogram_sort(spark, sf_dir: str) -> DataFrame:
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
