"""SimHash near-duplicates through pivot distance tables.

Every distinct fingerprint gets its Hamming distances to reference fingerprints ("pivots"), kept per band of
bits. Two fingerprints that differ in at most ``max_distance`` bits agree on all bits, hence on all pivot
distances, of at least ``bands - max_distance`` bands; equality of those distance tuples is the candidate key,
so no pair is lost and no cross join is made. Of the candidates, those whose distances to some pivot differ by
more than ``max_distance`` are discarded by the triangle inequality, and the survivors are verified bit by bit.

Rows that share a key are compared in chunks of bounded size, each pair of chunks in its own group, so a key
that many fingerprints share is spread over tasks. A group reports a spanning forest of its links: enough for
the components, and linear in the group, not quadratic.

Nulls: a null text is the empty text, whose fingerprint is zero and links like any other. A null ``doc_id`` is
kept, and never a component id unless no other id is in the component. Copies share a fingerprint and are
compared once, and a fingerprint that many rows share is salted where its class goes back to them. Very long texts
are read whole. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read, whatever other columns
there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warrantlake.llm.common import HOT, join_hot, written

BITS = 64
#: Pivots: five bits of each distance tuple go into one long per band.
PIVOTS = 12
#: Bands of bits, of which all but ``max_distance`` have to agree.
BANDS = 5
#: Rows of a key compared in one group, at most twice as many.
CHUNK = 1024
#: Groups up to this many rows are compared together, by offsets within the sorted batch.
SMALL = 48


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle_words, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_column(text, shingle_words: int = 3):
    """A long column: the fingerprint's 64 bits, as a signed number."""

    @F.pandas_udf("long")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            values = np.fromiter((fingerprint(t, shingle_words) for t in batch), np.uint64, len(batch))
            yield pd.Series(values.view(np.int64))

    return simhash(text)


def pivots(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, PIVOTS, dtype=np.uint64)


def band_masks(bands: int) -> np.ndarray:
    edges = np.linspace(0, BITS, bands + 1).astype(int)
    return np.array([((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:], strict=False)], np.uint64)


def pivot_distances(values: np.ndarray, references: np.ndarray, mask: np.uint64 | None = None) -> np.ndarray:
    """values x references: Hamming distances, within the bits of ``mask``."""
    differing = values[:, None] ^ references[None, :]
    return np.bitwise_count(differing if mask is None else differing & mask).astype(np.int8)


def table_keys(values: np.ndarray, bands: int, max_distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """(table, keys): one table for each choice of the bands that have to agree."""
    references, shifts = pivots(), np.arange(PIVOTS, dtype=np.uint64) * np.uint64(5)
    packed = [(pivot_distances(values, references, m).astype(np.uint64) << shifts).sum(axis=1, dtype=np.uint64) for m in band_masks(bands)]
    for number, chosen in enumerate(combinations(range(bands), bands - max_distance)):
        key = packed[chosen[0]]
        for band in chosen[1:]:
            key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ (key >> np.uint64(29)) ^ packed[band]
        yield number, key.view(np.int64)


def _linked(a: np.ndarray, b: np.ndarray, da: np.ndarray, db: np.ndarray, most: int) -> np.ndarray:
    """Of aligned candidates: the largest difference of pivot distances first, then the bits of those left."""
    left = np.flatnonzero(np.abs(da - db).max(axis=-1) <= most)
    return left[np.bitwise_count(a[left] ^ b[left]) <= most]


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join two trees."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def _large_group(values: np.ndarray, distances: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A breadth-first spanning forest; each row is compared once with those not yet reached."""
    unreached, edges = np.arange(len(values)), []
    while len(unreached):
        queue, unreached = [int(unreached[0])], unreached[1:]
        while queue and len(unreached):
            at = queue.pop()
            hit = _linked(values[unreached], np.broadcast_to(values[at], len(unreached)), distances[unreached], distances[at], most)
            found = unreached[hit]
            edges += [(at, int(x)) for x in found]
            queue += found.tolist()
            unreached = np.delete(unreached, hit)
    return edges


def _group_edges(group: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``group`` (sorted), as spanning forests."""
    edges: list[tuple[int, int]] = []
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, len(group)))
    references = pivots()
    for a, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        part = values[a : a + n]
        edges += [(a + x, a + y) for x, y in _large_group(part, pivot_distances(part, references), most)]
    small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    if len(small):
        v, g = values[small], group[small]
        d = pivot_distances(v, references)
        for offset in range(1, int(sizes[(sizes > 1) & (sizes <= SMALL)].max())):
            same = np.flatnonzero(g[:-offset] == g[offset:])
            hit = same[_linked(v[same], v[same + offset], d[same], d[same + offset], most)]
            edges += list(zip(small[hit].tolist(), small[hit + offset].tolist(), strict=True))
    edges = _forest(edges)
    index = np.array(edges, np.int64).reshape(-1, 2)
    return values[index[:, 0]].view(np.int64), values[index[:, 1]].view(np.int64)


def links(distinct: DataFrame, bands: int = BANDS, max_distance: int = 3) -> DataFrame:
    """(u, v): links between the distinct fingerprints of column ``fp``, a spanning forest of each compared group.

    ``bands``: with 4, one band of 16 bits has to agree, in 4 tables; with 5, two of 13 bits in 10 tables, so that
    billions of fingerprints meet some tens of others; with 6, three in 20. The classes that follow are the same.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for number, key in table_keys(fp.view(np.uint64), bands, max_distance):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), number, np.int32)), pa.array(key), pa.array(fp)], ["tab", "key", "fp"])

    candidates = distinct.select("fp").mapInArrow(keyed, "tab int, key long, fp long")
    shared = candidates.groupBy("tab", "key").agg(F.count("*").alias("n")).where("n > 1")
    # Keys of one fingerprint have no candidates; the rest are dealt by key and pair of chunks.
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    dealt = (
        candidates.join(shared, ["tab", "key"])
        .select("tab", "key", "fp", chunks.alias("chunks"), own.alias("own"))
        .select("tab", "key", "fp", "own", F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("own")))).alias("other"))
        .select(F.xxhash64("tab", "key", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "fp")
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_g, held_v = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            held_g = np.concatenate((held_g, batch.column("grp").to_numpy(zero_copy_only=False)))
            held_v = np.concatenate((held_v, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
            whole = int(np.searchsorted(held_g, held_g[-1])) if len(held_g) else 0
            if whole:
                u, v = _group_edges(held_g[:whole], held_v[:whole], max_distance)
                held_g, held_v = held_g[whole:], held_v[whole:]
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        if len(held_g):
            u, v = _group_edges(held_g, held_v, max_distance)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return dealt.repartition("grp").sortWithinPartitions("grp").mapInArrow(compared, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge.

    Alternating stars: every node's larger neighbours move to its smallest neighbour, then its smaller ones,
    until nothing moves; the rounds grow with the logarithm of a component's size.
    """

    def canonical(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = written(canonical(edges), "edges")
    before, at = None, state(now)
    while at != before and at[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = canonical(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = written(canonical(moved), "edges")
        before, at = at, state(now)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_distance: int = 3, bands: int = BANDS, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of ``docs`` (columns ``doc_id`` and ``text``)."""
    marked = written(docs.select("doc_id", fingerprint_column(F.col("text"), shingle_words).alias("fp")), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct")
    roots = written(components(links(distinct, bands, max_distance)), "roots")
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", "root")
    linked = rooted.where("root is not null")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_linked = linked.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    alone = rooted.where("root is null").select("fp", F.col("first_id").alias("component_id"))
    ids = written(of_linked.unionByName(alone), "ids")
    return join_hot(marked, ids, "fp", distinct.select("fp", "n"), "inner", hot).select("doc_id", "fp", "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
