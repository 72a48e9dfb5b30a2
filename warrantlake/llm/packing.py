"""Best-fit packing of token sequences by a grouping genetic algorithm on distributed islands.

Documents become token ids, each followed by one separator id. A document longer than a sequence is cut into
pieces of full length, the first of which may be shorter; full pieces are sequences of their own. The rest is
dealt by a hash into blocks of bounded size. Several islands evolve packings of each block: a crossover injects
whole well-filled bins of one parent into the other, removes the bins that now hold duplicates, and best-fits the
displaced pieces; between epochs each island's elite also goes to its neighbour. The emptiest bins of the best
packing of every block, at most an eighth, are opened again and packed together in fewer blocks, until one block
is left. Every block is crossed at least once in each epoch, and stops once it needs no more bins than its tokens do.

Nulls: a null text is empty; its piece is the separator alone. Rows of equal or null ``doc_id`` are packed each
for itself, and dealt row by row, so that copies don't meet in one block. An empty table gives no rows. Very long
texts are cut like any other, however long their runs of white space. Only ``doc_id`` and ``text`` are read, so
further columns, whatever their names, change nothing.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from warrantlake.llm.common import written

CAPACITY, SEPARATOR = 2048, 0
#: Files of one vocabulary, and white space from which on its library makes the ids: below it, a run costs no more than there.
VOCABULARY, LONG_RUN = "byte_bpe_50k", 200
#: Sequences that a block fills at least, so that few of them are opened again; a block of short pieces is so much longer.
BINS = 8
#: Pieces of a block, islands of a block, epochs, generations of an epoch, packings on an island.
BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4096, 3, 2, 6, 5
#: Emptiest bins that are packed again with those of other blocks.
REOPENED = 0.125
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def encoding(vocabulary: str) -> tiktoken.Encoding:
    """The byte-level BPE of a rank file, with the added tokens of the JSON vocabulary of the same name; ids are equal."""
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as file:
        added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


_LONG = re.compile(rf"\s{{{LONG_RUN}}}")


@lru_cache(maxsize=2)
def library(vocabulary: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


def token_ids(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The text's ids and the separator, as little-endian unsigned 32-bit numbers.

    A rank file's pattern backtracks along a run of white space, in the square of its length; texts with a long one go
    to the JSON file's library.
    """
    text = text or ""
    half = LONG_RUN // 2
    # A run of that length holds a whole aligned block of half of it; most texts have none, and need no search.
    if any(text[at : at + half].isspace() for at in range(0, len(text) - half + 1, half)) and _LONG.search(text):
        ids = library(vocabulary).encode(text, add_special_tokens=False).ids
    else:
        ids = encoding(vocabulary).encode_to_numpy(text, allowed_special="all")
    return np.append(ids, SEPARATOR).astype("<u4")


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all but the first are full."""
    count = -(-length // capacity)
    first = length - capacity * (count - 1)
    return [(0, first)] + [(first + capacity * i, capacity) for i in range(count - 1)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = token_ids(text, vocabulary)
                rows += [(doc, i, a, n, zlib.crc32(ids[a : a + n].tobytes())) for i, (a, n) in enumerate(cut(len(ids), capacity))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tokenized, PIECES)


class Packing:
    """Bins of item numbers with their free space; bins of equal free space are found by the bits of one number."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self._by_free: dict[int, list[int]] = {}
        self._bits = 0

    def _offer(self, bin_: int) -> None:
        space = self.free[bin_]
        self._by_free.setdefault(space, []).append(bin_)
        self._bits |= 1 << space

    def open(self, items: list[int]) -> None:
        self.bins.append(list(items))
        self.free.append(self.capacity - sum(self.sizes[i] for i in items))
        self._offer(len(self.bins) - 1)

    def best_fit(self, items: list[int]) -> None:
        """Each item into the fullest bin that takes it, else into a new one."""
        for item in items:
            size = self.sizes[item]
            fits = self._bits >> size
            if not fits:
                self.open([item])
                continue
            space = size + (fits & -fits).bit_length() - 1
            same = self._by_free[space]
            bin_ = same.pop()
            if not same:
                self._bits &= ~(1 << space)
            self.bins[bin_].append(item)
            self.free[bin_] = space - size
            self._offer(bin_)

    def fitness(self) -> tuple[int, float]:
        """Fewer bins, then fuller ones."""
        return -len(self.bins), sum((1 - f / self.capacity) ** 2 for f in self.free) / max(1, len(self.free))


def falling(items, sizes: list[int], rng=None) -> list[int]:
    """By size, the largest first; with ``rng``, sizes are blurred a little."""
    blur = rng.normal(1, 0.08, len(sizes)) if rng is not None else np.ones(len(sizes))
    return sorted(items, key=lambda i: -sizes[i] * blur[i])


def crossover(into: Packing, of: Packing, rng: np.random.Generator) -> Packing:
    """Some of the fuller half of ``of``'s bins whole, ``into``'s bins without their items, the displaced best-fitted."""
    order = np.argsort(of.free, kind="stable")[: max(1, len(of.bins) // 2)]
    chosen = [int(b) for b in order[rng.random(len(order)) < rng.uniform(0.1, 0.6)]]
    taken = {i for b in chosen for i in of.bins[b]}
    child, displaced = Packing(into.sizes, into.capacity), []
    for b in chosen:
        child.open(of.bins[b])
    emptiest = set(np.argsort(into.free)[-max(1, len(into.bins) // 50) :].tolist())
    for number, items in enumerate(into.bins):
        if number in emptiest or any(i in taken for i in items):
            displaced += [i for i in items if i not in taken]
        else:
            child.open(items)
    child.best_fit(falling(displaced, into.sizes, rng if rng.random() < 0.3 else None))
    return child


def evolve(sizes: list[int], capacity: int, seeds: list[list[list[int]]], rng: np.random.Generator, generations: int = GENERATIONS) -> Packing:
    """The best packing after some generations; ``seeds``: packings to begin with."""
    fewest = -(-sum(sizes) // capacity)
    population = []
    for bins in seeds:
        known = Packing(sizes, capacity)
        for items in bins:
            known.open(items)
        population.append(known)
    if not population:
        first = Packing(sizes, capacity)
        first.best_fit(falling(range(len(sizes)), sizes))
        population.append(first)
    done = len(max(population, key=Packing.fitness).bins) <= fewest
    most = 2 if done else POPULATION
    while len(population) < most:
        other = Packing(sizes, capacity)
        other.best_fit(falling(range(len(sizes)), sizes, rng))
        population.append(other)
    for _ in range(1 if done else generations):
        population.sort(key=Packing.fitness, reverse=True)
        a, b = rng.choice(min(3, len(population)), 2, replace=False)
        children = [crossover(population[a], population[b], rng), crossover(population[b], population[a], rng)]
        # Of equally good packings the children come first; the best of the parents always stays.
        population = children + population[: max(1, most - len(children))]
        if len(max(population, key=Packing.fitness).bins) <= fewest:
            break
    return max(population, key=Packing.fitness)


def _pack_blocks(items: DataFrame, blocks: int, level: int, capacity: int) -> DataFrame:
    """``items`` with sequence_id, offset, and ``reopened`` for the bins to be packed again."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    row = f"{PIECES}, block int, island int, bin int, bins int, item int"

    def epoch(pdf: pd.DataFrame) -> pd.DataFrame:
        block, island = int(pdf["block"].iloc[0]), int(pdf["island"].iloc[0])
        sizes, seeds = None, []
        for _, part in pdf.groupby("origin", sort=True):
            part = part.sort_values(columns if part["item"].iloc[0] < 0 else ["item"], kind="stable").reset_index(drop=True)
            base, sizes = part, part["length"].astype(int).tolist()
            if part["item"].iloc[0] >= 0:
                seeds.append([g.tolist() for _, g in part.groupby("bin")["item"]])
        fewest = -(-sum(sizes) // capacity)
        packing = evolve(sizes, capacity, seeds, np.random.default_rng((level, block, island, len(seeds))))
        if island and not seeds and len(packing.bins) <= fewest:
            return base.head(0).assign(bins=0, item=0, bin=0)[[*columns, "block", "island", "bin", "bins", "item"]]
        bin_of = np.empty(len(sizes), np.int32)
        for number, held in enumerate(packing.bins):
            bin_of[held] = number
        return base.assign(block=block, island=island, bin=bin_of, bins=len(packing.bins), item=np.arange(len(sizes)))[[*columns, "block", "island", "bin", "bins", "item"]]

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        best = pdf.loc[pdf["bins"].eq(pdf["bins"].min()), "island"].min()
        kept = pdf[pdf["island"].eq(best)].sort_values(["bin", "item"], kind="stable")
        fill = kept.groupby("bin")["length"].sum()
        free = (capacity - fill).sort_values(ascending=False, kind="stable")
        most = min(int(np.ceil(len(free) * REOPENED)), len(free) // 2)
        again = set(free[free > 0].index[:most]) if blocks > 1 else set()
        offset = kept.groupby("bin")["length"].cumsum() - kept["length"]
        sequence = (level << 56) + kept["block"].astype("int64") * (1 << 24) + kept["bin"].astype("int64")
        return kept.assign(sequence_id=sequence, offset=offset, reopened=kept["bin"].isin(again))[[*columns, "sequence_id", "offset", "reopened"]]

    start = items.select(*columns, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(level)), F.lit(blocks)).cast("int").alias("block"))
    state = start.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).withColumns({"origin": F.col("island"), "item": F.lit(-1), "bin": F.lit(0), "bins": F.lit(0)})
    for number in range(EPOCHS):
        found = state.groupBy("block", "island").applyInPandas(epoch, row)
        if number + 1 < EPOCHS:
            # The elite stays, and goes to the next island.
            state = found.withColumn("origin", F.col("island")).withColumn("island", F.explode(F.array(F.col("island"), (F.col("island") + 1) % ISLANDS)))
    return found.groupBy("block").applyInPandas(finish, f"{PIECES}, sequence_id long, offset long, reopened boolean")


def pack(docs: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: ``PIECES``, ``sequence_id`` and ``offset``; sequences are gapless from 0."""
    cut_pieces = written(pieces(docs, capacity, vocabulary), "pieces")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = cut_pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.lit(1 << 62) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    parts, left, level = [whole.select(*out)], cut_pieces.where(F.col("length") < capacity), 0
    while True:
        held = left.agg(F.count("*").alias("rows"), F.sum("length").alias("tokens")).first()
        blocks = max(1, min(-(-held["rows"] // block), (held["tokens"] or 0) // (BINS * capacity)))
        packed = written(_pack_blocks(left, blocks, level, capacity), f"packed-{level}")
        parts.append(packed.where("not reopened").select(*out))
        if blocks == 1:
            break
        left, level = packed.where("reopened"), level + 1
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
