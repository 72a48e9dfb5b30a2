"""Benchmark decontamination by an FM-index per training shard.

A shard is one Arrow batch of documents. Its words become numbers of the test vocabulary; runs of such words
that are long enough to hold a test phrase are laid out with separators between them, and an FM-index is built
over that: suffix array, Burrows-Wheeler transform, and a wavelet tree for ranks. All test phrases are searched
backward at once; their occurrences are located by walking to sampled suffix positions; and the spans found in a
document are merged. Words outside the test vocabulary, and runs shorter than the shortest phrase, can't be part
of an occurrence, so leaving them out loses none.

A phrase is ``width`` consecutive words of a test item; an item of fewer words, but not none, is one phrase.

The test items are read in blocks of bounded size, block by block through the driver, and searched in every shard,
many blocks in one pass; a document's spans and items are merged over the blocks. Nulls: a null or empty text has no
words and no hits; a null item text has no phrases; a null item id is named by the empty text. Copies of an item are all named, equal rows of documents are rows
of their own, and very long texts are searched whole. Ids are compared as text. An empty benchmark hits nothing, an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warrantlake.llm.common import written

#: Words a-z, 0-9 and everything beyond ASCII; the rest parts them.
_PARTING = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Bytes of test text in a block, about the bytes of built phrases in a pass, and suffix positions from one sample to
#: the next. A byte of text takes some twelve bytes once built.
BLOCK_BYTES, PASS_BYTES, SAMPLE = 1_000_000, 50_000_000, 8
RESULT = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PARTING).split()


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector with prefix counts for each level, most significant first."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.zeros, self.ones_before = [], []
        for level in range(self.levels - 1, -1, -1):
            bits = (symbols >> level) & 1
            self.ones_before.append(np.concatenate(([0], np.cumsum(bits))))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, high = np.zeros_like(position), position
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one, before = ((symbol >> level) & 1).astype(bool), self.ones_before[k]
            low = np.where(one, self.zeros[k] + before[low], low - before[low])
            high = np.where(one, self.zeros[k] + before[high], high - before[high])
        return high - low


class FMIndex:
    """Over symbols 1..size-1 with separators 0, which match nothing and end every suffix comparison.

    The text begins and ends with a separator.
    """

    def __init__(self, text: np.ndarray, size: int, sample: int = SAMPLE):
        n = len(text)
        suffixes = self._suffix_array(text)
        self.bwt = text[suffixes - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        self.tree = WaveletTree(self.bwt, size)
        # Besides every sample-th position, those after a separator, where a walk would leave its run.
        marked = (suffixes % sample == 0) | (self.bwt == 0)
        self.marks_before = np.concatenate(([0], np.cumsum(marked)))
        self.marked, self.samples, self.length = marked, suffixes[marked], n

    @staticmethod
    def _suffix_array(text: np.ndarray) -> np.ndarray:
        """Prefix doubling; each separator is a rank of its own, so rounds end with the longest run."""
        n = len(text)
        gaps = text == 0
        rank = np.where(gaps, np.cumsum(gaps) - 1, text.astype(np.int64) + gaps.sum())
        step = 1
        while True:
            after = np.full(n, -1, np.int64)
            after[: max(0, n - step)] = rank[step:]
            after[gaps] = -1
            key = rank * (n + len(text) + int(rank.max(initial=0)) + 2) + after + 1
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
            rank, step = new, step * 2
            if n == 0 or rank[order[-1]] == n - 1:
                return order

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase (rows of ``phrases``, padded at the end)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.length, np.int64)
        for back in range(1, phrases.shape[1] + 1 if phrases.size else 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - back]
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: back to a sampled one, counting the steps."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.marked[rows])
        while len(walking):
            symbol = self.bwt[rows[walking]]
            rows[walking] = self.first[symbol] + self.tree.rank(symbol, rows[walking])
            steps[walking] += 1
            walking = walking[~self.marked[rows[walking]]]
        return self.samples[self.marks_before[rows]] + steps


class Phrases:
    """The distinct phrases of a block of test items, numbered over the block's own vocabulary (from 1)."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({str(item) for item, _ in items})
        number = {item: i for i, item in enumerate(self.items)}
        rows: dict[bytes, int] = {}
        pairs: set[tuple[int, int]] = set()
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            for at in range(max(1, len(ids) - width + 1) if len(ids) else 0):
                pairs.add((rows.setdefault(ids[at : at + width].tobytes(), len(rows)), number[str(item)]))
        self.lengths = np.array([len(p) // 4 for p in rows], np.int32)
        self.words = np.zeros((len(rows), width), np.int32)
        for row, phrase in enumerate(rows):
            self.words[row, : len(phrase) // 4] = np.frombuffer(phrase, np.int32)
        # The items of a phrase lie together, from ``first`` on.
        owned = np.array(sorted(pairs), np.int32).reshape(-1, 2)
        self.owner, self.first = owned[:, 1].copy(), np.searchsorted(owned[:, 0], np.arange(len(rows) + 1)).astype(np.int64)
        self.shortest = int(self.lengths.min()) if len(rows) else 0

    def owners(self, phrase: int) -> list[str]:
        return [self.items[i] for i in self.owner[self.first[phrase] : self.first[phrase + 1]]]

    def size(self) -> int:
        """About the bytes that it takes."""
        return self.words.nbytes + self.owner.nbytes + self.first.nbytes + self.lengths.nbytes + sum(len(w) + 100 for w in self.vocabulary) + sum(len(i) + 60 for i in self.items)


def _hits(texts: list[str | None], phrases: Phrases) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """Word counts, and (document, first word, last word + 1, phrase) of every occurrence in the shard."""
    counts, kept_ids, kept_doc, kept_word = [], [np.zeros(1, np.int64)], [np.full(1, -1)], [np.full(1, -1)]
    known = phrases.vocabulary.get
    for doc, text in enumerate(texts):
        words = words_of(text)
        counts.append(len(words))
        if not words or not phrases.shortest:
            continue
        ids = np.fromiter((known(w, 0) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).astype(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= phrases.shortest:
                kept_ids += [ids[a:b], np.zeros(1, np.int64)]
                kept_doc += [np.full(b - a + 1, doc)]
                kept_word += [np.arange(a, b + 1)]
    if len(kept_ids) == 1:
        return counts, []
    text, doc, word = np.concatenate(kept_ids), np.concatenate(kept_doc), np.concatenate(kept_word)
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.words, phrases.lengths)
    phrase = np.repeat(np.arange(len(low)), high - low)
    rows = np.arange(len(phrase)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
    at = index.locate(rows)
    return counts, list(zip(doc[at].tolist(), word[at].tolist(), (word[at] + phrases.lengths[phrase]).tolist(), phrase.tolist(), strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[str, str | None]]]:
    block, size = [], 0
    for row in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "") + 16
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def search_column(text: Column, shipped) -> Column:
    """A struct column (``RESULT``) for each text; one pass over the shards for all blocks of phrases broadcast."""

    @F.pandas_udf(RESULT)
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            spans: list[list] = [[] for _ in batch]
            items: list[set] = [set() for _ in batch]
            counts = [0] * len(batch)
            for block in shipped.value:
                counts, found = _hits(batch.tolist(), block)
                for doc, a, b, phrase in found:
                    spans[doc].append((a, b))
                    items[doc].update(block.owners(phrase))
            yield pd.DataFrame({"n_words": counts, "spans": [[{"start": a, "end": b} for a, b in merged(s)] for s in spans], "items": [sorted(x) for x in items]})

    return search(text)


def _passes(items: DataFrame, width: int, block_bytes: int, pass_bytes: int) -> Iterator[list[Phrases]]:
    """Built blocks, as many together as one pass may carry; at least one pass."""
    held, size = [], 0
    for block in _blocks(items, block_bytes):
        built = Phrases(block, width)
        if held and size + built.size() > pass_bytes:
            yield held
            held, size = [], 0
        held.append(built)
        size += built.size()
    yield held or [Phrases([], width)]


def find_contamination(docs: DataFrame, items: DataFrame, width: int = 13, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` with ``contamination``: n_words, merged word ``spans`` [start, end) and the ``items`` that occur.

    A column of that name is replaced. The built phrases that one pass over the texts carries are at most
    ``pass_bytes`` and one block; where there are more, each pass is written before the next one is broadcast.
    """
    spark, out = docs.sparkSession, docs.drop("contamination")
    for number, built in enumerate(_passes(items, width, block_bytes, pass_bytes)):
        if number:
            out = written(out, f"pass-{number}")
            shipped.destroy()
        shipped = spark.sparkContext.broadcast(built)
        found = search_column(F.col("text"), shipped)
        if not number:
            out = out.withColumn("contamination", found)
            continue
        whole = out.select(F.struct("*").alias("row"), found.alias("more"))
        was, more = F.col("row.contamination"), F.col("more")
        both = F.struct(was["n_words"].alias("n_words"), F.concat(was["spans"], more["spans"]).alias("spans"), F.array_union(was["items"], more["items"]).alias("items"))
        out = whole.withColumn("row", F.col("row").withField("contamination", both)).select("row.*")
    return out


def _hit_words(spans: Column) -> Column:
    """Words in the union of spans, in the order of their starts."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], s["to"]))).alias("n"), F.greatest(s["to"], x["end"]).alias("to"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda s: s["n"])


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """With n_words, n_hit, items and ``contaminated``: some hit, and at least one word in ``share`` is hit."""
    c = F.col("contamination")
    hit = _hit_words(c["spans"])
    return found.withColumns({"n_words": c["n_words"], "n_hit": hit, "items": F.array_sort(c["items"])}).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans [start, end), joined by one space where something was cut."""
    found = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))]
    parts, at = [], 0
    for a, b in merged(spans):
        parts.append(text[at : found[a][0]].rstrip())
        at = found[b - 1][1]
    return " ".join(p for p in [*parts, text[at:].lstrip()] if p) if spans else text


def op5_fm_index(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = judged(find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    listed = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), "contaminated")
