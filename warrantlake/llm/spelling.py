"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods.

Words are counted over all texts. Every word then probes its generated edits, characters replaced by later ones
and characters deleted, against blocked Bloom filters of the vocabulary, one for each length; since being one edit
apart is symmetric, these alone meet every pair, and each once (of equal neighbours only the first is deleted).
A block is one cache line, eight lanes of 64 bits with one bit a lane for a word. Hashes are polynomial, so an
edit's hash follows from its word's in a few operations and only edits that pass become strings. What passes is shuffled to an exact
join with the vocabulary, which removes false positives.

A filter has at least ``BITS`` bits a word, so filters grow with the vocabulary. They are built in Spark, and no
more than ``PASS_BYTES`` of them is broadcast at once: lengths are put together in passes up to that size, and a
length whose filter is larger is split by hash into parts of that size, each a pass of its own. A larger vocabulary
takes more passes, nothing else. The driver holds the filters of one pass, the counts of lengths and the alphabet
(at most 90 characters).

Forms are followed to their roots by doubling: a form has at least twice its word's count, so a path is no longer
than the logarithm of the largest count, and the number of joins is the logarithm of that.

A null text has no words; a null id is hashed as the empty text. Copies and rows of equal id are counted like any
others. Long texts are read whole, and a run of letters of any length is a word. Ties go to the smallest word in code-point order.
An empty table gives no rows. Only ``doc_id`` and ``text`` are read, whatever other columns there are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warrantlake.llm.common import table, written

RUN = re.compile("[a-zÀ-ÿ]+")
SHORTEST, RAREST, MODULUS = 5, 3, 97
#: Bits of a filter for each word, lanes of a block, least blocks of a filter, and bytes of filters in one pass.
BITS, LANES, LEAST_BLOCKS, PASS_BYTES = 16, 8, 16, 32 << 20
#: Words a task holds before it passes its counts on, and edits probed at a time.
HELD, PROBED = 200_000, 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.array([0x47B6137B44974D91, 0x8824AD5BA2B7289D, 0x705495C72DF1424B, 0x9EFC49475C6BFB31, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1, 0x9B05688C2B3E6C1F], np.uint64)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of texts: runs of letters with A-Z lower-cased, some with a character deleted by their hash."""
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            runs = Counter(RUN.findall(text.encode("utf-8", "replace").lower().decode()))
            start = crc32(f"{doc}:".encode())
            for run, n in runs.items():
                h = crc32(run.encode(), start)
                if h % MODULUS == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                if len(run) >= SHORTEST:
                    held[run] += n
            if len(held) >= HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n, length): words of at least five characters that occur at least three times in all texts."""
    texts = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    counts = texts.mapInArrow(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= RAREST).select("word", "n", F.char_length("word").alias("length"))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def letters(words: list[str], length: int) -> np.ndarray:
    """words x length: characters, which are all below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length).astype(np.uint64)


def powers(length: int) -> np.ndarray:
    """Falling powers of the base, the last one 1."""
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(length - 1, _BASE, np.uint64), dtype=np.uint64)))[::-1] if length > 1 else np.ones(length, np.uint64)


def hashes(words: list[str], length: int) -> np.ndarray:
    return (letters(words, length) * powers(length)).sum(axis=1, dtype=np.uint64)


class Filter:
    """One blocked Bloom filter: of words of one length whose hash falls to ``part`` of ``parts``."""

    def __init__(self, length: int, part: int, parts: int, blocks: int):
        self.length, self.part, self.parts, self.blocks = length, part, parts, blocks
        self.bits: np.ndarray | None = None

    def place(self, m: np.ndarray) -> np.ndarray:
        """The block of mixed hashes."""
        return ((m >> np.uint64(20)) % np.uint64(self.blocks)).astype(np.int64)

    def owned(self, m: np.ndarray) -> np.ndarray:
        return mixed(m) % np.uint64(self.parts) == self.part

    @staticmethod
    def bit(m: np.ndarray, lane: int) -> np.ndarray:
        return np.uint64(1) << ((m * _ODD[lane]) >> np.uint64(58))

    def has(self, h: np.ndarray) -> np.ndarray:
        """Places in ``h`` of what may be in the vocabulary."""
        m = mixed(h)
        left = np.arange(len(h)) if self.parts == 1 else np.flatnonzero(self.owned(m))
        m = m[left]
        block = self.place(m)
        for lane in range(LANES):
            ok = self.bits[block, lane] & self.bit(m, lane) != 0
            left, block, m = left[ok], block[ok], m[ok]
        return left


def plan(counts: dict[int, int], bits: int = BITS, pass_bytes: int = PASS_BYTES) -> list[list[Filter]]:
    """The filters of each pass, from the number of words of each length."""
    passes: list[list[Filter]] = []
    free = 0
    for length, n in sorted(counts.items()):
        blocks = max(LEAST_BLOCKS, -(-n * bits // (64 * LANES)))
        parts = -(-blocks * LANES * 8 // pass_bytes)
        size = -(-blocks // parts)
        for part in range(parts):
            if not passes or free < size * LANES * 8:
                passes.append([])
                free = pass_bytes
            passes[-1].append(Filter(length, part, parts, size))
            free -= size * LANES * 8
    return passes


def built(words: DataFrame, filters: list[Filter]) -> list[Filter]:
    """The filters of one pass with their bits, gathered by Spark block by block."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_length = batch.column("length").to_numpy()
            for number, f in enumerate(filters):
                at = np.flatnonzero(of_length == f.length)
                if not len(at):
                    continue
                h = hashes(batch.column("word").take(pa.array(at)).to_pylist(), f.length)
                m = mixed(h)
                m = m[f.owned(m)]
                place, inverse = np.unique(f.place(m), return_inverse=True)
                lanes = np.zeros((len(place), LANES), np.uint64)
                for lane in range(LANES):
                    np.bitwise_or.at(lanes[:, lane], inverse, Filter.bit(m, lane))
                columns = [pa.array(np.full(len(place), number, np.int32)), pa.array(place.astype(np.int64)), *(pa.array(np.ascontiguousarray(lanes[:, k]).view(np.int64)) for k in range(LANES))]
                yield pa.RecordBatch.from_arrays(columns, ["filter", "block", *(f"b{k}" for k in range(LANES))])

    schema = ", ".join(["filter int", "block long", *(f"b{k} long" for k in range(LANES))])
    wanted = words.where(F.col("length").between(filters[0].length, filters[-1].length)).select("word", "length")
    found = wanted.mapInArrow(blocks, schema).groupBy("filter", "block").agg(*(F.bit_or(f"b{k}").alias(f"b{k}") for k in range(LANES))).toArrow()
    number, place = found.column("filter").to_numpy(), found.column("block").to_numpy()
    lanes = np.stack([found.column(f"b{k}").to_numpy() for k in range(LANES)], axis=1).view(np.uint64) if len(number) else np.empty((0, LANES), np.uint64)
    for k, f in enumerate(filters):
        f.bits = np.zeros((f.blocks, LANES), np.uint64)
        f.bits[place[number == k]] = lanes[number == k]
    return filters


def replaced(words: list[str], length: int, alphabet: np.ndarray, f: Filter) -> Iterator[tuple[int, str]]:
    """(word number, edit) for edits that pass: a character replaced by a later one of the alphabet."""
    at, falling = letters(words, length), powers(length)
    whole = (at * falling).sum(axis=1, dtype=np.uint64)
    step = max(1, PROBED // max(1, len(words) * len(alphabet)))
    for low in range(0, length, step):
        part = at[:, low : low + step]
        later = alphabet[None, None, :] > part[:, :, None]
        row, place, letter = np.nonzero(later)
        edit = whole[row] + (alphabet[letter] - part[row, place]) * falling[low + place]
        for hit in f.has(edit).tolist():
            word, p = words[row[hit]], low + int(place[hit])
            yield int(row[hit]), word[:p] + chr(int(alphabet[letter[hit]])) + word[p + 1 :]


def deleted(words: list[str], length: int, f: Filter) -> Iterator[tuple[int, str]]:
    """(word number, edit) for edits that pass: a character deleted, of equal neighbours the first."""
    at, falling = letters(words, length), powers(length)
    terms = at * falling
    after = np.cumsum(terms[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1] - terms  # what stands behind each character
    before = (np.cumsum(terms, axis=1, dtype=np.uint64) - terms) * np.uint64(pow(int(_BASE), -1, 1 << 64))
    first = np.concatenate((np.ones((len(words), 1), bool), at[:, 1:] != at[:, :-1]), axis=1)
    row, place = np.nonzero(first)
    for hit in f.has((before + after)[row, place]).tolist():
        word, p = words[row[hit]], int(place[hit])
        yield int(row[hit]), word[:p] + word[p + 1 :]


def passing(words: DataFrame, filters: list[Filter], alphabet: list[int]) -> DataFrame:
    """(word, n, edit): generated edits of words that pass the filters of one pass."""
    spark, by_length = words.sparkSession, {f.length for f in filters}
    shipped, known = spark.sparkContext.broadcast(filters), np.array(alphabet, np.uint64)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_length = batch.column("length").to_numpy()
            for f in shipped.value:
                for length in (f.length, f.length + 1):
                    rows = np.flatnonzero(of_length == length)
                    size = max(1, PROBED // max(len(known), length))
                    for low in range(0, len(rows), size):
                        part = rows[low : low + size]
                        texts = batch.column("word").take(pa.array(part)).to_pylist()
                        hits = list(replaced(texts, length, known, f) if length == f.length else deleted(texts, length, f))
                        if hits:
                            at = pa.array(part[[h[0] for h in hits]])
                            yield pa.RecordBatch.from_arrays([batch.column("word").take(at), batch.column("n").take(at), pa.array([h[1] for h in hits], pa.string())], ["word", "n", "edit"])

    near = words.where(F.col("length").isin(sorted(by_length | {n + 1 for n in by_length})))
    return near.select("word", "n", "length").mapInArrow(probe, "word string, n long, edit string")


def near_pairs(words: DataFrame, bits: int = BITS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(a, a_n, b, b_n): pairs of words one edit apart, each once."""
    counts = {r["length"]: r["n"] for r in words.groupBy("length").agg(F.count("*").alias("n")).collect()}

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({ord(c) for w in batch.column("word").to_pylist() for c in set(w)}), pa.int32())], ["letter"])

    alphabet = sorted(r["letter"] for r in words.select("word").mapInArrow(met, "letter int").distinct().collect())
    other = words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
    found = [written(passing(words, built(words, filters), alphabet), "passing") for filters in plan(counts, bits, pass_bytes)]
    if not found:
        return words.join(other, F.col("word") == F.col("edit")).select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("edit").alias("b"), F.col("edit_n").alias("b_n"))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.join(other, "edit").select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("edit").alias("b"), F.col("edit_n").alias("b_n"))


def variants(docs: DataFrame, bits: int = BITS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    words = written(vocabulary(docs), "words")
    pairs = near_pairs(words, bits, pass_bytes)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("down"), F.col("b").alias("form"))).alias("best"))
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.down") >= 2 * F.col("n"), F.col("best")).alias("best"))
    known = written(known.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.down")).alias("form_n")), "forms")
    links = known.where("form is not null").select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 1
    for _ in range(int(most).bit_length().bit_length()):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = written(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return known.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_bloom_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
