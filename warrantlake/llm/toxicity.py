"""Toxicity by the nearest labelled examples: exact cosine of weighted TF-IDF over a block-max inverted index.

A text's terms are its words and, marked with ``*``, the beginnings of longer ones, so that inflected forms meet; a term found several times gives further terms, marked with ``^`` and a number. A bounded sample of labelled
rows gives the examples, and every term of theirs is indexed. A term weighs (1 + log tf) x idf x how well it tells
the labels apart; document frequencies are counted over every document. Vectors have unit length over all of a
text's indexed terms. Examples lie in blocks; each term's postings carry its largest weight per block, so the sum of
a query's products with these bounds every cosine in the block. Blocks are scored in falling order of that bound
until the k-th best cosine is above the next one: the k nearest are exact. Their votes, weighted by cosine, become a
probability through a logistic curve fitted on the examples, each scored without itself, and weighted back to the
shares of the labels.

A text that shares no term with the examples gets the smoothed share of toxic ones. That holds for null and empty
texts too, and very long texts are read whole. Rows of null label aren't learned from; an id labelled twice is toxic
if it is once. Without examples every score is 0. Ties between examples fall to the earlier one of the index. Copies
are scored alike, an empty table gives no rows, and only ``doc_id`` and ``text`` are read, whatever other columns
there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warrantlake.llm.common import crc_of_id

#: Bound of the learned part: examples of each label.
PER_LABEL = 700
#: Words of which a worker remembers the terms, before it begins anew.
KNOWN_WORDS = 250_000
#: A term whose shares among the labels lie this many standard errors apart counts a quarter of one that tells them surely.
HALF_Z = 5.0
BEGINNING, TIMES = 5, (2, 4)
NEIGHBOURS, BLOCK, THRESHOLD, TELLING = 15, 64, 0.7, 5
RESULT = "score double, neighbours array<struct<doc_id:long,toxic:int,similarity:double>>, terms array<string>"
_PARTING = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().encode().translate(_PARTING).decode().split()


def terms_of(word: str) -> list[str]:
    return [word, word[:BEGINNING] + "*"] if len(word) > BEGINNING else [word]


def counted_terms(words: list[str]) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(words).items():
        for term in terms_of(word):
            out[term] += n
    return with_times(out)


def with_times(counts: Counter) -> Counter:
    out = Counter(counts)
    for term, n in counts.items():
        if n < TIMES[0]:
            continue
        for times in TIMES:
            if n < times:
                break
            out[f"{term}^{times}"] = n
    return out


def separation(counted: list[Counter], labels: np.ndarray) -> tuple[list[str], np.ndarray]:
    """All terms, and how well each tells the labels apart (0 to 1), by its distance in standard errors."""
    n = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    found: tuple[Counter, Counter] = (Counter(), Counter())
    for terms, label in zip(counted, labels.tolist(), strict=True):
        found[label].update(terms.keys())
    names = sorted(found[0].keys() | found[1].keys())
    a, b = (np.array([f[t] for t in names], float) for f in found)
    if not n.all():
        return names, np.ones(len(names))
    p = (a + b + 1) / (n.sum() + 2)
    z2 = (b / n[1] - a / n[0]) ** 2 / (p * (1 - p) * (1 / n[0] + 1 / n[1]))
    return names, ((z2 + 1e-3) / (z2 + HALF_Z**2)) ** 2


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    size = end - begin
    return np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)


class _Numbers(dict):
    """A word's two terms in one number: the word's in the upper half, its beginning's in the lower, from 1; 0 is none."""

    def __init__(self, whole: dict[str, int], begun: dict[str, int]):
        super().__init__()
        self.whole, self.begun = whole, begun

    def __missing__(self, word: str) -> int:
        start = self.begun.get(word[:BEGINNING], -1) if len(word) > BEGINNING else -1
        self[word] = found = (self.whole.get(word, -1) + 1 << 32) + start + 1
        return found


@dataclass
class Index:
    """Postings (``example``, ``weight``) lie in cells, one for each block of a term; ``first`` tells a term's cells."""

    terms: dict[str, int]
    worth: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    example: np.ndarray | None = None
    weight: np.ndarray | None = None
    first: np.ndarray | None = None
    cell_begin: np.ndarray | None = None
    cell_block: np.ndarray | None = None
    cell_max: np.ndarray | None = None
    curve: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    unmatched: float = 0.0

    def __post_init__(self):
        self.names = list(self.terms)
        #: The further terms for finding a term several times: a row of ``TIMES`` for each term that has some, 0 is none.
        self.times_row = np.zeros(len(self.terms), np.int32)
        rows = [[-1] * len(TIMES)]
        for term, at in self.terms.items():
            base, mark, times = term.rpartition("^")
            if mark and base in self.terms:
                base = self.terms[base]
                if not self.times_row[base]:
                    self.times_row[base] = len(rows)
                    rows.append([-1] * len(TIMES))
                rows[self.times_row[base]][TIMES.index(int(times))] = at
        self.times_table = np.array(rows)
        whole = {t: at for t, at in self.terms.items() if t[-1] != "*"}
        self._known = _Numbers(whole, {t[:-1]: at for t, at in self.terms.items() if t[-1] == "*"})

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_known", "names", "times_row", "times_table")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def matched(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The index's terms in a text's words, in their order, and how often each is found."""
        if len(self._known) > KNOWN_WORDS:
            self._known.clear()
        pairs = np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))
        both = np.concatenate((pairs >> 32, pairs & 0xFFFFFFFF))
        at, n = np.unique(both[both > 0] - 1, return_counts=True)
        several = np.flatnonzero(n > 1)
        found = self.times_table[self.times_row[at[several]]]
        row, column = np.nonzero((found >= 0) & (n[several][:, None] >= np.array(TIMES)))
        if not len(row):
            return at, n
        at, n = np.concatenate((at, found[row, column])), np.concatenate((n, n[several][row]))
        order = np.argsort(at)
        return at[order], n[order]

    def vector(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit-length weights."""
        weight = (1 + np.log(n)) * self.worth[at]
        return at, weight / np.linalg.norm(weight)

    def add(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        example = np.concatenate([np.full(len(t), i) for i, (t, _) in enumerate(vectors)]) if vectors else np.empty(0, int)
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.empty(0, int)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.empty(0)
        order = np.lexsort((example, term))
        example, term, weight = example[order], term[order], weight[order]
        self.example, self.weight = example.astype(np.int32), weight.astype(np.float32)
        # Rounded weights bound themselves.
        weight = self.weight.astype(float)
        block = example // BLOCK
        new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if len(term) else np.empty(0, int)
        self.cell_begin, self.cell_block = np.append(new, len(term)), block[new].astype(np.int32)
        self.cell_max = np.maximum.reduceat(weight, new) if len(new) else np.empty(0)
        self.first = np.searchsorted(term[new], np.arange(len(self.terms) + 1))

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest positive cosine, exactly (to single precision), and the cosines."""
        cells = _ranges(self.first[at], self.first[at + 1])
        factor, block = np.repeat(weight.astype(np.float32), self.first[at + 1] - self.first[at]), self.cell_block.take(cells)
        blocks = -(-len(self.ids) // BLOCK)
        bounds = np.bincount(block, factor * self.cell_max.take(cells), minlength=blocks)
        order = np.argsort(-bounds, kind="stable")
        best, cosine, done, step = np.empty(0, np.int64), np.empty(0), 0, 6
        while done < len(order):
            now = order[done : done + step]
            enough = cosine[-1] - 1e-6 if len(cosine) == k else 0.0
            now = now[(bounds[now] >= enough) & (bounds[now] > 0)]
            if not len(now):
                break
            wanted = np.zeros(blocks, bool)
            wanted[now] = True
            read = np.flatnonzero(wanted.take(block))
            chosen = cells.take(read)
            begin = self.cell_begin.take(chosen)
            size = self.cell_begin.take(chosen + 1) - begin
            postings = np.repeat(begin - np.cumsum(size) + size, size)
            postings += np.arange(len(postings))
            scores = np.bincount(self.example.take(postings), self.weight.take(postings) * np.repeat(factor.take(read), size), minlength=len(self.ids))
            number = np.flatnonzero(scores > max(enough, 0.0))
            number = number[number != without]
            best, cosine = np.concatenate((best, number)), np.concatenate((cosine, scores[number]))
            if len(cosine) > 4 * k:
                ahead = cosine >= np.partition(cosine, -k)[-k]
                best, cosine = best[ahead], cosine[ahead]
            top = np.lexsort((best, -cosine))[:k]
            best, cosine, done, step = best[top], cosine[top], done + step, step * 4
        return best, cosine

    def features(self, best: np.ndarray, cosine: np.ndarray) -> tuple[float, float, float, float]:
        vote, near = float((cosine * self.labels[best]).sum() / cosine.sum()) - 0.5, float(cosine.mean())
        return 1.0, vote, near, near * vote

    def probability(self, best: np.ndarray, cosine: np.ndarray) -> float:
        if not len(best):
            return self.unmatched
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.features(best, cosine), self.curve), -30, 30))))

    def telling(self, at: np.ndarray, weight: np.ndarray, example: int) -> list[str]:
        """The terms that add most to the cosine with one example."""
        first, last = self.first[at], self.first[at + 1]
        cells = _ranges(first, last)
        own = np.flatnonzero(self.cell_block[cells] == example // BLOCK)
        begin, end = self.cell_begin[cells[own]], self.cell_begin[cells[own] + 1]
        postings, term = _ranges(begin, end), np.repeat(np.repeat(np.arange(len(at)), last - first)[own], end - begin)
        hit = self.example[postings] == example
        share = self.weight[postings[hit]] * weight[term[hit]]
        return [self.names[at[term[hit][i]]] for i in np.argsort(-share, kind="stable")[:TELLING]]

    def score(self, text: str | None) -> tuple[float, list[dict], list[str]]:
        at, n = self.matched(words_of(text))
        if not len(at):
            return self.unmatched, [], []
        at, weight = self.vector(at, n)
        best, cosine = self.nearest(at, weight, NEIGHBOURS)
        evidence = [{"doc_id": None if self.ids[i] is None else int(self.ids[i]), "toxic": int(self.labels[i]), "similarity": float(c)} for i, c in zip(best[:3].tolist(), cosine[:3].tolist(), strict=True)]
        score = self.probability(best, cosine)
        return score, evidence, self.telling(at, weight, int(best[0])) if score >= 0.5 and len(best) else []


def build(ids: list, texts: list[str | None], labels: list[int], totals: tuple[float, float], document_counts=None) -> Index:
    """An index over labelled examples. ``totals``: rows of label 0 and 1 that the examples stand for;
    ``document_counts(terms)``: how many documents there are, and how many have each term."""
    y = np.array(labels, np.int64)
    counted = [counted_terms(words_of(t)) for t in texts]
    names, telling = separation(counted, y)
    n, df = document_counts(names) if document_counts else _own_counts(names, counted)
    number = {t: i for i, t in enumerate(names)}
    index = Index(number, (np.log((n + 1) / (np.asarray(df, float) + 1)) + 1e-3) * telling, np.empty(0, object), np.empty(0, np.int64))
    vectors = {i: index.vector(*_sorted({number[t]: k for t, k in c.items()})) for i, c in enumerate(counted) if c}
    # Examples of one label and heaviest term lie together, so that blocks differ and bounds are tight.
    kept = sorted(vectors, key=lambda i: (y[i], int(vectors[i][0][vectors[i][1].argmax()]), i))
    index.ids, index.labels = np.array([ids[i] for i in kept], object), y[kept]
    index.add([vectors[i] for i in kept])
    each = np.array(totals) / np.bincount(y, minlength=2).clip(1)
    bare = np.bincount(y[[i for i in range(len(y)) if i not in vectors]], minlength=2) * each
    index.unmatched = float((bare[1] + totals[1] / max(1.0, sum(totals))) / (bare.sum() + 1)) if sum(totals) else 0.0
    _calibrate(index, [vectors[i] for i in kept], each)
    return index


def _sorted(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    at = np.array(sorted(counts))
    return at, np.array([counts[t] for t in at.tolist()])


def _own_counts(names: list[str], counted: list[Counter]) -> tuple[int, np.ndarray]:
    found: Counter = Counter()
    for terms in counted:
        found.update(terms.keys())
    return len(counted), np.array([found[t] for t in names], float)


def _calibrate(index: Index, vectors: list, each: np.ndarray) -> None:
    """A logistic curve over votes and closeness by damped Newton steps; every example is scored without itself."""
    x, y = [], []
    for i, vector in enumerate(vectors):
        best, cosine = index.nearest(*vector, NEIGHBOURS, without=i)
        if len(best):
            x.append(index.features(best, cosine))
            y.append(index.labels[i])
    if not x:
        return
    x, y = np.array(x), np.array(y, float)
    w = each[y.astype(int)]
    w = w / w.mean()
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-(x @ beta).clip(-30, 30)))
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(beta))
        beta = beta + np.linalg.solve(hessian, x.T @ (w * (y - p)) - 0.05 * beta).clip(-2, 2)
    index.curve = tuple(float(b) for b in beta)


def document_counter(docs: DataFrame):
    """Counts over every document: each task sends one row per term that it met."""

    def counts(terms: list[str]) -> tuple[float, np.ndarray]:
        number = {t: i for i, t in enumerate(terms)}
        shipped = docs.sparkSession.sparkContext.broadcast(Index(number, np.empty(0), np.empty(0), np.empty(0)))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, n = np.zeros(len(terms), np.int64), 0
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    n += 1
                    found[shipped.value.matched(words_of(text))[0]] += 1
            met = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1)), pa.array(np.append(found[met], n))], ["term", "n"])

        total, out = 0, np.zeros(len(terms))
        for row in docs.select("text").mapInArrow(part, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            if row["term"] < 0:
                total = row["n"]
            else:
                out[row["term"]] = row["n"]
        return total, out

    return counts


def fit(docs: DataFrame, learned: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Index:
    """An index over at most ``per_label`` rows of each label, the first by a hash; frequencies of ``docs``.

    Ids alone meet the labels; the texts of the drawn rows, whose number is bounded, are then picked by broadcast.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = learned.select("doc_id").join(marks, "doc_id")
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, 2 * per_label / max(1, totals.get(y, 0))) for y in (0, 1)}
    # Twice the wanted share by hash, so that enough are left; of these the first of each label by the same hash.
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    near = known.where(draw < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])).select("doc_id", "toxic", draw.alias("draw")).distinct()
    ids = near.where("toxic = 0").orderBy("draw", "doc_id").limit(per_label).unionByName(near.where("toxic = 1").orderBy("draw", "doc_id").limit(per_label))
    texts = learned.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = texts.toPandas().sort_values("doc_id")
    return build(rows["doc_id"].tolist(), rows["text"].tolist(), rows["toxic"].tolist(), (totals.get(0, 0), totals.get(1, 0)), document_counter(docs))


def toxicity_column(text: Column, index: Index, spark) -> Column:
    shipped = spark.sparkContext.broadcast(index)

    @F.pandas_udf(RESULT)
    def toxicity(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([shipped.value.score(t) for t in batch], columns=["score", "neighbours", "terms"])

    return toxicity(text)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = crc_of_id("doc_id") % 3 == 1
    index = fit(docs, docs.where(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity_column(F.col("text"), index, spark).alias("r"))
    return scored.select("doc_id", "held_out", F.col("r.score").alias("score"), (F.col("r.score") >= THRESHOLD).cast("int").alias("predicted"), F.col("r.neighbours").alias("neighbours"), F.col("r.terms").alias("terms"))
