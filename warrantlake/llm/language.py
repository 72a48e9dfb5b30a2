"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's letters, lower-cased, with every run of other characters as one space, give character n-grams; each is
hashed to a row of an embedding table, the rows are averaged over the whole text, and a softmax over the mean
names the language. Table and softmax are trained together by stochastic gradient descent in numpy, on a bounded
sample of rows of every language. A held-out part of that sample sets the temperature of the scores and the score
below which a text is rejected: the split-conformal quantile that rejects at most the share ``REJECTED`` of whole
texts of the known languages, for texts that come from where the sample does. Where the sample holds too few such texts
to tell that share (below 199 at 0.005), the threshold is halfway between the least of their scores and chance.

Nulls and empties: a text that is null or has no letter is ``und`` with score 0 and is rejected. Rows of null
``lang`` are never learned from. With nothing to learn from, every text is ``und``. Very long texts are read whole.
Copies get equal rows and are learned from once, whatever
their number: a language's share is taken of its distinct texts, and it keeps one at least. An empty table gives no rows, and columns other than ``text`` and
``lang`` aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warrantlake.llm.common import crc_of_id, written

#: Bounds of the training sample: about so many texts of each language, and about so many in all where languages are many.
PER_LANGUAGE, IN_ALL = 700, 50_000
#: Languages whose shares are broadcast; were there more, they are joined.
FEW_LANGUAGES = 10_000
BUCKETS, DIMENSIONS, SIZES = 8192, 16, (1, 2, 3)
#: Share of whole held-out texts of known languages, told right, that may be rejected (wrong ones say nothing about
#: how well a known language scores).
REJECTED = 0.005
UNKNOWN = "und"
RESULT = "lang_pred string, score double, rejected boolean"

_LETTER = np.zeros(0x110000, bool)
_LETTER[[c for c in range(0x110000) if chr(c).isalpha()]] = True


def buckets(text: str | None) -> np.ndarray:
    """The table rows of a text's n-grams; none if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letters = _LETTER[codes]
    if not letters.any():
        return np.empty(0, np.int64)
    kept = letters.copy()
    kept[1:] |= letters[:-1]  # one space after each run of letters
    codes = np.where(letters, codes, np.uint32(32))[kept].astype(np.uint64)
    codes = np.concatenate((np.full(1, 32, np.uint64), codes))
    out, rolling = [], np.zeros(len(codes), np.uint64)
    for size in range(1, max(SIZES) + 1):
        rolling = rolling[: len(codes) - size + 1] * np.uint64(0x100000001B3) + codes[size - 1 :]
        if size in SIZES:
            out.append(((rolling * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size)) >> np.uint64(64 - 13)).astype(np.int64))
        if len(codes) <= size:
            break
    return np.concatenate(out)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, rows: np.ndarray) -> np.ndarray:
        counts = np.bincount(rows, minlength=BUCKETS).astype(np.float32)
        return (counts @ self.table / len(rows)) @ self.weights + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        rows = buckets(text)
        if not len(rows) or not self.languages:
            return UNKNOWN, 0.0, True
        p = _softmax(self.logits(rows)[None, :] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], epochs: int = 12, rate: float = 0.5, seed: int = 5) -> Model:
    """Whole texts and short stretches of them, so that short texts are scored as well."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    fold = rng.random(len(texts)) < 0.25
    samples: list[tuple[np.ndarray, np.ndarray, int, bool, bool]] = []
    for text, lang, held in zip(texts, langs, fold, strict=True):
        words = text.split()
        stretches = [text]
        for _ in range(2 if len(words) > 4 else 0):
            at = int(rng.integers(0, len(words) - 2))
            stretches.append(" ".join(words[at : at + int(rng.integers(2, 12))]))
        for stretch in stretches:
            rows = buckets(stretch)
            if len(rows):
                row, count = np.unique(rows, return_counts=True)
                samples.append((row, (count / len(rows)).astype(np.float32), names.index(lang), bool(held), stretch is text))
    model = Model(names, rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32), np.zeros((DIMENSIONS, len(names)), np.float32), np.zeros(len(names), np.float32))
    model.weights += rng.normal(0, 0.1, model.weights.shape).astype(np.float32)
    learn = [s for s in samples if not s[3]]
    share = np.bincount([s[2] for s in learn], minlength=len(names)).clip(1)
    step = 0
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(len(learn)), max(1, len(learn) // 32)):
            if not len(batch):
                continue
            rows = np.concatenate([learn[i][0] for i in batch])
            of = np.repeat(np.arange(len(batch)), [len(learn[i][0]) for i in batch])
            value = np.concatenate([learn[i][1] for i in batch])
            dense = np.zeros((len(batch), BUCKETS), np.float32)
            dense[of, rows] = value
            y = np.array([learn[i][2] for i in batch])
            hidden = dense @ model.table
            error = _softmax(hidden @ model.weights + model.bias)
            error[np.arange(len(y)), y] -= 1
            error *= (len(learn) / (len(names) * share[y]))[:, None] / len(y)
            lr = rate * 20 * (1 - epoch / epochs)
            back = error @ model.weights.T
            model.weights -= lr * 0.1 * hidden.T @ error
            model.bias -= lr * 0.01 * error.sum(axis=0)
            model.table -= lr * dense.T @ back
            step += 1
    _calibrate(model, [s for s in samples if s[3]] or learn)
    return model


def _calibrate(model: Model, held: list) -> None:
    if not held:
        return
    logits = np.array([(v @ model.table[r]) @ model.weights + model.bias for r, v, *_ in held])
    y = np.array([s[2] for s in held])
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(y)), y].clip(1e-9)).mean()
    model.temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
    p = _softmax(logits / model.temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    whole = np.sort(score[np.array([s[4] for s in held]) & right])
    rank, chance = int((len(whole) + 1) * REJECTED), 1 / len(model.languages)
    # With too few texts to tell so small a share: halfway between the least of their scores and chance.
    model.threshold = float(whole[rank - 1]) if rank else float(whole[0] + chance) / 2 if len(whole) else 0.0


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> DataFrame:
    """About ``per_language`` distinct texts of each language, those of the smallest hashes, and one at least.

    The bound is the classifier's training sample alone; what it predicts covers every row. Where languages are so
    many that the bounds of all would be more than ``in_all``, each one's is the smaller.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    texts = known.select("lang", draw.alias("draw")).groupBy("lang").agg(F.count_distinct("draw").alias("texts"), F.min("draw").alias("least"))
    shares = written(texts, "shares")
    languages = shares.count()
    bound = max(1.0, min(per_language, in_all / max(languages, 1)))
    shares = shares.select("lang", "least", (F.lit(bound) / F.col("texts") * float(1 << 40)).alias("upto"))
    met = known.join(F.broadcast(shares) if languages <= FEW_LANGUAGES else shares, "lang")
    return met.where((draw < F.col("upto")) | (draw == F.col("least"))).select("lang", "text").distinct()


def fit(docs: DataFrame) -> Model:
    rows = training_sample(docs).toPandas()
    order = rows.assign(key=pd.util.hash_pandas_object(rows["text"], index=False)).sort_values(["key", "lang", "text"]).index
    rows = rows.loc[order]
    return train(rows["text"].tolist(), rows["lang"].tolist()) if len(rows) else Model([], np.zeros((BUCKETS, DIMENSIONS), np.float32), np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0, np.float32))


def language_column(text: Column, model: Model, spark) -> Column:
    shipped = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def identify(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([shipped.value.predict(t) for t in batch], columns=["lang_pred", "score", "rejected"])

    return identify(text)


def held_out(divisor: int, rest: int) -> Column:
    return crc_of_id("doc_id") % divisor == rest


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(4, 2)))
    return docs.select("doc_id", held_out(4, 2).alias("held_out"), language_column(F.col("text"), model, spark).alias("r")).select("doc_id", "held_out", "r.*")
