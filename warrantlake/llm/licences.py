"""Licence scan by a positional index of rare licence words.

Templates are short licence notices. Over all documents, the document frequency of every template word is
counted; each template is indexed by its words of the highest IDF, with their positions. In a text, the words of
that index are looked up; each posting votes for the place where its template would begin, and votes that meet at
one place are an alignment. An alignment of enough of a template's rare words becomes a label once all mandatory
phrases of the template stand, word by word, within the stretch of text that it covers. Its score is the IDF share
of the template's words that stand where they should.

Base phrases are counted on their own, wherever their words stand consecutively. Nulls: a null text has no words.
Empty texts have empty labels and score 0. Copies are scanned alike. Words are those of the whole text, so very
long texts have all their places found. An empty table gives no rows. Only ``text`` is read, and the result is one
column, which the caller names, so other columns may have any name.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTING = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,word:long,score:double>>"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, notice, and the phrases that have to stand in it.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["except in compliance with the license", "apache org licenses license 2 0"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ["gnu affero general public license version 3"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ["cc by nc sa 4 0"]),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"]),
    ("cc0-1.0", "cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd-3-clause", "licensed under the bsd 3 clause license", ["bsd 3 clause"]),
    ("bsd-2-clause", "licensed under the bsd 2 clause license", ["bsd 2 clause"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
]
#: Rare words by which a template is indexed, the share of them that an alignment needs, and the least score.
RARE, ALIGNED, LEAST = 5, 0.6, 0.5


def words_of(text: str | None) -> list[str]:
    return (text or "").encode().translate(_PARTING).decode().split()


def template_words() -> set[str]:
    return {w for _, notice, _ in TEMPLATES for w in notice.split()}


@dataclass
class RareIndex:
    """``postings[word]``: (template, position) of the words by which templates are found."""

    postings: dict[str, list[tuple[int, int]]]
    notices: list[list[str]]
    idf: dict[str, float]
    needed: list[int]
    share: list[float]

    @classmethod
    def of(cls, documents: int, frequency: dict[str, int]) -> RareIndex:
        idf = {w: float(np.log((documents + 1) / (frequency.get(w, 0) + 1)) + 0.01) for w in template_words()}
        postings, notices, needed, share = defaultdict(list), [], [], []
        for number, (_, notice, _) in enumerate(TEMPLATES):
            words = notice.split()
            rare = sorted(range(len(words)), key=lambda at: (-idf[words[at]], at))[:RARE]
            for at in rare:
                postings[words[at]].append((number, at))
            notices.append(words)
            needed.append(max(1, int(np.ceil(ALIGNED * len(rare)))))
            share.append(sum(idf[w] for w in words))
        return cls(dict(postings), notices, idf, needed, share)

    def alignments(self, words: list[str]) -> Iterator[tuple[int, int, float]]:
        """(template, place of its first word, score) where enough rare words stand in their relative positions."""
        votes: Counter = Counter()
        for at, word in enumerate(words):
            for number, position in self.postings.get(word, ()):
                votes[number, at - position] += 1
        for (number, start), n in votes.items():
            if n >= self.needed[number]:
                notice = self.notices[number]
                met = sum(self.idf[w] for i, w in enumerate(notice) if 0 <= start + i < len(words) and words[start + i] == w)
                yield number, start, met / self.share[number]

    def labels(self, words: list[str]) -> list[tuple[str, int, float]]:
        """Verified (label, place, score)."""
        found = []
        for number, start, score in self.alignments(words):
            label, _, phrases = TEMPLATES[number]
            stretch = f" {' '.join(words[max(0, start) : start + len(self.notices[number])])} "
            if score >= LEAST and all(f" {p} " in stretch for p in phrases):
                found.append((label, max(0, start), score))
        return sorted(found)


_BASE_WORDS = {tuple(p.split()): label for p, label in BASE.items()}
_BY_FIRST = defaultdict(list)
for _phrase in _BASE_WORDS:
    _BY_FIRST[_phrase[0]].append(_phrase)


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase."""
    out = []
    for at, word in enumerate(words):
        for phrase in _BY_FIRST.get(word, ()):
            if tuple(words[at : at + len(phrase)]) == phrase:
                out.append((at, _BASE_WORDS[phrase]))
    return out


def scan(text: str | None, index: RareIndex) -> tuple:
    words = words_of(text)
    base, found = base_places(words), index.labels(words)
    starts = [at for at, _ in base]
    labels = {label for _, label in base}
    score = max([1.0 if base else 0.0, *(s for _, _, s in found)])
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {name for name, _, _ in found})), min(1.0, score),
        [{"label": name, "word": at, "score": s} for name, at, s in found],
    )


def fit(docs: DataFrame) -> RareIndex:
    """Document frequencies of the template words over every document: a bounded number of counts from each task."""
    wanted = template_words()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = Counter(), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n += 1
                counts.update(wanted.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.string()), pa.array([*counts.values(), n], pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(part, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    frequency = {r["word"]: r["n"] for r in rows}
    return RareIndex.of(frequency.pop(None, 0), frequency)


def licence_column(text: Column, index: RareIndex) -> Column:
    @F.pandas_udf(RESULT)
    def scanned(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            found = pd.DataFrame([scan(t, index) for t in batch], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"])
            yield found.astype({"first_word": "Int64", "last_word": "Int64"})

    return scanned(text)


def op7_rare_tokens(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", licence_column(F.col("text"), fit(docs)).alias("r")).select("doc_id", "r.*")
