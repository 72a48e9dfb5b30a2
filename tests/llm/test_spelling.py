"""Spelling variants against plain Python: every pair of words, counted over whole texts."""

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from warrantlake.llm import registry, spelling

SF = "/root/testdata/sf0.001"


def vocabulary_of(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    """Exactly one character replaced, inserted or deleted."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_of(rows):
    words = vocabulary_of(rows)
    by_length, found = defaultdict(list), defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    for w in words:
        found[w] = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_length[size] if near(w, v)]
    form = {w: (min(found[w], key=lambda v: (-words[v], v)) if found[w] else None) for w in words}
    form = {w: v if v and words[v] >= 2 * words[w] else None for w, v in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(found[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def rows_of(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_the_query_equals_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = variants_of(rows)
    assert sum(r[1] is not None for r in want) > 20
    assert rows_of(registry.queries()["op12_bloom_edits"](spark, SF)) == want


def made_up(seed):
    """Words over few letters, so that neighbourhoods are dense, ties are common and paths are long."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abßé") for _ in range(rng.choice((5, 5, 6, 7)))) for _ in range(150)]
    words += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "Straße", "STRAßE", "naïve", "Éclair", "éclair", "x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 150]
    return [(rng.choice((None, 1, 2, 3)), " ".join(rng.choice(words[: 1 + int(len(words) * rng.random() ** 3)]) + rng.choice((" ", "-", "7", "\n", "Ω")) for _ in range(rng.randrange(600)))) for _ in range(25)] + [(9, " ".join(words * 3)), (9, None), (9, ""), (10, "1 2 3")]


@pytest.mark.parametrize("how", [{}, {"bits": 1}, {"pass_bytes": 4096}, {"pass_bytes": 64, "bits": 512}])
def test_dense_neighbourhoods_in_any_number_of_passes(spark, how):
    rows = made_up(len(how))
    want = variants_of(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "length", "id", "edit")})
    got = rows_of(spelling.variants(docs.repartition(3), **how))
    assert got == want
    assert any(r[1] and r[1] != r[2] for r in want)


def test_passes_are_of_bounded_size_and_hold_every_length():
    passes = spelling.plan({5: 10, 6: 100_000, 7: 3, 900: 1}, pass_bytes=65_536)
    assert all(sum(f.blocks * spelling.LANES * 8 for f in p) <= 65_536 for p in passes)
    assert {f.length for p in passes for f in p} == {5, 6, 7, 900}
    assert sorted(f.part for p in passes for f in p if f.length == 6) == list(range(next(f.parts for p in passes for f in p if f.length == 6)))


def test_hashes_of_edits_are_those_of_their_strings():
    f = spelling.Filter(5, 0, 1, 8)
    f.bits = np.full((8, spelling.LANES), ~np.uint64(0))
    assert set(spelling.deleted(["aabcdd"], 6, f)) == {(0, "abcdd"), (0, "aacdd"), (0, "aabdd"), (0, "aabcd")}
    letters = np.array([ord(c) for c in "abz"], np.uint64)
    assert set(spelling.replaced(["abc"], 3, letters, f)) == {(0, "bbc"), (0, "zbc"), (0, "azc"), (0, "abz")}
    words = ["abcde", "abcdf", "éßÿab"]
    whole = spelling.hashes(words, 5)
    assert len(set(whole.tolist())) == 3
    for word in ("xabcde", "abxcde", "abcdex"):
        seen = []
        f.has = lambda h: seen.append(h) or np.empty(0, np.int64)
        assert not list(spelling.deleted([word], 6, f))
        assert whole[0] in seen[0]


def test_filters_hold_their_words_and_few_others(spark):
    words = [f"{a}{b}{c}de" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghijklmnopqrst"]
    table = spark.createDataFrame([(w, 3, 5) for w in words], "word string, n long, length int")
    f = spelling.built(table, spelling.plan({5: len(words)})[0])[0]
    assert len(f.has(spelling.hashes(words, 5))) == len(words)
    others = [w[::-1] for w in words]
    assert len(f.has(spelling.hashes([w for w in others if w not in set(words)], 5))) < 0.01 * len(words)


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, "ab abc"), (2, None)], "doc_id long, text string")).collect() == []
