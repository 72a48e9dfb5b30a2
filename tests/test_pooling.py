"""Pooling against numpy, violations one by one, and questions beyond ASCII against plain Python."""

import re
import unicodedata
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from warrantlake.functions import text
from warrantlake.operators import pooling
from warrantlake.plans import q_pooling

P = "seq int, pos int, selected boolean, vec array<double>"


@pytest.mark.parametrize(("window", "stride"), [(4, 2), (4, 3), (3, 1), (5, 5), (1, 1), (50, 7)])
def test_pooled_vectors_are_numpys(spark, window, stride):
    rng = np.random.default_rng(window)
    seqs = {s: (rng.normal(size=(n, 3)), rng.random(n) < 0.7) for s, n in enumerate((1, 2, 5, 9, 14, 23, 40))}
    rows = [(s, p, bool(m[p]) or not m.any(), x[p].tolist()) for s, (x, m) in seqs.items() for p in range(len(x))]
    table = spark.createDataFrame(rows, P)
    got = {k: {(r["seq"], r["dim"]): r["value"] for r in pooling.pooled(table, "seq", k, window, stride).collect()} for k in pooling.STRATEGIES}
    for s, (x, m) in seqs.items():
        kept = x[m] if m.any() else x
        cuts = list(range(0, max(len(kept) - window, 0) + 1, stride))
        if len(kept) > window and cuts[-1] + window < len(kept):
            cuts.append(len(kept) - window)
        want = {"mean_pool": kept.mean(axis=0), "last_token": kept[-1], "max_rolling_means": np.max([kept[c : c + window].mean(axis=0) for c in cuts], axis=0)}
        for strategy, values in want.items():
            assert np.allclose([got[strategy][(s, k)] for k in range(3)], values)


def test_violations(spark):
    v = [1.0, 2.0]
    rows = [(0, 0, True, v), (0, 1, False, v), (1, 0, False, v), (1, 1, False, v), (2, 0, True, v), (2, 2, True, v), (3, 0, True, v), (3, 0, True, v), (4, 0, True, v), (4, 1, None, v), (5, 0, True, v), (5, 1, True, [1.0]), (6, 0, True, [])]
    table = spark.createDataFrame(rows, P)
    assert {r["seq"]: r["problem"] for r in pooling.violations(table, "seq").collect()} == {1: pooling.PROBLEMS[3], 2: pooling.PROBLEMS[0], 3: pooling.PROBLEMS[0], 4: pooling.PROBLEMS[1], 5: pooling.PROBLEMS[2], 6: pooling.PROBLEMS[2]}
    for strategy in pooling.STRATEGIES:
        assert {r["seq"] for r in pooling.pooled(table, "seq", strategy).collect()} == {0}
    for bad in ({"strategy": "median"}, {"strategy": "mean_pool", "window": 2, "stride": 3}, {"strategy": "mean_pool", "window": 0, "stride": 0}):
        with pytest.raises(ValueError):
            pooling.pooled(table, "seq", **bad)


def plain(t):
    out = "".join(c if c == "_" or c.isalnum() else " " for c in unicodedata.normalize("NFKC", t).casefold())
    return re.sub(" +", " ", out).strip()


def test_questions_beyond_ascii(spark):
    same = [("Who wrote the Iliad?", "  who wrote THE iliad "), ("Ｗｈｏ　ｗｒｏｔｅ？", "who wrote"), ("ﬁne ﬂour", "FINE flour"), ("Straße", "STRASSE"), ("मैं कौन हूँ?", "मैं कौन हूँ"), ("x² ½", "X2 1⁄2"), ("İstanbul", "i̇stanbul"), ("snake_case", "SNAKE_CASE")]
    rows = [t for pair in same for t in pair] + ["", "?!", "a b\tc\n"]
    got = {r["t"]: r["q"] for r in spark.createDataFrame([(t,) for t in rows] + [(None,)], "t string").select("t", text.folded_question(F.col("t")).alias("q")).collect()}
    assert all(got[t] == plain(t) for t in rows) and got[None] is None
    assert all(got[a] == got[b] for a, b in same)


def test_folded_questions_of_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["digest"], r["length"]) for r in q_pooling._questions(spark, sf).collect()}
    assert got == {i: (sha256(plain(t).encode()).hexdigest(), len(plain(t))) for i, t in texts.items()}
