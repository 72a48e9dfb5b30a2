"""Selectors: exactly one element, dotted keys, and a stated problem wherever a path can't be followed."""

import json

import pytest
from pyspark.sql import functions as F

from warrantlake.functions import paths

DOC = {"runs": [{"id": "a", "v": 1}, {"id": "b", "v": {"x": [1, 2]}}, {"id": "b2", "v": None}], "ops": [{"op": {"id": "P-x"}, "v": 7, "ok": True}, {"op": {"id": "P-y"}, "v": 9.5, "ok": False}], "twice": [{"id": "a"}, {"id": "a"}], "m": {"auroc": {"value": 0.75}}, "none": None, "empty": []}


@pytest.mark.parametrize(
    ("path", "value", "problem"),
    [
        ("m.auroc.value", "0.75", None),
        ("m.auroc.mean", None, "mean: not found"),
        ("m.nothing.mean", None, "nothing: not found"),
        ("runs[id=a].v", "1", None),
        ("runs[id=b].v.x", "[1,2]", None),
        ("runs[id=c]", None, "runs: matched 0 elements"),
        ("twice[id=a].v", None, "twice: matched 2 elements"),
        ("ops[op.id=P-y].v", "9.5", None),
        ("ops[op.id=P-x,v=7].v", "7", None),
        ("ops[op.id=P-x,v=8].v", None, "ops: matched 0 elements"),
        ("ops[ok=True].v", "7", None),
        ("runs[v=None].id", "b2", None),
        ("runs.id", None, "id: a list without a selector"),
        ("m[id=a]", None, "m: not a list"),
        ("absent[id=a]", None, "absent: not found"),
        ("empty[id=a]", None, "empty: matched 0 elements"),
        ("none.x", None, "x: not found"),
    ],
)
def test_paths(spark, path, value, problem):
    r = spark.createDataFrame([(json.dumps(DOC),)], "d string").select(paths.text_at(F.col("d"), path).alias("r")).first()["r"]
    assert (r["value"], r["problem"]) == (value, problem)


def test_absent_and_broken_documents(spark):
    rows = spark.createDataFrame([(1, None), (2, "{broken"), (3, "[1]")], "i int, d string").select("i", paths.text_at(F.col("d"), "a").alias("r")).orderBy("i").collect()
    assert [r["r"]["problem"] for r in rows] == ["no document", "broken document", "a: a list without a selector"]


@pytest.mark.parametrize("path", ["a[b", "a]b", "a[[b=1]]", "", "a[b]", "a['x']", ".."])
def test_paths_that_cannot_be_parsed_are_refused(path):
    with pytest.raises(ValueError):
        paths.parse(path)


def test_dots_inside_a_selector_belong_to_it():
    assert paths.parse("ops[op.id=P-x.1].v") == [paths.Step("ops", ((("op", "id"), "P-x.1"),)), paths.Step("v")]
