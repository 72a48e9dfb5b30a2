"""Split tables, scoring logs, label categories, probe scores, overrides by their body, and pairs of models."""

import pytest
from pyspark.sql import functions as F

from warrantlake.operators import categories as K
from warrantlake.operators import ledger as L
from warrantlake.operators import paired as D
from warrantlake.operators import thresholds as H
from warrantlake.plans import q_sources as Q
from warrantlake.sources import scorings as G
from warrantlake.sources import splits as P
from warrantlake.sources.views import scored_items

SCHEMA = "item_id long, group string, aliases array<string>, split string"
GOOD = [(1, "a", ["x"], "train"), (2, "a", None, "train"), (3, "b", [], "test")]


def test_splits_come_back_with_required_columns_alone(spark, tmp_path):
    path = str(tmp_path / "s")
    P.save(spark.createDataFrame(GOOD, SCHEMA).withColumn("extra", F.lit(1)), path)
    got = P.load(spark, path)
    assert got.columns == list(P.COLUMNS)
    assert sorted((r["item_id"], r["aliases"]) for r in got.collect()) == [(1, ["x"]), (2, []), (3, [])]
    with pytest.raises(Exception, match="(?i)exists"):
        P.save(spark.createDataFrame(GOOD, SCHEMA), path)


@pytest.mark.parametrize(
    ("rows", "wrong"),
    [
        ([(4, "a", None, "test")], "1 groups in several splits"),
        ([(1, "a", None, "train")], "1 items more than once"),
        ([(4, "c", None, "dev")], "1 rows without"),
        ([(4, "c", None, None), (None, "d", None, "test"), (6, None, None, "test")], "3 rows without"),
        ([], None),
    ],
)
def test_broken_splits_are_refused_on_reading(spark, tmp_path, rows, wrong):
    path = str(tmp_path / "s")
    spark.createDataFrame(GOOD + rows, SCHEMA).write.parquet(path)
    if wrong is None:
        assert P.load(spark, path).count() == 3
    else:
        with pytest.raises(ValueError, match=wrong):
            P.load(spark, path)


def test_missing_and_mistyped_columns_are_named(spark, tmp_path):
    df = spark.createDataFrame(GOOD, SCHEMA).drop("aliases").withColumn("item_id", F.col("item_id").cast("string"))
    with pytest.raises(ValueError, match="item_id is string, not bigint; aliases is missing"):
        P.save(df, str(tmp_path / "a"))
    df.write.parquet(str(tmp_path / "b"))
    with pytest.raises(ValueError, match="item_id is string, not bigint; aliases is missing"):
        P.load(spark, str(tmp_path / "b"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "c"))
    assert P.load(spark, str(tmp_path / "c")).count() == 0


def record(spark, *rows):
    return spark.createDataFrame(rows, "test_set string, at long, record string")


def add(spark, path, *rows, first=False):
    G.append(record(spark, *rows), path, F.col("at"), ["at", "record"], first)


def test_scorings_only_ever_add_up(spark, tmp_path):
    path = str(tmp_path / "log")
    add(spark, path, ("a", 2, "second"), ("a", 1, "first"), ("b", 1, "only"), first=True)
    add(spark, path, ("a", 0, "third"), ("a", 0, "third"), ("c", 5, "new"))
    log = G.read(spark, path)
    assert sorted((r["test_set"], r["scoring"], r["record"]) for r in log.collect()) == [("a", 1, "first"), ("a", 2, "second"), ("a", 3, "third"), ("a", 4, "third"), ("b", 1, "only"), ("c", 1, "new")]
    assert {r["test_set"]: r["n_scorings"] for r in G.counts(log).collect()} == {"a": 4, "b": 1, "c": 1}
    with pytest.raises(Exception, match="(?i)exists"):
        add(spark, path, ("a", 1, "again"), first=True)


@pytest.mark.parametrize("rows", [[("a", 2)], [("a", 1), ("a", 1)], [("a", 1), ("a", 3)], [("a", None)], [("a", 0), ("a", 1)]])
def test_a_corrupt_log_is_not_appended_to(spark, tmp_path, rows):
    path = str(tmp_path / "log")
    spark.createDataFrame([(s, n, "r") for s, n in rows], "test_set string, scoring long, record string").write.parquet(path)
    with pytest.raises(ValueError, match="corrupt"):
        add(spark, path, ("a", 9, "x"))
    assert spark.read.parquet(path).count() == len(rows)


def test_another_table_is_not_a_log(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "log"))
    with pytest.raises(ValueError, match="isn't a log"):
        add(spark, str(tmp_path / "log"), ("a", 9, "x"))


def test_categories_come_from_the_own_entry_or_that_of_the_base(spark):
    declared = spark.createDataFrame([("x", "toxicity"), ("x-fixture", "identifier"), ("hard", None), ("y-synthetic", "toxicity")], "eval_set_id string, category string")
    ids = ["x", "x-synthetic", "x-fixture", "x-fixture-synthetic", "x-synthetic-fixture", "hard", "hard-fixture", "y", "y-synthetic", "z"]
    got = {r["eval_set_id"]: (r["category"], r["declared"]) for r in K.category_of(spark.createDataFrame([(i,) for i in ids * 2], "eval_set_id string"), declared).collect()}
    assert got == {
        "x": ("toxicity", True), "x-synthetic": ("toxicity", True), "x-fixture": ("identifier", True), "x-fixture-synthetic": ("identifier", True), "x-synthetic-fixture": (None, False),
        "hard": (None, True), "hard-fixture": (None, True), "y": (None, False), "y-synthetic": ("toxicity", True), "z": (None, False),
    }
    pairs = spark.createDataFrame([("toxicity", "x"), ("identifier", "x"), (None, "x"), ("toxicity", "hard"), ("toxicity", "z"), (None, "z"), ("toxicity", None)], "detector_category string, eval_set_id string")
    assert {(r["detector_category"], r["eval_set_id"]): r["outcome"] for r in K.compatible(pairs, declared).collect()} == {
        ("toxicity", "x"): "compatible", ("identifier", "x"): "mismatch", (None, "x"): "compatible", ("toxicity", "hard"): "compatible", ("toxicity", "z"): "undeclared", (None, "z"): "undeclared", ("toxicity", None): "undeclared",
    }


def test_probe_scores_lie_between_the_two_highest_thresholds(spark):
    rows = [("a", 0.2), ("a", 0.8), ("a", 0.4), ("b", 0.7), ("b", 0.7), ("b", 0.1), ("c", 0.5), ("c", None), ("d", None), ("e", 0.1), ("e", 0.1), ("e", 0.9)]
    got = {r["k"]: (r["probe_score"], r["problem"]) for r in H.probe_score(spark.createDataFrame(rows, "k string, threshold double"), ["k"]).collect()}
    assert got == {"a": (pytest.approx(0.6), None), "b": (None, "the two highest thresholds are equal"), "c": (None, "fewer than two thresholds"), "d": (None, "fewer than two thresholds"), "e": (pytest.approx(0.5), None)}


def test_all_budgets_take_one_pass_over_the_scores(spark, monkeypatch):
    sf_dir, windows = "/root/testdata/sf0.001", []
    for budgets in ([0.2], [0.05, 0.1, 0.2]):
        monkeypatch.setattr(Q, "BUDGETS", budgets)
        plan = Q.QUERIES["th20_probe_score"][0](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        windows.append(plan.count("Window ["))
    assert windows[0] == windows[1] > 0
    items = scored_items(spark, sf_dir)
    every = {(r["eval_set_id"], r["budget"]): r["threshold"] for r in H.within_budgets(items, ["eval_set_id"], budgets).collect()}
    for budget in budgets:
        one = {r["eval_set_id"]: r["threshold"] for r in H.within_budget(items, ["eval_set_id"], budget).collect()}
        assert one == {k: v for (k, b), v in every.items() if b == budget}


def test_overrides_are_found_by_the_certificate_in_their_body(spark):
    rows = [(1, "override", '{"certificate_id":"C"}'), (2, "warrant", '{"certificate_id":"C"}'), (3, "override", '{"other":"C"}'), (4, "override", None), (5, "override", "{"), (6, "override", '{"certificate_id":"Z"}'), (7, "override", '{"certificate_id":"C"}')]
    got = L.overrides_of(spark.createDataFrame(rows, "seq long, kind string, body string"), spark.createDataFrame([("C",), ("D",)], "certificate_id string"))
    assert sorted(r["seq"] for r in got.collect()) == [1, 7]


def test_pairs_of_models(spark):
    items = spark.createDataFrame([("s", i, f"g{i % 30}", int(i % 3 == 0), (i * 37 % 101) / 101, (i * 37 % 101) / 101) for i in range(120)] + [("few", i, "g", 1, 0.5, 0.5) for i in range(5)], "k string, item_id long, unit string, label int, baseline double, variant double")
    split = items.select("k", "item_id", F.when(F.col("item_id") < 60, "test").otherwise("train").alias("split"))
    other = items.select("k", "item_id", F.when(F.col("item_id") % 2 == 0, "test").otherwise("train").alias("split"))
    r = {x["k"]: x for x in D.relationship(split, other, ["k"], "item_id", 30).collect()}
    assert (r["s"]["n_paired"], r["s"]["leaked_from_old_train"], r["s"]["leaked_from_new_train"], r["s"]["usable"]) == (30, 30, 30, True)
    assert not r["few"]["usable"]
    got = D.compare_models(items, split, other, ["k"], "item_id", "unit", [0.2], 50, "pairs", 30).collect()
    assert [(x["k"], x["verdict"], x["difference"]) for x in got if x["k"] == "few"] == [("few", "REFUSED", None)]
    same = [x for x in got if x["k"] == "s"]
    # One draw for both: models with the same scores differ by nothing, in every replicate.
    assert {(x["regime"], x["quantity"]) for x in same} == {(a, b) for a in ("pinned", "own") for b in ("auroc", "recall@0.2")}
    assert all((x["difference"], x["ci_low"], x["ci_high"], x["standard_error"], x["verdict"]) == (0, 0, 0, 0, "bounded") for x in same)
