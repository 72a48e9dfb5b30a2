"""The request loop: the chain of one run, however often the job is killed; state that is refused under another setting."""

import json
import math

import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from warrantlake.operators import drift, ledger
from warrantlake.plans import catalogue, q_session
from warrantlake.sources.views import traffic
from warrantlake.streaming import session

SF, FINE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def warrants(spark):
    return q_session.written(q_session._warrants(spark, FINE), "warrants")


def loop(spark, warrants, stream, where, window=80, p0=q_session.P0, stakes=40, fail_at=None):
    requests = q_session._requests(spark, FINE)
    sink = session.to_ledger(f"{where}/ledger", requests, warrants, window)

    def failing(answers, batch_id):
        sink(answers, batch_id)
        if batch_id == fail_at:
            raise RuntimeError("killed after the append, before the commit")

    session.run(spark, stream, requests, warrants, window, p0, f"{where}/state", failing, stakes)


def test_a_killed_and_resumed_stream_gives_the_chain_of_one_run(spark, warrants, tmp_path):
    requests = q_session._requests(spark, FINE)
    whole = q_session.in_arrival_order(requests, 10**9)
    loop(spark, warrants, whole, tmp_path / "one")
    parts = q_session.in_arrival_order(requests, 1500)
    with pytest.raises(Exception, match="killed"):
        loop(spark, warrants, parts, tmp_path / "two", fail_at=1)
    loop(spark, warrants, parts, tmp_path / "two")
    chains = [spark.read.parquet(f"{tmp_path}/{k}/ledger").orderBy("seq").collect() for k in ("one", "two")]
    assert [r["self_hash"] for r in chains[0]] == [r["self_hash"] for r in chains[1]]
    assert len(chains[0]) == requests.count()
    stored = spark.read.parquet(f"{tmp_path}/two/ledger").withColumn("chain", F.lit(0))
    assert ledger.breaks(stored, "chain").count() == 0
    bodies = [json.loads(r["body"]) for r in chains[0]]
    assert {b["weakest_status"] for b in bodies} == {"VALID", "STALE", "REVOKED", "REFUSED", "UNVALIDATED"}
    assert all(("cited" in b) == ("recall_low" in b) == (b["weakest_status"] in ("VALID", "STALE")) for b in bodies)
    # Changed settings are refused by the state that is there.
    for other in ({"p0": 0.06}, {"stakes": 39}, {"window": 50}):
        more = q_session.in_arrival_order(requests.withColumn("request_id", F.col("request_id") + 10**9), 10**9)
        spark_state = f"{tmp_path}/two"
        with pytest.raises(Exception, match="can't be resumed"):
            resume_with(spark, warrants, more, spark_state, other)


def resume_with(spark, warrants, stream, where, other):
    """A restart that meets new files in the folder that the checkpoint knows."""
    held = {"window": 80, "p0": q_session.P0, "stakes": 40} | other
    observer = session.Observer(held["window"], held["p0"], stakes=held["stakes"])

    class Kept:
        def __init__(self, value):
            self.value = value

        def exists(self):
            return True

        def get(self):
            return self.value

    observer.ring = Kept((80, [1, 2], 2))
    grid = drift.Grid(q_session.P0)
    observer.wager = Kept((grid.p0, grid.low, grid.high, grid.stakes, 10, 1, 0.5))
    import pandas as pd

    frame = pd.DataFrame({"ts": [1], "request_id": [1], "bin": [0], "false_flag": [0], "probabilities": [[0.5, 0.5]]})
    next(observer.handleInputRows(("W-x",), iter([frame]), None))


def test_queries_equal_their_sql_at_a_larger_size(spark):
    con = connect(FINE)
    for name in ("sr08_request_loop", "wn10_resumed"):
        build, sql = catalogue.QUERIES[name]
        assert differences(build(spark, FINE), con, sql) == ""


def test_resuming_is_going_on_and_another_grid_is_refused(spark):
    x = traffic(spark, FINE).withColumn("shard", F.col("user_id") % 3)
    how = ("shard", F.unix_micros(F.col("ts").cast("timestamp")), ["ts", "event_id"], F.col("event_type") == "error")
    grid = drift.Grid(0.2, stakes=25)
    whole = drift.e_process(x, *how, 0.2, 25).where("live").select("event_id", "n", "k", F.round("log_wealth", 9), "revoked")
    state = drift.wagers(x.where("not live"), *how, grid)
    after = drift.resumed(x.where("live"), *how, grid, state).select("event_id", "n", "k", F.round("log_wealth", 9), "revoked")
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, whole.collect()))
    for other in (drift.Grid(0.2), drift.Grid(0.2, low=0.05, stakes=25), drift.Grid(0.19, stakes=25)):
        with pytest.raises(Exception, match="grid has changed"):
            drift.resumed(x.where("live"), *how, other, state).collect()
    for dropped in ("low", "high", "stakes"):
        with pytest.raises(Exception, match="missing the betting grid"):
            drift.resumed(x.where("live"), *how, grid, state.withColumn(dropped, F.lit(None).cast("double"))).collect()


def test_a_grid_is_checked_field_by_field():
    grid = drift.Grid(0.02)
    grid.check(grid.fields(), "m")
    for name in grid.fields():
        with pytest.raises(ValueError, match="missing the betting grid"):
            grid.check({k: v for k, v in grid.fields().items() if k != name}, "m")
        with pytest.raises(ValueError, match="has changed"):
            grid.check(grid.fields() | {name: 7}, "m")
    import numpy as np

    k, n = np.array([3]), np.array([50])
    plain = math.log(sum((1 + b * 0.98) ** 3 * (1 - b * 0.02) ** 47 for b in grid.bets()) / 40)
    assert abs(grid.log_wealth(k, n)[0] - plain) < 1e-12


def test_answers_that_carry_their_request_need_no_table_of_requests(spark):
    answers = spark.sql("select 'w' as warrant_id, 7L as request_id, 5 as n_window, 0.01D as psi, 0D as log_wealth, false as revoked, 3L as session_id, timestamp '2024-01-20' as ts, 0.9D as score")
    warrants = spark.sql("select 'w' as warrant_id, 0.5D as threshold, array(0D, 1D) as edges, array(1D) as probabilities, 0.6D as recall_low, 0.8D as recall_high, 'VALID' as status, timestamp '2024-03-01' as expires_at")
    made = session.certificates(answers, None, warrants, 5).first()
    assert (made["session_id"], made["cited"], made["flagged"], made["action"]) == (3, "w", True, "ESCALATE")
