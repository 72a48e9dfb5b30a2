"""What text queries hold and how often they do it: an answer is made once a text, a batch isn't held as strings."""

import tracemalloc

import pyarrow as pa

from warrantlake.functions import text as T
from warrantlake.plans import q_text as Q


def test_an_answer_is_made_once_for_all_aliases(spark):
    plan = Q.QUERIES["ag17_label_rules"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(a|an|the)") == 1


def test_a_batch_of_texts_is_not_held_as_strings():
    size, n = 20_000, 200
    texts = pa.array([None, "", "call 9876543210 now", "x@ybl"] + ["a" * size] * n)
    tracemalloc.start()
    (found,) = list(T.scanned(iter([texts])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < size * n / 4
    assert found.to_pylist() == [T.spans(t) for t in texts.to_pylist()]
