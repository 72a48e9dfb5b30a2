"""Rows that repeat, ids that are missing, and runs that are long: the laws of the operators hold for them as well."""

import hashlib
import time
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from warrantlake.llm import decontaminate, language, packing, registry, sharding

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("text", [" " * 49_999 + "x" + " " * 49_999, ("a" + " \n" * 5_000) * 20, ("b" + "\t" * 199) * 2_000, "c" + " " * 200])
def test_ids_of_long_white_space_are_made_in_linear_time(text):
    packing.token_ids("warm"), packing.token_ids(" " * 1000)
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    began = time.time()
    assert packing.token_ids(text).tolist() == [*whole, 0]
    assert time.time() - began < 1.5


@pytest.mark.parametrize(("copies", "text"), [(1000, "x" * 1000), (1000, "abcd"), (3000, None)])
def test_shards_stay_near_equal_when_rows_repeat(spark, copies, text):
    rows = [(None, text)] * copies + [(7, text)] * 100 + [(i, f"text {i:05d} " + "y" * 40) for i in range(2000)]
    placed = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter(r["doc_id"] for r in placed) == Counter(i for i, _ in rows)
    by_shard = defaultdict(list)
    for r in placed:
        by_shard[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in by_shard.values())
    sizes = [sum(r["size"] for r in by_shard[s]) for s in range(sharding.SHARDS)]
    assert max(sizes) - min(sizes) <= max(r["size"] for r in placed) * 2 + 2 * sharding.TOLERANCE * sum(sizes) / sharding.SHARDS


def test_a_null_item_id_is_named_by_the_empty_text(spark, tmp_path):
    passage = " ".join(f"word{i}" for i in range(20))
    spark.createDataFrame([(1, f"before {passage} after"), (2, "none of it"), (5, passage)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, passage), (3, passage), (4, None), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = decontaminate.op5_fm_index(spark, str(tmp_path))
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert by_id[1]["n_items"] == 2 and by_id[1]["items_sha256"] == hashlib.sha256(b",3").hexdigest()
    con = connect(SF)
    for name in ("documents", "benchmark"):
        con.execute(f"create or replace view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert differences(found, con, registry.oracle_sql()["op5_fm_index"]) == ""


WORDS = {"en": "the quick brown fox jumps over lazy dogs and runs away from them".split(), "de": "der schnelle braune fuchs springt über faule hunde und läuft weg".split()}


def labelled(spark, copies):
    rows = [(i, f"{' '.join(WORDS[lang][(i * k) % len(WORDS[lang])] for k in range(1, 12))} {i}", lang) for lang in WORDS for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(spark.range(copies).select((F.col("id") + 10_000).alias("doc_id"), F.lit("el perro rápido corre por la calle mientras el niño mira desde su ventana").alias("text"), F.lit("es").alias("lang")))


def test_a_language_of_copies_is_learned(spark):
    docs = labelled(spark, 20_000)
    sample = language.training_sample(docs).collect()
    assert Counter(r["lang"] for r in sample) == {"en": 600, "de": 600, "es": 1}
    model = language.fit(docs)
    assert model.languages == ["de", "en", "es"]
    assert model.predict("el perro rápido corre por la calle mientras el niño mira desde su ventana")[0] == "es"


def test_the_sample_of_languages_is_bounded_by_distinct_texts(spark):
    docs = labelled(spark, 5)
    some = Counter(r["lang"] for r in language.training_sample(docs, per_language=50).collect())
    assert some["es"] == 1 and 25 <= some["en"] <= 80 and 25 <= some["de"] <= 80
    few = Counter(r["lang"] for r in language.training_sample(docs, in_all=60).collect())
    assert few["es"] == 1 and 8 <= few["en"] <= 36
    assert Counter(r["lang"] for r in language.training_sample(docs, in_all=1).collect()) .keys() == {"en", "de", "es"}
