"""Separator-tolerant identifiers beside letters, marks and blanks that engines treat unlike."""

import duckdb
from oracle import differences

from warrantlake.plans import q_rest

NUMBER = "1234 5678 9012"
TEXTS = [
    f"é{NUMBER}", f"{NUMBER}é", f"x́{NUMBER}", f"_{NUMBER}", "1234\x0b5678\x0b9012", "1234\f5678\f9012", "ſbcDE1234F", "abcde1234K", "name @ ſb",
    "na.me\x0b@ okbank", "name at Kbank", "é12 34 56 78 90 12ü", "HDFC0123456ß", None, "",
]


def test_odd_texts_are_scored_as_sql_scores_them(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/*.parquet')")
    build, sql = q_rest.QUERIES["tx10_tolerant_score"]
    assert differences(build(spark, str(tmp_path)), con, sql) == ""
