"""Pooled vectors of sequences made of neighbouring embeddings, with masks by label, and questions normalised beyond ASCII."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warrantlake.functions import text as T
from warrantlake.operators import pooling as P
from warrantlake.sources.views import table

WINDOW, STRIDE, DIMENSIONS = 4, 3, 4


def _positions(s: SparkSession, d: str) -> DataFrame:
    """Eleven neighbouring vectors are a sequence; some masks are empty, some miss a position, some positions are lost."""
    seq, pos = F.floor(F.col("vec_id") / 11), F.col("vec_id") % 11
    x = table(s, d, "embeddings").select(seq.alias("seq"), pos.cast("int").alias("pos"), "label", F.transform(F.slice("embedding", 1, DIMENSIONS), lambda v: v.cast("double")).alias("vec"))
    selected = F.when(F.col("seq") % 9 == 4, F.lit(False)).when((F.col("seq") % 9 == 6) & (F.col("pos") == 2), None).otherwise(F.col("label") < 7)
    x = x.where(~((F.col("seq") % 9 == 8) & (F.col("pos") == 5)))
    return x.select("seq", "pos", selected.alias("selected"), F.when((F.col("seq") % 9 == 2) & (F.col("pos") == 1), F.slice("vec", 1, 2)).otherwise(F.col("vec")).alias("vec"))


def _pooled(s: SparkSession, d: str) -> DataFrame:
    x, out = _positions(s, d), None
    for strategy in P.STRATEGIES:
        one = P.pooled(x, "seq", strategy, WINDOW, STRIDE).select("seq", F.lit(strategy).alias("strategy"), "dim", F.round("value", 9).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def _questions(s: SparkSession, d: str) -> DataFrame:
    """The digest of every text, normalised by NFKC and case folding, and its length."""
    x = table(s, d, "documents").select("doc_id", T.folded_question(F.col("text")).alias("q"))
    return x.select("doc_id", F.sha2("q", 256).alias("digest"), F.char_length("q").cast("long").alias("length"))


_X = f"""x AS (SELECT vec_id // 11 AS seq, vec_id % 11 AS pos, CASE WHEN (vec_id // 11) % 9 = 4 THEN false WHEN (vec_id // 11) % 9 = 6 AND vec_id % 11 = 2 THEN NULL ELSE label < 7 END AS selected, CASE WHEN (vec_id // 11) % 9 = 2 AND vec_id % 11 = 1 THEN 2 ELSE {DIMENSIONS} END AS width, embedding
  FROM embeddings WHERE NOT ((vec_id // 11) % 9 = 8 AND vec_id % 11 = 5)),
c AS (SELECT seq, count(*) AS length, count(*) FILTER (selected) AS selected, CASE WHEN NOT (min(pos) = 0 AND max(pos) = count(*) - 1 AND count(DISTINCT pos) = count(*)) THEN '{P.PROBLEMS[0]}' WHEN count(selected) < count(*) THEN '{P.PROBLEMS[1]}' WHEN min(width) <> max(width) THEN '{P.PROBLEMS[2]}' WHEN count(*) FILTER (selected) = 0 THEN '{P.PROBLEMS[3]}' END AS problem FROM x GROUP BY 1)"""

QUERIES = {
    "df17_mask_violations": (lambda s, d: P.violations(_positions(s, d), "seq"), f"WITH {_X} SELECT * FROM c WHERE problem IS NOT NULL"),
    "sf18_pooled_vectors": (
        _pooled,
        f"""WITH {_X}, k AS (SELECT x.seq, pos, c.selected AS n, row_number() OVER (PARTITION BY x.seq ORDER BY pos) - 1 AS i, d::INTEGER AS dim, embedding[d + 1]::DOUBLE AS v FROM x JOIN c ON c.seq = x.seq, range({DIMENSIONS}) r(d) WHERE x.selected AND problem IS NULL),
        q AS (SELECT seq, pos, n, dim, v, dense_rank() OVER (PARTITION BY seq ORDER BY pos) - 1 AS i FROM k),
        w AS (SELECT q.seq, q.dim, s.start, avg(v) AS m FROM q, range(0, 11) s(start) WHERE (n <= {WINDOW} AND s.start = 0) OR (n > {WINDOW} AND s.start <= n - {WINDOW} AND (s.start % {STRIDE} = 0 OR s.start = n - {WINDOW}) AND i >= s.start AND i < s.start + {WINDOW}) GROUP BY 1, 2, 3)
        SELECT seq, 'mean_pool' AS strategy, dim, round(avg(v), 9) AS value FROM q GROUP BY 1, 3 UNION ALL SELECT seq, 'last_token', dim, round(arg_max(v, pos), 9) FROM q GROUP BY 1, 3 UNION ALL SELECT seq, 'max_rolling_means', dim, round(max(m), 9) FROM w GROUP BY 1, 3""",
    ),
    "sf01_folded_question": (_questions, None),
}
