"""Invariants, exact bounds, certificates and the probe: records derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from warrantlake.functions import bounds as B
from warrantlake.functions import text as T
from warrantlake.operators import invariants as V
from warrantlake.operators import metrics as M
from warrantlake.operators import probe as P
from warrantlake.sources.views import SCORED, WARRANTS, probe_items, scored_items, table, warrant_facts


def _metrics(s, d):
    return table(s, d, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 41 == 0, "f1").otherwise("recall").alias("name"), F.when(F.col("p_size") % 2 == 0, "EXACT").otherwise("ESTIMATED").alias("kind"), (F.col("p_retailprice") / 2000).alias("value"),
        F.when((F.col("p_size") % 2 == 1) | (F.col("p_partkey") % 29 == 0), F.col("p_retailprice") / 2000 - 0.1 + F.when(F.col("p_partkey") % 31 == 0, 0.2).otherwise(0.0)).alias("ci_low"),
        F.when(F.col("p_size") % 2 == 1, F.col("p_retailprice") / 2000 + 0.1).alias("ci_high"), (F.col("p_size") - 1).alias("n"),
    )


_METRICS = """m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 41 = 0 THEN 'f1' ELSE 'recall' END AS name, CASE WHEN p_size % 2 = 0 THEN 'EXACT' ELSE 'ESTIMATED' END AS kind, p_retailprice / 2000 AS value,
  CASE WHEN p_size % 2 = 1 OR p_partkey % 29 = 0 THEN p_retailprice / 2000 - 0.1::DOUBLE + CASE WHEN p_partkey % 31 = 0 THEN 0.2::DOUBLE ELSE 0::DOUBLE END END AS ci_low, CASE WHEN p_size % 2 = 1 THEN p_retailprice / 2000 + 0.1::DOUBLE END AS ci_high, p_size - 1 AS n FROM part)"""


def _warrants(s, d):
    o = table(s, d, "orders")
    control = lambda k: F.struct((F.col("o_orderkey") % k != 0).alias("passed"), (F.col("o_orderkey") % 5 != 0).alias("applicable"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "VALID").when(F.col("o_orderstatus") == "O", "REFUSED").otherwise("UNVALIDATED").alias("status"), F.when(F.col("o_orderkey") % 23 != 0, F.col("o_orderpriority")).alias("reason"),
        F.col("o_orderdate").alias("issued_at"), F.dateadd("o_orderdate", (F.col("o_orderkey") % 40).cast("int")).cast("timestamp").alias("expires_at"), F.array(control(7), control(11)).alias("controls"),
    )


def _envelopes(s, d):
    """Edges from whole vectors, a third of them sorted, and shares of their sizes: half of them one too many."""
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    edges = F.when(F.col("vec_id") % 3 == 0, F.array_sort("v")).otherwise(F.col("v"))
    sizes = F.transform(F.when(F.col("vec_id") % 2 == 0, F.slice("v", 1, 63)).otherwise(F.col("v")), F.abs)
    total = F.aggregate(sizes, F.lit(0.0), lambda t, x: t + x)
    scaled = F.transform(sizes, lambda x: x / (total * F.when(F.col("vec_id") % 12 == 6, 1.01).otherwise(1.0)))
    return e.select("vec_id", edges.alias("edges"), scaled.alias("probabilities"))


def _exact_bounds(s, d):
    x = B.with_bounds(warrant_facts(s, d).select("hits", "n").distinct(), "hits", "n")
    return x.select("hits", "n", *(F.round(c, 9).alias(c) for c in ("cp_low", "cp_high", "cp_upper")))


def _certified(s, d):
    x = scored_items(s, d).where("label = 0")
    return B.certify(x, ["eval_set_id"], "question_id", 0.5).select("eval_set_id", F.round("above", 9).alias("above"), "clusters", "too_few")


def _certified_or_not(s, d):
    """Each set's harmless items certified by item, by pairs of items, and by question, for one profile and for four."""
    x = scored_items(s, d).where("label = 0")
    by = F.explode(F.array(F.struct(F.lit("item").alias("unit"), F.col("item_id").cast("string").alias("cluster")), F.struct(F.lit("pair").alias("unit"), F.floor(F.col("item_id") / 2).cast("string").alias("cluster")), F.struct(F.lit("question").alias("unit"), F.col("question_id").alias("cluster"))))
    each, out = x.select("eval_set_id", "score", by.alias("b")).select("eval_set_id", "score", "b.*"), None
    for profiles in (1, 4):
        one = B.certified(each, ["eval_set_id", "unit"], "cluster", TARGET, profiles).withColumn("profiles", F.lit(profiles))
        out = one if out is None else out.unionByName(one)
    return out.select("eval_set_id", "unit", "profiles", "clusters", "outcome", F.round("above", 9).alias("above"))


def _certified_sql(profiles):
    return f"""SELECT eval_set_id, unit, {profiles} AS profiles, CAST(max(n) AS BIGINT) AS clusters, CASE WHEN any_value(unequal) THEN 'unequal clusters' WHEN max(n) < {B.least_clean(TARGET, 0.05 / profiles)} THEN 'too few clusters' ELSE 'certified' END AS outcome,
      CASE WHEN NOT any_value(unequal) AND max(n) >= {B.least_clean(TARGET, 0.05 / profiles)} THEN round(min(score) FILTER (upper <= {TARGET}), 9) END AS above FROM (SELECT *, {B.high_sql("k", "n", 0.05 / profiles)} AS upper FROM w) GROUP BY 1, 2"""


TARGET = 0.05


def _probe(s, d):
    """A probe on even vectors, scored on odd ones: area under the curve by fold."""
    x = probe_items(s, d)
    model = P.fit(x.where("vec_id % 2 = 0"), 1.0)
    held = P.score(model, x.where("vec_id % 2 = 1")).withColumn("fold", F.col("vec_id") % 3)
    return M.auroc(held, ["fold"]).select("fold", F.round("auroc", 3).alias("auroc"))


def _text_validation(s, d):
    """A stateless detector on labelled items: identifier score at 0.5 against the toxic label, by language."""
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    items = docs.select(F.col("lang").alias("eval_set_id"), F.col("toxic").cast("int").alias("label"), T.pii_score(F.col("text")).alias("score"))
    return M.rates(M.confusion(items, ["eval_set_id"], 0.5))


def _certificates(s, d):
    """A record per conversation: what was found, the action, and what was cited."""
    c = table(s, d, "conversations")
    x = c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("text").rlike("(?i)password|secret|token")).alias("findings"))
    return x.withColumn("action", F.when(F.col("findings") > 1, "BLOCK").when(F.col("findings") == 1, "REDACT").otherwise("ALLOW")).withColumn("policy_hash", F.sha2(F.concat_ws("|", F.lit("v1"), "action"), 256))


def _misaligned(s, d):
    """Items and their cached features side by side: rows missing on either side, or with another label."""
    a = table(s, d, "embeddings").where("vec_id % 50 <> 3").select("vec_id", F.col("label").cast("long").alias("x"))
    b = table(s, d, "embeddings").where("vec_id % 70 <> 4").select("vec_id", (F.col("label") + (F.col("vec_id") % 90 == 5).cast("int")).cast("long").alias("y"))
    return a.join(b, "vec_id", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("vec_id", "x", "y")


def _identity(s, d):
    """A set's content hash: of the hashes of its blocks of a thousand ids, so that no list holds all items."""

    def hashed(rows, keys, order, text, name):
        return rows.groupBy(*keys).agg(F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("t")))), lambda x: x["t"])), 256).alias(name))

    items = scored_items(s, d).withColumn("block", F.floor(F.col("item_id") / 1000))
    blocks = hashed(items, ["eval_set_id", "block"], "item_id", F.concat_ws("|", F.col("item_id").cast("string"), F.col("label").cast("string")), "h")
    return hashed(blocks, ["eval_set_id"], "block", F.col("h"), "content_hash")


QUERIES = {
    "v01_metric_violations": (lambda s, d: _metrics(s, d).where(V.metric()).select("id"), f"WITH {_METRICS} SELECT id FROM m WHERE coalesce((kind = 'EXACT' AND (ci_low IS NOT NULL OR ci_high IS NOT NULL)) OR (kind = 'ESTIMATED' AND (ci_low IS NULL OR ci_high IS NULL OR ci_low > value OR value > ci_high OR n <= 0)) OR name = 'f1', true)"),
    "v02_ranking_partly_present": (lambda s, d: _metrics(s, d).where(V.ranking_partly_present(["value", "ci_low", "ci_high"])).select("id"), f"WITH {_METRICS} SELECT id FROM m WHERE CAST(value IS NOT NULL AS INT) + CAST(ci_low IS NOT NULL AS INT) + CAST(ci_high IS NOT NULL AS INT) IN (1, 2)"),
    "v03_warrant_violations": (
        lambda s, d: _warrants(s, d).where(V.warrant()).select("id"),
        """WITH w AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'VALID' WHEN 'O' THEN 'REFUSED' ELSE 'UNVALIDATED' END AS status, CASE WHEN o_orderkey % 23 <> 0 THEN o_orderpriority END AS reason, o_orderkey AS k FROM orders)
        SELECT id FROM w WHERE (k % 5 <> 0 AND (k % 7 = 0 OR k % 11 = 0) AND status <> 'REFUSED') OR (status <> 'VALID' AND coalesce(reason, '') = '') OR k % 40 = 0 OR status = 'UNVALIDATED'""",
    ),
    "v04_control_violations": (
        lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 10).alias("passed"), (F.col("l_tax") > 0).alias("applicable"), (F.col("l_quantity") - 12).alias("margin")).where(V.control()).select("l_orderkey", "l_linenumber"),
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CASE WHEN l_tax > 0 THEN (l_quantity - 12 >= 0) <> (l_quantity > 10) ELSE NOT (l_quantity > 10) OR l_quantity - 12 <> 0 END",
    ),
    "v05_certificate_violations": (
        lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 90, F.col("event_type"))).alias("triggering"), F.collect_set(F.when(F.col("value") < 20, F.col("event_type"))).alias("findings")).where(V.certificate()).select("user_id"),
        "SELECT user_id FROM (SELECT user_id, list(DISTINCT event_type) FILTER (value > 90) AS t, list(DISTINCT event_type) FILTER (value < 20) AS f FROM events GROUP BY 1) WHERE t IS NOT NULL AND NOT coalesce(list_has_all(f, t), false)",
    ),
    "v06_resolution_violations": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "ALLOW").otherwise("BLOCK").alias("action"), F.when(F.col("o_orderkey") % 9 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderpriority")).alias("triggering"), F.when(F.col("o_orderkey") % 8 != 0, F.col("o_orderpriority")).alias("rationale")).where(V.resolution()).select("o_orderkey"),
        "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' AND (o_orderkey % 9 = 0 OR o_orderkey % 8 = 0)",
    ),
    "v07_override_violations": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 33 == 0, "other").otherwise("random").alias("stratum"), ((F.col("o_orderkey") % 6) / 5.0).alias("selection_probability"), F.when(F.col("o_orderstatus") == "F", "UPHELD").otherwise("OVERRIDDEN").alias("ruling"), F.when(F.col("o_orderkey") % 2 == 0, "none").otherwise("false_positive").alias("direction"), (F.col("o_totalprice") / 400000).alias("score")).where(V.override()).select("o_orderkey"),
        "SELECT o_orderkey FROM orders WHERE o_orderkey % 33 = 0 OR o_orderkey % 6 = 0 OR ((o_orderstatus = 'F') <> (o_orderkey % 2 = 0)) OR NOT o_totalprice / 400000 BETWEEN 0 AND 1",
    ),
    "v08_envelope_violations": (
        lambda s, d: _envelopes(s, d).where(V.envelope()).select("vec_id"),
        """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN list_sort(v) ELSE v END AS g FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))
        SELECT vec_id FROM e WHERE vec_id % 2 = 1 OR vec_id % 12 = 6 OR len(list_filter(range(1, len(g)), lambda i: g[i + 1] <= g[i])) > 0""",
    ),
    "v09_match_violations": (
        lambda s, d: table(s, d, "events").select("event_id", F.create_map(F.lit("a"), F.col("value"), F.lit("b"), F.lit(50.0)).alias("psi"), F.col("value").alias("max_psi"), F.when(F.col("event_type") == "view", "c").otherwise("a").alias("driver")).where(V.match_result()).select("event_id"),
        "SELECT event_id FROM events WHERE value < 50 OR event_type = 'view'",
    ),
    "v10_operating_point_violations": (lambda s, d: table(s, d, "events").select("event_id", F.get(F.array(F.lit("validation"), F.lit("train"), F.lit("test"), F.lit(None)), (F.col("event_id") % 4).cast("int")).alias("selected_on")).where(V.operating_point()).select("event_id"), "SELECT event_id FROM events WHERE event_id % 4 IN (2, 3)"),
    "v11_finding_violations": (
        lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 11).alias("confidence"), F.array(F.struct((F.col("l_linenumber") - 2).alias("start"), (F.col("l_quantity") / 5).cast("int").alias("end"))).alias("spans")).where(V.finding()).select("l_orderkey", "l_linenumber"),
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT l_discount * 11 BETWEEN 0 AND 1 OR l_linenumber < 2 OR CAST(trunc(l_quantity / 5) AS INTEGER) < l_linenumber - 2",
    ),
    "v12_item_violations": (lambda s, d: table(s, d, "labels").select("doc_id", F.when(F.col("doc_id") % 19 != 0, F.col("toxic")).alias("label"), F.when(F.col("quality") == 1, "train").when(F.col("doc_id") % 2 == 0, "dev").alias("split")).where(V.item()).select("doc_id"), "SELECT doc_id FROM labels WHERE doc_id % 19 = 0 OR toxic NOT IN (0, 1) OR (quality <> 1 AND doc_id % 2 = 0)"),
    "v12_repeated_items": (lambda s, d: V.repeated(table(s, d, "orders"), "o_custkey"), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1"),
    "v13_polarity": (lambda s, d: V.one_class(scored_items(s, d), ["question_id"]), f"WITH {SCORED} SELECT question_id, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg, count(*) AS n FROM scored GROUP BY 1 HAVING count(*) FILTER (label = 1) = 0 OR count(*) FILTER (label = 0) = 0"),
    "v14_array_lengths": (
        lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("a"), F.collect_list(F.when(F.col("role") != "system", F.col("role"))).alias("b")).where(V.parallel_arrays(["a", "b"])).select("conv_id"),
        "SELECT conv_id FROM conversations GROUP BY 1 HAVING count(text) <> count(*) FILTER (role <> 'system')",
    ),
    "v15_vector_violations": (lambda s, d: table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(x > 0.3, float("nan")).otherwise(x.cast("double"))).alias("v")).where(V.not_finite("v")).select("vec_id"), "SELECT vec_id FROM embeddings WHERE list_max(embedding) > 0.3::FLOAT"),
    "st03_exact_bounds": (_exact_bounds, f"WITH {WARRANTS}, x AS (SELECT DISTINCT hits, n FROM warrants) SELECT hits, n, round({B.low_sql('hits', 'n')}, 9) AS cp_low, round({B.high_sql('hits', 'n')}, 9) AS cp_high, round({B.high_sql('hits', 'n', 0.05)}, 9) AS cp_upper FROM x"),
    "st04_zero_event_bound": (lambda s, d: warrant_facts(s, d).groupBy("detector_id").agg(F.sum("n").alias("n")).select("detector_id", F.round(1 - F.pow(F.lit(0.05), 1.0 / F.col("n")), 9).alias("upper")), f"WITH {WARRANTS} SELECT detector_id, round(1 - pow(0.05::DOUBLE, 1::DOUBLE / sum(n)), 9) AS upper FROM warrants GROUP BY 1"),
    "st06_certified_threshold": (
        _certified,
        f"""WITH {SCORED}, t AS (SELECT eval_set_id, question_id, max(score) AS score FROM scored WHERE label = 0 GROUP BY 1, 2), g AS (SELECT eval_set_id, score, count(*) AS c FROM t GROUP BY 1, 2),
        w AS (SELECT eval_set_id, score, sum(c) OVER (PARTITION BY eval_set_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING) - c AS k, sum(c) OVER (PARTITION BY eval_set_id) AS n FROM g), u AS (SELECT *, {B.high_sql("k", "n", 0.05)} AS upper FROM w)
        SELECT eval_set_id, round(min(score) FILTER (upper <= 0.5), 9) AS above, CAST(max(n) AS BIGINT) AS clusters, max(n) < {B.least_clean(0.5)} AS too_few FROM u GROUP BY 1""",
    ),
    "st06_certified_or_refused": (
        _certified_or_not,
        f"""WITH {SCORED}, x AS (SELECT eval_set_id, score, 'item' AS unit, CAST(item_id AS VARCHAR) AS cluster FROM scored WHERE label = 0 UNION ALL SELECT eval_set_id, score, 'pair', CAST(item_id // 2 AS VARCHAR) FROM scored WHERE label = 0 UNION ALL SELECT eval_set_id, score, 'question', question_id FROM scored WHERE label = 0),
        t AS (SELECT eval_set_id, unit, cluster, max(score) AS score, count(*) AS size FROM x GROUP BY 1, 2, 3), z AS (SELECT eval_set_id, unit, min(size) < max(size) AS unequal FROM t GROUP BY 1, 2), g AS (SELECT eval_set_id, unit, score, count(*) AS c FROM t GROUP BY 1, 2, 3),
        w AS (SELECT g.eval_set_id, g.unit, score, unequal, sum(c) OVER (PARTITION BY g.eval_set_id, g.unit ORDER BY score DESC ROWS UNBOUNDED PRECEDING) - c AS k, sum(c) OVER (PARTITION BY g.eval_set_id, g.unit) AS n FROM g JOIN z ON z.eval_set_id = g.eval_set_id AND z.unit = g.unit)
        {_certified_sql(1)} UNION ALL {_certified_sql(4)}""",
    ),
    "ud01_probe_auroc": (_probe, None),
    "sr17_text_detector": (_text_validation, None),
    "tx06_number_citations": (
        _certificates,
        """WITH x AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (regexp_matches(text, '(?i)password|secret|token')) AS findings FROM conversations GROUP BY 1),
        y AS (SELECT *, CASE WHEN findings > 1 THEN 'BLOCK' WHEN findings = 1 THEN 'REDACT' ELSE 'ALLOW' END AS action FROM x) SELECT *, sha256('v1|' || action) AS policy_hash FROM y""",
    ),
    "jn01_alignment": (_misaligned, "WITH a AS (SELECT vec_id, CAST(label AS BIGINT) AS x FROM embeddings WHERE vec_id % 50 <> 3), b AS (SELECT vec_id, CAST(label + CASE WHEN vec_id % 90 = 5 THEN 1 ELSE 0 END AS BIGINT) AS y FROM embeddings WHERE vec_id % 70 <> 4) SELECT vec_id, x, y FROM a FULL JOIN b USING (vec_id) WHERE x IS DISTINCT FROM y"),
    "jn02_common_items": (lambda s, d: scored_items(s, d).select("item_id", "score").join(table(s, d, "documents").where("n_chars > 2000").select(F.col("doc_id").alias("item_id"), "source"), "item_id"), f"WITH {SCORED} SELECT item_id, score, source FROM scored JOIN documents ON doc_id = item_id WHERE n_chars > 2000"),
    "io08_registry": (lambda s, d: scored_items(s, d).groupBy("eval_set_id").agg(F.count("*").alias("n_items"), F.sum("label").alias("n_positive"), F.avg("label").alias("base_rate"), (F.min("label") == F.max("label")).alias("single_class")), f"WITH {SCORED} SELECT eval_set_id, count(*) AS n_items, CAST(sum(label) AS BIGINT) AS n_positive, avg(label) AS base_rate, min(label) = max(label) AS single_class FROM scored GROUP BY 1"),
    "io15_first_of_normalised": (
        lambda s, d: table(s, d, "conversations").withColumn("k", T.question(F.col("text"))).groupBy("k").agg(F.min(F.struct("conv_id", "turn")).alias("first")).select("first.conv_id", "first.turn"),
        r"WITH n AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_]', ' ', 'g'), ' +', ' ', 'g')) AS k FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY conv_id, turn) AS nth FROM n) SELECT conv_id, turn FROM r WHERE nth = 1",
    ),
    "df05_set_identity": (
        lambda s, d: _identity(s, d),
        f"WITH {SCORED}, b AS (SELECT eval_set_id, item_id // 1000 AS block, sha256(string_agg(CAST(item_id AS VARCHAR) || '|' || CAST(label AS VARCHAR), chr(10) ORDER BY item_id)) AS h FROM scored GROUP BY 1, 2) SELECT eval_set_id, sha256(string_agg(h, chr(10) ORDER BY block)) AS content_hash FROM b GROUP BY 1",
    ),
}
