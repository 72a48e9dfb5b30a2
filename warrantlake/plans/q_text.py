"""Text, split and vector queries over documents, conversations, benchmark and embeddings."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from warrantlake.functions import text as T
from warrantlake.functions.rng import draw, draw_sql
from warrantlake.operators import metrics as M
from warrantlake.operators import splits as S
from warrantlake.sources.views import probe_items, table

_Q = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_]', ' ', 'g'), ' +', ' ', 'g'))"
_BARE = r"regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', ' ', 'g'), '[ \t\n\r]+', '  ', 'g')"
_A = rf"trim(regexp_replace(regexp_replace(' ' || {_BARE} || ' ', ' (a|an|the) ', ' ', 'g'), ' +', ' ', 'g'))"
_ABSTAINS = " OR ".join("contains(t, '" + p.replace("'", "''") + "')" for p in T.ABSTENTIONS)


def _docs(s, d):
    return table(s, d, "documents")


def _digest(column):
    return F.sha2(column, 256)


def _aliases(s, d):
    """Each document against four aliases, two of them short."""
    a = F.array(*[F.lit(x) for x in ("us", "th", "licen", "trash")])
    # A column of its own: written into the rule, the answer would be made anew for each alias.
    known = _docs(s, d).select("doc_id", T.answer(F.col("text")).alias("answer"))
    return known.select("doc_id", T.alias_rule(F.col("answer"), a).alias("rule"))


def _labels_by_rule(s, d):
    return _aliases(s, d).groupBy("rule").agg(F.count("*").alias("n"))


def _splits(s, d, seed="s1", fractions=(0.6, 0.2, 0.2)):
    events = table(s, d, "events").select("user_id").distinct().withColumn("cohort", F.col("user_id") % 3)
    return S.by_group(events, "user_id", seed, fractions, ["cohort"])


def _split_sql(name: str, seed: str, a: float, b: float) -> str:
    return f"""{name} AS (SELECT user_id, cohort, CASE WHEN r <= floor(n * {a}::DOUBLE + 0.5) THEN 'train' WHEN r <= floor(n * {a + b!r}::DOUBLE + 0.5) THEN 'validation' ELSE 'test' END AS split FROM
    (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY h, user_id) AS r, count(*) OVER (PARTITION BY cohort) AS n FROM (SELECT DISTINCT user_id, user_id % 3 AS cohort, {draw_sql(f"'{seed}'", "user_id")} AS h FROM events)))"""


def _flat_aliases(s, d):
    """A document's first line, its lines, and their normal forms as one list, each once and in order."""
    lines = F.split("text", "\n")
    flat = F.array_distinct(F.filter(F.concat(F.slice(lines, 1, 1), lines, F.transform(lines, T.question)), lambda x: x != ""))
    return _docs(s, d).select("doc_id", F.size(flat).cast("long").alias("aliases"), F.sha2(F.concat_ws("\n", flat), 256).alias("digest"))


def _exact_matches(s, d):
    """Documents whose normalised text is also that of a document of another source, and how many other sources have it."""
    n = _docs(s, d).select("doc_id", "source", T.answer(F.col("text")).alias("k")).where(F.length("k") > 0)
    keyed = n.withColumn("h", F.sha2("k", 256)).select("doc_id", "source", "h")
    shared = keyed.select("h", "source").distinct().groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(shared, "h").select("doc_id", (F.col("n") - 1).alias("matches"))


def _states(s, d):
    """Prompts in two states, made of a conversation's first, second and last turn: some with a planted fault."""
    c = table(s, d, "conversations")
    x = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("frame"), F.max_by("text", "turn").alias("ask"), F.max_by("text", F.when(F.col("turn") == 1, 1)).alias("clause"), F.count("*").alias("turns")).where("turns > 1 and clause is not null")
    x = x.withColumn("fault", draw(F.lit("pair"), "conv_id") % 10)
    plain = F.concat("frame", F.when(F.col("fault") == 2, F.lit(" note ")).otherwise(F.lit(" ")), "ask")
    other = F.when(F.col("fault") == 0, F.concat_ws(" ", "frame", "clause", "ask", F.lit("!"))).when(F.col("fault") == 1, F.concat(F.lit("> "), F.concat_ws(" ", "frame", "clause", "ask"))).when(F.col("fault") == 3, F.concat_ws(" ", "frame", "ask")).otherwise(F.concat_ws(" ", "frame", "clause", "ask"))
    prompts = F.filter(F.array(F.struct(F.lit(0).alias("state"), plain.alias("prompt")), F.struct(F.lit(1).alias("state"), other.alias("prompt"))), lambda p: (F.col("fault") != 4) | (p["state"] == 0))
    return x.select("conv_id", "frame", "ask"), x.select("conv_id", F.explode(prompts).alias("p")).select("conv_id", "p.*")


def _pair_integrity(s, d):
    """Two states of a question may differ by the inserted clause alone: the first rule that a pair breaks."""
    questions, prompts = _states(s, d)
    sides = prompts.groupBy("conv_id").agg(*(F.max(F.when(F.col("state") == i, F.col("prompt"))).alias(f"s{i}") for i in (0, 1)), F.count_distinct("state").alias("states"))
    between = lambda c: F.trim(F.expr(f"substring({c}, length(frame) + 1, greatest(0, length({c}) - length(frame) - length(ask)))"))
    rules = [("states", F.col("states") != 2), ("plain frame", ~F.startswith("s0", "frame")), ("plain ask", ~F.endswith("s0", "ask")), ("clause ask", ~F.endswith("s1", "ask")), ("clause frame", ~F.startswith("s1", "frame")), ("plain differs by more", between("s0") != ""), ("nothing inserted", between("s1") == "")]
    outcome = F.lit("holds")
    for name, broken in reversed(rules):
        outcome = F.when(broken, name).otherwise(outcome)
    return questions.join(sides, "conv_id").select("conv_id", outcome.alias("outcome"))


_PAIRS = f"""WITH c AS (SELECT conv_id, arg_min(text, turn) AS frame, arg_max(text, turn) AS ask, max(text) FILTER (turn = 1) AS clause, count(*) AS turns FROM conversations GROUP BY 1),
  x AS (SELECT *, {draw_sql("'pair'", "conv_id")} % 10 AS f FROM c WHERE turns > 1 AND clause IS NOT NULL),
  p AS (SELECT *, frame || CASE WHEN f = 2 THEN ' note ' ELSE ' ' END || ask AS s0, CASE f WHEN 0 THEN frame || ' ' || clause || ' ' || ask || ' !' WHEN 1 THEN '> ' || frame || ' ' || clause || ' ' || ask WHEN 3 THEN frame || ' ' || ask WHEN 4 THEN NULL ELSE frame || ' ' || clause || ' ' || ask END AS s1 FROM x),
  b AS (SELECT *, trim(substr(s0, length(frame) + 1, greatest(0, length(s0) - length(frame) - length(ask)))) AS m0, trim(substr(s1, length(frame) + 1, greatest(0, length(s1) - length(frame) - length(ask)))) AS m1 FROM p)
  SELECT conv_id, CASE WHEN s1 IS NULL THEN 'states' WHEN NOT starts_with(s0, frame) THEN 'plain frame' WHEN NOT ends_with(s0, ask) THEN 'plain ask' WHEN NOT ends_with(s1, ask) THEN 'clause ask' WHEN NOT starts_with(s1, frame) THEN 'clause frame' WHEN m0 <> '' THEN 'plain differs by more' WHEN m1 = '' THEN 'nothing inserted' ELSE 'holds' END AS outcome FROM b"""


def _cosines(s, d):
    v = probe_items(s, d)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    a, b = v.alias("a"), v.alias("b")
    pairs = a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1)
    x = pairs.select(F.col("a.vec_id").alias("vec_id"), dot(F.col("a.vec"), F.col("b.vec")).alias("d"), dot(F.col("a.vec"), F.col("a.vec")).alias("n"), dot(F.col("b.vec"), F.col("b.vec")).alias("m"))
    l2 = F.sqrt(F.greatest(F.col("n") + F.col("m") - 2 * F.col("d"), F.lit(0.0))) / F.greatest(F.sqrt("n"), F.lit(1e-12))
    return x.select("vec_id", F.round(F.col("d") / F.greatest(F.sqrt("n") * F.sqrt("m"), F.lit(1e-12)), 6).alias("cosine"), F.round(l2, 6).alias("relative_l2"))


def _probe(s, d):
    """A fixed linear probe: weights cos(i), a bias, and the logistic of their product with the vector."""
    w = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.cos(i.cast("double")))
    margin = F.aggregate(F.zip_with("vec", w, lambda x, y: x * y), F.lit(-0.25), lambda t, x: t + x)
    return probe_items(s, d).select("vec_id", "label", F.round(1 / (1 + F.exp(-margin)), 6).alias("score"))


def _rolling(s, d):
    """Largest mean over windows of eight places, four apart, of each vector read as a sequence."""
    starts = F.sequence(F.lit(0), F.lit(56), F.lit(4))
    mean = lambda i: F.aggregate(F.slice("vec", i + 1, F.lit(8)), F.lit(0.0), lambda t, x: t + x) / 8
    return probe_items(s, d).select("vec_id", F.round(F.array_max(F.transform(starts, mean)), 6).alias("max_rolling"), F.round(F.aggregate("vec", F.lit(0.0), lambda t, x: t + x) / 64, 6).alias("mean_pool"), F.round(F.element_at("vec", -1), 6).alias("last"))


def _canary(s, d):
    """The ten positives of the largest worst margin over four scores of a vector, each the mean of a quarter of it.

    A score that ranks no better than chance doesn't count; only positive margins do.
    """
    quarter = lambda i: F.aggregate(F.slice("vec", 16 * i + 1, 16), F.lit(0.0), lambda t, x: t + x) / 16
    x = probe_items(s, d).select("vec_id", "label", *(quarter(i).alias(f"q{i}") for i in range(4)))
    long = x.select("vec_id", "label", F.explode(F.array(*[F.struct(F.lit(i).alias("variant"), F.col(f"q{i}").alias("score")) for i in range(4)])).alias("v")).select("vec_id", "label", "v.*")
    good = M.auroc(long, ["variant"]).where("auroc >= 0.5").select("variant")
    worst = long.where("label = 1").join(F.broadcast(good), "variant").groupBy("vec_id").agg(F.min("score").alias("margin")).where("margin > 0")
    return worst.orderBy(F.desc("margin"), "vec_id").limit(10).select("vec_id", F.round("margin", 6).alias("margin"))


_CANARY = """WITH v AS (SELECT vec_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT vec_id, y, unnest(range(4)) AS i, v FROM v), l AS (SELECT vec_id, y, i, list_sum(v[16 * i + 1:16 * i + 16]) / 16 AS m FROM q),
  r AS (SELECT *, rank() OVER (PARTITION BY i ORDER BY m) + (count(*) OVER (PARTITION BY i, m) - 1) / 2::DOUBLE AS r FROM l),
  a AS (SELECT i FROM r GROUP BY 1 HAVING (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) >= 0.5)
  SELECT vec_id, round(min(m), 6) AS margin FROM l JOIN a ON a.i = l.i WHERE y = 1 GROUP BY 1 HAVING min(m) > 0 ORDER BY min(m) DESC, vec_id LIMIT 10"""


def _shape_difference(s, d):
    """Metric shapes (name, kind, unit) that only one of two sets has: here parts of two brands."""
    shape = lambda brand: table(s, d, "part").where(F.col("p_brand") == brand).select(F.col("p_name").alias("name"), F.col("p_type").alias("kind"), (F.col("p_size") % 3).alias("unit")).distinct()
    a, b = shape("Brand#1"), shape("Brand#2")
    only = lambda x, y, name: x.join(y, ["name", "kind", "unit"], "left_anti").withColumn("only_in", F.lit(name))
    return only(a, b, "first").unionByName(only(b, a, "second"))


def _determinism(s, d):
    """Two runs of the scoring over differently dealt rows: how far scores differ, and a digest of each run's rows."""
    runs = [_probe(s, d).repartition(n, "vec_id").select("vec_id", F.col("score").alias(name)) for n, name in ((3, "a"), (7, "b"))]
    row = lambda c: F.conv(F.substring(F.md5(F.concat_ws("|", F.col("vec_id").cast("string"), F.bround(F.col(c) * 1e6, 0).cast("long").cast("string"))), 1, 8), 16, 10).cast("long")
    x = runs[0].join(runs[1], "vec_id")
    return x.agg(F.count("*").alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("largest"), F.sum(row("a")).alias("digest_a"), F.sum(row("b")).alias("digest_b"))


def _even_picks(s, d):
    """Twenty documents evenly spaced by length: places are found among the lengths, rows only within those lengths."""
    docs = _docs(s, d).select("doc_id", "n_chars")
    lengths = docs.groupBy("n_chars").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("n_chars").rowsBetween(Window.unboundedPreceding, 0))
    n = docs.count()
    wanted = sorted({math.floor(i * (n - 1) / 19 + 0.5) for i in range(20)}) if n else []
    picks = s.createDataFrame([(w,) for w in wanted], "place long")
    cells = lengths.withColumn("upto", upto).join(F.broadcast(picks), (F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("c")))
    inside = docs.join(cells.select("n_chars").distinct(), "n_chars", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("n_chars").orderBy("doc_id")))
    chosen = cells.select("n_chars", (F.col("place") - F.col("upto") + F.col("c") + 1).alias("nth"))
    return inside.join(chosen, ["n_chars", "nth"]).select("doc_id", "n_chars")


def _best_by(s, d):
    """Grid search over source and language: the largest mean length, ties to the smaller names."""
    g = _docs(s, d).groupBy("source", "lang").agg(F.round(F.avg("n_chars"), 6).alias("score"))
    return g.groupBy("lang").agg(F.min(F.struct((-F.col("score")).alias("m"), F.col("source"))).alias("b")).select("lang", F.col("b.source").alias("source"), (-F.col("b.m")).alias("score"))


_PII_PARTS = {"obfuscated": T.OBFUSCATED[1][0], "upi": T.UPI, "ifsc": T.IFSC, "interleaved": T.OBFUSCATED[3][0]}


def _pattern_counts(s, d):
    return _docs(s, d).select("doc_id", *(F.size(T.found(F.col("text"), p)).cast("long").alias(n) for n, p in _PII_PARTS.items()))


def _pattern_counts_sql() -> str:
    return "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '(?i){p}')) AS {n}" for n, p in _PII_PARTS.items()) + " FROM documents"


def _verhoeff(s, d):
    """Check digits of order keys padded to eleven digits: valid ones are one in ten."""
    return table(s, d, "orders").select("o_orderkey", T.verhoeff_valid(F.lpad(F.col("o_orderkey").cast("string"), 12, "9")).alias("valid"))


_D5 = "[" + ", ".join(str(T._multiply(a, b)) for a in range(10) for b in range(10)) + "]"
_P8 = "[" + ", ".join(str(p[i]) for p in T._POWERS for i in range(10)) + "]"

QUERIES = {
    "sf01_question": (lambda s, d: _docs(s, d).select("doc_id", _digest(T.question(F.col("text"))).alias("digest")), f"SELECT doc_id, sha256({_Q}) AS digest FROM documents"),
    "sf02_answer_deleted": (lambda s, d: _docs(s, d).select("doc_id", _digest(T.answer_deleted(F.col("text"))).alias("digest")), r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS digest FROM documents"),
    "sf03_answer": (lambda s, d: _docs(s, d).select("doc_id", _digest(T.answer(F.col("text"))).alias("digest")), f"SELECT doc_id, sha256({_A}) AS digest FROM documents"),
    "sf04_alias_match": (_aliases, f"WITH n AS (SELECT doc_id, {_A} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) = 0 THEN 'empty' WHEN contains(t, 'licen') OR contains(t, 'trash') THEN 'substring' WHEN list_has_any(string_split(t, ' '), ['us', 'th']) THEN 'token' ELSE 'none' END AS rule FROM n"),
    "ag17_label_rules": (_labels_by_rule, f"WITH n AS (SELECT doc_id, {_A} AS t FROM documents) SELECT CASE WHEN length(t) = 0 THEN 'empty' WHEN contains(t, 'licen') OR contains(t, 'trash') THEN 'substring' WHEN list_has_any(string_split(t, ' '), ['us', 'th']) THEN 'token' ELSE 'none' END AS rule, count(*) AS n FROM n GROUP BY 1"),
    "sf05_exact_match": (_exact_matches, f"WITH n AS (SELECT doc_id, source, {_A} AS k FROM documents), g AS (SELECT k, count(DISTINCT source) AS n FROM n WHERE length(k) > 0 GROUP BY 1 HAVING count(DISTINCT source) > 1) SELECT doc_id, g.n - 1 AS matches FROM n JOIN g ON g.k = n.k"),
    "sf06_abstention": (
        lambda s, d: _docs(s, d).select("doc_id", T.abstains(F.col("text")).alias("abstains"), T.abstains(F.col("text"), ["trash", "all rights", "released under"]).alias("holds_other")),
        rf"WITH n AS (SELECT doc_id, regexp_replace(lower(replace(text, '’', chr(39))), '\s+', ' ', 'g') AS t FROM documents) SELECT doc_id, {_ABSTAINS} AS abstains, contains(t, 'trash') OR contains(t, 'all rights') OR contains(t, 'released under') AS holds_other FROM n",
    ),
    "sf07_aliases": (_flat_aliases, rf"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), a AS (SELECT doc_id, list_filter(list_concat(ls[1:1], ls, list_transform(ls, lambda text: {_Q})), lambda x: x <> '') AS l FROM l), u AS (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM a) SELECT doc_id, len(l) AS aliases, sha256(array_to_string(l, chr(10))) AS digest FROM u"),
    "sf08_digits": (lambda s, d: _docs(s, d).select("doc_id", T.digits(F.col("text")).alias("digits")), "SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM documents"),
    "sf09_verhoeff": (
        _verhoeff,
        f"""WITH n AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 12, '9') AS t FROM orders), x AS (SELECT o_orderkey, list_transform(range(0, 12), lambda i: [i, CAST(t[12 - i] AS BIGINT)]) AS ds FROM n)
        SELECT o_orderkey, list_reduce(list_transform(ds, lambda p: {_P8}[(p[1] % 8) * 10 + p[2] + 1]), lambda c, p: {_D5}[c * 10 + p + 1], 0) = 0 AS valid FROM x""",
    ),
    "sf10_script_share": (lambda s, d: _docs(s, d).select("doc_id", F.round(T.script_share(F.col("text"), "Latin"), 9).alias("latin")), r"SELECT doc_id, round(CAST(length(regexp_replace(text, '[^\p{Latin}]', '', 'g')) AS DOUBLE) / nullif(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 0), 9) AS latin FROM documents"),
    "sf11_duration": (
        lambda s, d: table(s, d, "lineitem").select((F.concat((F.col("l_linenumber") * 3).cast("string"), F.substring(F.lit("smhdx"), (F.col("l_linenumber") % 5 + 1), F.lit(1)))).alias("t")).groupBy("t").agg(F.count("*").alias("n")).select("t", "n", T.seconds(F.col("t")).alias("seconds")),
        "WITH x AS (SELECT CAST(l_linenumber * 3 AS VARCHAR) || substr('smhdx', l_linenumber % 5 + 1, 1) AS t, count(*) AS n FROM lineitem GROUP BY 1) SELECT t, n, CASE right(t, 1) WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 END * TRY_CAST(left(t, length(t) - 1) AS BIGINT) AS seconds FROM x",
    ),
    "sf13_content_hash": (lambda s, d: _docs(s, d).select("doc_id", F.sha2("text", 256).alias("content"), F.sha2(F.concat(F.lit("GENESIS"), "text"), 256).alias("chained")), "SELECT doc_id, sha256(text) AS content, sha256('GENESIS' || text) AS chained FROM documents"),
    "sf16_one_key": (lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "sf17_half_even": (lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 4, 0).alias("rounded")), "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 0) AS rounded FROM lineitem"),
    "sf22_last_user_turn": (lambda s, d: table(s, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("prompt")), "SELECT conv_id, arg_max(text, turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY 1"),
    "tx02_pattern_counts": (_pattern_counts, _pattern_counts_sql()),
    "tx04_upi": (lambda s, d: _docs(s, d).where(F.col("text").rlike("(?i)" + T.UPI)).select("doc_id", F.element_at(T.found(F.col("text"), T.UPI), 1).alias("first")), f"SELECT doc_id, regexp_extract(text, '(?i){T.UPI}') AS first FROM documents WHERE regexp_matches(text, '(?i){T.UPI}')"),
    "tx06_ifsc": (lambda s, d: _docs(s, d).select("doc_id", F.col("text").rlike("(?i)" + T.IFSC).alias("found")), f"SELECT doc_id, regexp_matches(text, '(?i){T.IFSC}') AS found FROM documents"),
    "tx07_spans": (lambda s, d: _docs(s, d).select("doc_id", F.inline(T.span_column(F.col("text")))), None),
    "tx08_pii_score": (lambda s, d: _docs(s, d).select("doc_id", T.pii_score(F.col("text")).alias("score")), None),
    "so02_group_split": (lambda s, d: _splits(s, d), f"WITH {_split_sql('sp', 's1', 0.6, 0.2)} SELECT * FROM sp"),
    "so01_split_relationship": (
        lambda s, d: S.relationship(_splits(s, d), _splits(s, d, "s2", (0.5, 0.2, 0.3)), "user_id"),
        f"""WITH {_split_sql('a', 's1', 0.6, 0.2)}, {_split_sql('b', 's2', 0.5, 0.2)}, x AS (SELECT a.split AS a, b.split AS b FROM a FULL JOIN b USING (user_id))
        SELECT *, only_old = 0 AS is_promotion, paired >= 200 AS usable FROM (SELECT count(*) FILTER (a = 'test' AND b = 'test') AS paired, count(*) FILTER (a = 'test' AND b <> 'test') AS only_old, count(*) FILTER (a <> 'test' AND b = 'test') AS only_new, count(*) FILTER (a = 'train' AND b = 'test') AS old_train_in_new_test, count(*) FILTER (a = 'test' AND b = 'train') AS new_train_in_old_test FROM x)""",
    ),
    "so04_split_integrity": (
        lambda s, d: S.broken_integrity(table(s, d, "events").join(_splits(s, d), "user_id").withColumn("minute", F.minute("ts").cast("long")), ["minute", "event_type"]),
        f"WITH {_split_sql('sp', 's1', 0.6, 0.2)} SELECT minute(ts) AS minute, event_type, count(DISTINCT split) AS splits FROM events e JOIN sp ON sp.user_id = e.user_id GROUP BY 1, 2 HAVING count(DISTINCT split) > 1",
    ),
    "so07_dedup": (lambda s, d: S.first_of(_docs(s, d).select(T.question(F.col("text")).alias("q"), "doc_id", "source"), "q", "doc_id").select("doc_id", "source", "copies"), f"WITH n AS (SELECT {_Q} AS q, doc_id, source FROM documents) SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS copies FROM n GROUP BY q"),
    "pf07_usable_rows": (lambda s, d: _docs(s, d).where(F.length(T.question(F.col("text"))) > 20).groupBy("lang").agg(F.count("*").alias("kept")), f"SELECT lang, count(*) AS kept FROM documents WHERE length({_Q}) > 20 GROUP BY 1"),
    "pf06_segment": (lambda s, d: table(s, d, "events").where("event_type = 'error'").select("event_id", "value"), "SELECT event_id, value FROM events WHERE event_type = 'error'"),
    "sf07_part_type_suffix": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.regexp_replace("p_type", " (BRASS|STEEL)$", "").alias("category"), F.col("p_type").rlike(" (BRASS|STEEL)$").alias("stripped")),
        "SELECT p_partkey, regexp_replace(p_type, ' (BRASS|STEEL)$', '') AS category, regexp_matches(p_type, ' (BRASS|STEEL)$') AS stripped FROM part",
    ),
    "pf14_distinct_categories": (lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("event_type"))).alias("categories")), "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS categories FROM events GROUP BY 1"),
    "so09_pair_integrity": (_pair_integrity, _PAIRS),
    "so10_symmetric_difference": (
        _shape_difference,
        """WITH a AS (SELECT DISTINCT p_name AS name, p_type AS kind, p_size % 3 AS unit FROM part WHERE p_brand = 'Brand#1'), b AS (SELECT DISTINCT p_name AS name, p_type AS kind, p_size % 3 AS unit FROM part WHERE p_brand = 'Brand#2')
        (SELECT *, 'first' AS only_in FROM a EXCEPT SELECT *, 'first' FROM b) UNION ALL (SELECT *, 'second' FROM b EXCEPT SELECT *, 'second' FROM a)""",
    ),
    "ag27_cosine": (
        _cosines,
        """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id, list_dot_product(a.v, b.v) AS d, list_dot_product(a.v, a.v) AS n, list_dot_product(b.v, b.v) AS m FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
        SELECT vec_id, round(d / greatest(sqrt(n) * sqrt(m), 1e-12), 6) AS cosine, round(sqrt(greatest(n + m - 2 * d, 0)) / greatest(sqrt(n), 1e-12), 6) AS relative_l2 FROM p""",
    ),
    "ud02_probe_score": (_probe, "WITH v AS (SELECT vec_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, label, round(1 / (1 + exp(-(list_dot_product(v, list_transform(range(0, 64), lambda i: cos(i))) - 0.25))), 6) AS score FROM v"),
    "wn11_max_rolling_means": (_rolling, "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, round(list_max(list_transform(range(0, 57, 4), lambda i: list_sum(v[i + 1:i + 8]) / 8)), 6) AS max_rolling, round(list_sum(v) / 64, 6) AS mean_pool, round(v[64], 6) AS last FROM v"),
    "tk02_canary": (_canary, _CANARY),
    "tk03_longest_source": (_best_by, "WITH g AS (SELECT lang, source, round(avg(n_chars), 6) AS score FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, source) AS nth FROM g) SELECT lang, source, score FROM r WHERE nth = 1"),
    "tk05_even_picks": (_even_picks, "WITH x AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS place, count(*) OVER () AS n FROM documents), w AS (SELECT DISTINCT CAST(floor(i * ((SELECT max(n) FROM x) - 1) / 19::DOUBLE + 0.5) AS BIGINT) AS place FROM range(20) t(i)) SELECT doc_id, n_chars FROM x JOIN w USING (place)"),
    "df06_base_rates": (lambda s, d: probe_items(s, d).groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("vec")).cast("long").alias("dimensions")), "SELECT CASE WHEN label < 5 THEN 1 ELSE 0 END AS label, count(*) AS n, CAST(min(len(embedding)) AS BIGINT) AS dimensions FROM embeddings GROUP BY 1"),
    "ud09_determinism": (
        _determinism,
        """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT vec_id, round(1 / (1 + exp(-(list_dot_product(v, list_transform(range(0, 64), lambda i: cos(i))) - 0.25))), 6) AS score FROM v),
        h AS (SELECT CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR) || '|' || CAST(CAST(round_even(score * 1e6, 0) AS BIGINT) AS VARCHAR)), 1, 8)) AS BIGINT) AS h FROM p)
        SELECT count(*) AS n, 0::DOUBLE AS largest, CAST(sum(h) AS BIGINT) AS digest_a, CAST(sum(h) AS BIGINT) AS digest_b FROM h""",
    ),
}
