"""Tables inside text, nested controls, responses to drift, and identifier kinds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from warrantlake.functions import bounds as B
from warrantlake.functions import text as T
from warrantlake.operators import drift as D
from warrantlake.operators import metrics as M
from warrantlake.operators import resample as R
from warrantlake.plans.q_drift import PSI, REPS, TAU, _groups, _psi
from warrantlake.plans.q_evidence import block_sql
from warrantlake.sources.views import scored_items, table


def _lines(s, d):
    """Lines of documents with their place; a table's rows are those with cells after the document's first such line."""
    x = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    cells = x.withColumn("cells", F.when(F.contains("t", F.lit(" | ")), F.size(F.split("t", r" \| "))))
    order = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("header_cells", F.first("cells", ignorenulls=True).over(order))


_LINES = """x AS (SELECT doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
  c AS (SELECT *, CASE WHEN contains(t, ' | ') THEN len(string_split(t, ' | ')) END AS cells FROM x),
  h AS (SELECT *, first_value(cells IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS header_cells FROM c)"""


def _controls_of(s, d):
    li = table(s, d, "lineitem")
    c = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("name"), (F.col("l_quantity") > 5).alias("passed"), (F.col("l_tax") > 0).alias("applicable")))).alias("controls"))
    pick = lambda keep: F.concat_ws(",", F.transform(F.filter("controls", keep), lambda x: x["name"].cast("string")))
    return c.select("l_orderkey", pick(lambda x: x["applicable"] & ~x["passed"]).alias("failed"), pick(lambda x: ~x["applicable"]).alias("inapplicable"))


def _response(s, d):
    """Verdict, next status, and the bounds that hold: as they were, widened about the rate, or none."""
    p = _psi(s, d).withColumn("state", D.state(F.col("psi"))).withColumn("status", D.ladder(F.lit("VALID"), F.col("state")))
    rate = (F.col("n_live") / (F.col("n_live") + F.col("n_reference"))).alias("rate")
    x = p.select("event_type", "state", "status", rate).withColumns({"low": F.col("rate") - 0.05, "high": F.col("rate") + 0.08})
    w = F.when(F.col("state") == "MODERATE", 1.5).when(F.col("state") == "INSIDE", 1.0)
    return x.select("event_type", "state", "status", F.round(F.col("rate") - w * (F.col("rate") - F.col("low")), 9).alias("low"), F.round(F.col("rate") + w * (F.col("high") - F.col("rate")), 9).alias("high"))


def _kinds(s, d):
    text = F.col("text")
    twelve = F.filter(F.transform(T.found(text, T.TWELVE), T.digits), lambda n: F.length(n) == 12)
    phones = F.filter(F.transform(T.found(text, T.PHONE), T.digits), lambda n: F.length(n).between(10, 13))
    return table(s, d, "documents").select("doc_id", F.size(twelve).alias("twelve_digits"), F.size(F.filter(twelve, T.verhoeff_valid)).alias("valid"), F.size(T.found(text, T.PAN)).alias("pans"), F.size(phones).alias("phones"), F.size(F.filter(phones, lambda n: F.substring(n, -10, 1).isin(*"6789"))).alias("plausible"))


#: To SQL's patterns a word is ASCII, white space has no vertical tab, and the letters s and k have a third form.
BOUND = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
BLANK, LETTERS = r" \t\n\f\r", "A-Za-zſK"
SEPARATOR = r"[\s.\-:]"
#: Separator-tolerant shapes and their base scores.
TOLERANT = {
    "aadhaar_tolerant": (rf"\b[0-9]{{4}}{SEPARATOR}{{0,3}}[0-9]{{4}}{SEPARATOR}{{0,3}}[0-9]{{4}}\b", 0.01),
    "aadhaar_pairs": (rf"\b(?:[0-9]{{2}}{SEPARATOR}{{1,3}}){{5}}[0-9]{{2}}\b", 0.01),
    "pan_tolerant": (rf"\b[A-Za-z]{{3}}{SEPARATOR}{{0,3}}[A-Za-z]{{2}}[0-9]{SEPARATOR}{{0,3}}[0-9]{{3}}{SEPARATOR}{{0,3}}[A-Za-z]\b", 0.3),
    "upi": (r"\b[A-Za-z0-9._-]{3,}\s?@\s?[A-Za-z]{2,}\b", 0.6),
    "upi_spelled": (r"\b[A-Za-z0-9._-]{3,}\s+(?:at the rate|at)\s+[A-Za-z]{2,}\b", 0.4),
    "ifsc": (r"\b[A-Za-z]{4}0[A-Za-z0-9]{6}\b", 0.6),
    "ifsc_tolerant": (rf"\b[A-Za-z]{{2}}{SEPARATOR}{{0,3}}[A-Za-z]{{2}}{SEPARATOR}{{0,3}}0(?:{SEPARATOR}{{0,3}}[A-Za-z0-9]{{1,6}}){{1,6}}\b", 0.35),
}


def _found(pattern: str):
    """Whether ``text`` holds the pattern as SQL reads it."""
    spaced = pattern.replace(r"[\s", f"[{BLANK}").replace(r"\s", f"[{BLANK}]")
    return F.col("text").rlike("(?i)" + spaced.replace("A-Za-z", LETTERS).replace(r"\b", BOUND))


def _tolerant(s, d):
    return table(s, d, "documents").select("doc_id", F.greatest(*[F.when(_found(p), c).otherwise(0.0) for p, c in TOLERANT.values()]).alias("score"), *(_found(p).alias(n) for n, (p, _) in TOLERANT.items()))


def _estimated(s, d):
    """Recall by set with its bootstrap interval, or the exact one where the bootstrap has no width."""
    counts = M.confusion(scored_items(s, d), ["eval_set_id"], TAU).withColumns({"k": F.col("tp"), "n": F.col("tp") + F.col("fn")})
    boot = R.interval(R.replicates(_groups(s, d), ["eval_set_id"], REPS, "recall", list(R.COUNTS)), ["eval_set_id"], R.recall())
    x = B.with_bounds(counts.select("eval_set_id", "k", "n"), "k", "n").join(boot, "eval_set_id", "left")
    flat = F.coalesce(F.col("ci_high") - F.col("ci_low") < 1e-12, F.lit(True))
    return x.select("eval_set_id", F.round(M.ratio(F.col("k"), F.col("n")), 9).alias("recall"), F.round(F.when(flat, F.col("cp_low")).otherwise(F.col("ci_low")), 9).alias("low"), F.round(F.when(flat, F.col("cp_high")).otherwise(F.col("ci_high")), 9).alias("high"), flat.alias("exact"))



QUERIES = {
    "io14_table_lines": (lambda s, d: _lines(s, d).where("cells is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("cells").cast("long").alias("widest"), F.count_if(F.col("cells") == F.col("header_cells")).alias("as_header")), f"WITH {_LINES} SELECT doc_id, count(*) AS rows, max(cells) AS widest, count(*) FILTER (cells = header_cells) AS as_header FROM h WHERE cells IS NOT NULL GROUP BY 1"),
    "wn12_inside_table": (lambda s, d: _lines(s, d).groupBy("doc_id").agg(F.count_if(F.col("header_cells").isNotNull()).alias("lines_behind_header"), F.count("*").alias("lines")), f"WITH {_LINES} SELECT doc_id, count(*) FILTER (header_cells IS NOT NULL) AS lines_behind_header, count(*) AS lines FROM h GROUP BY 1"),
    "pf10_failed_controls": (_controls_of, "SELECT l_orderkey, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) FILTER (l_tax > 0 AND NOT l_quantity > 5), '') AS failed, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) FILTER (NOT l_tax > 0), '') AS inapplicable FROM lineitem GROUP BY 1"),
    "wn04_widened_rates": (
        _response,
        f"""WITH {PSI}, st AS (SELECT event_type, CASE WHEN psi < 0.1 THEN 'INSIDE' WHEN psi < 0.25 THEN 'MODERATE' ELSE 'SIGNIFICANT' END AS state, CAST(n_live AS DOUBLE) / (n_live + n_reference) AS rate FROM psi),
        w AS (SELECT *, CASE state WHEN 'MODERATE' THEN 1.5::DOUBLE WHEN 'INSIDE' THEN 1.0::DOUBLE END AS w FROM st)
        SELECT event_type, state, CASE state WHEN 'INSIDE' THEN 'VALID' WHEN 'MODERATE' THEN 'STALE' ELSE 'REVOKED' END AS status, round(rate - w * (rate - (rate - 0.05::DOUBLE)), 9) AS low, round(rate + w * (rate + 0.08::DOUBLE - rate), 9) AS high FROM w""",
    ),
    "tx01_identifier_kinds": (_kinds, None),
    "tx10_tolerant_score": (_tolerant, "SELECT doc_id, greatest(" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN {c}::DOUBLE ELSE 0::DOUBLE END" for p, c in TOLERANT.values()) + ") AS score, " + ", ".join(f"regexp_matches(text, '(?i){p}') AS {n}" for n, (p, _) in TOLERANT.items()) + " FROM documents"),
    "st02_estimated": (
        _estimated,
        f"""WITH {block_sql(seed="recall")} SELECT lg.s AS eval_set_id, round(value, 9) AS recall, round(CASE WHEN coalesce(hi - lo < 1e-12, true) THEN CASE WHEN o > 0 THEN {B.low_sql("k", "o")} END ELSE lo END, 9) AS low,
        round(CASE WHEN coalesce(hi - lo < 1e-12, true) THEN CASE WHEN o > 0 THEN {B.high_sql("k", "o")} END ELSE hi END, 9) AS high, coalesce(hi - lo < 1e-12, true) AS exact FROM lg LEFT JOIN iv ON iv.s = lg.s AND iv.metric = 'recall' WHERE lg.metric = 'recall'""",
    ),
    "io21_scoring_counts": (lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("scorings"), F.max("ts").alias("last")), "SELECT user_id, count(*) AS scorings, max(ts) AS last FROM events GROUP BY 1"),
    "sf12_canonical_json": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.sha2(F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("key"), F.col("p_size").alias("size"))), 256).alias("digest")),
        """SELECT p_partkey, sha256('{"brand":"' || p_brand || '","key":' || p_partkey || ',"size":' || p_size || '}') AS digest FROM part""",
    ),
}
