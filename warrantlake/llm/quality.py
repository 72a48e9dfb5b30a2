"""Quality rules with a robust multivariate outlier test, in DataFrame functions alone.

Base rules count words, symbols, repeated lines and words in repeated three-word windows of the whole text. Rows
that pass them are judged by a minimum-covariance-determinant (MCD) estimate of their language and source: from
two deterministic starts, concentration steps keep the ``COVERAGE`` share of rows nearest to the current estimate
and re-estimate mean and covariance from them; the start of the smaller determinant wins, is scaled by its median
distance, and re-estimated once from all rows within the usual cutoff. A row is rejected when its squared
Mahalanobis distance from that estimate is above ``CUTOFF``.

Every step is an aggregation by group (sums, approximate percentiles), which combines before the shuffle, and a
join with the table of groups, which is written and counted first and broadcast where it has few rows; a source that holds a third of all rows costs no more than others. Groups of fewer
than ``LEAST`` rows are judged with the small groups of their language, and if those are few, with all such.

Nulls: a null text has no words and fails the base rules; null languages and sources are groups of their own.
Where even the last group has fewer than ``LEAST`` rows, the base rules alone decide. Copies are rows like any
other. An empty table gives no rows. Very long texts are counted whole. Repeated windows are told by a 64-bit hash of
their three words; two different windows of one text share a hash with a probability of about w * w / 2^65 for w
words. Only ``doc_id``, ``lang``, ``source`` and ``text`` are read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warrantlake.llm.common import written

#: Tables of so many groups are broadcast; larger ones are joined by a shuffle.
FEW_GROUPS = 20_000
FEATURES = ("x0", "x1", "x2", "x3", "x4")
#: Added to each feature's standard deviation, so that a feature that is constant in a group judges softly.
SPREAD = (0.25, 0.25, 0.3, 0.15, 0.4)
COVERAGE, STEPS, LEAST = 0.75, 4, 80
#: Chi-squared of five degrees: median, 97.5 %, and the squared distance of rejection (a probability of 1e-6).
MEDIAN, USUAL, CUTOFF = 4.351, 12.833, 35.888
LEAST_WORDS, REPEAT_PERCENT = 50, 50
_BLANKS = " \t\n\x0b\x0c\r"


def _by_group(groups: DataFrame, name: str) -> DataFrame:
    """A table of one row a group, written, and broadcast where its counted rows are few."""
    table = written(groups, name)
    return F.broadcast(table) if table.count() <= FEW_GROUPS else table


def _let(value: Column, body) -> Column:
    """``body(value)``, where the value is computed once for all places in the body."""
    return F.transform(F.array(value), body)[0]


def _covered(words: Column) -> Column:
    """Words in three-word windows that are found at least twice: windows as hashes, sorted with their places."""

    def of_windows(hashed: Column) -> Column:
        return _let(
            F.array_sort(hashed),
            lambda s: F.size(
                F.array_distinct(
                    F.flatten(
                        F.transform(
                            F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False))),
                            lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2),
                        )
                    )
                )
            ),
        )

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(of_windows(windows))


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, and the counts of the base rules over the whole text."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, "[ \t-\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, _BLANKS, "") != "")
    counts = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _covered(w).cast("long").alias("n_repeat_words")))
    return docs.select(
        "doc_id",
        "lang",
        "source",
        counts.alias("c"),
        F.length(F.translate(text, _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "lang", "source", "c.n_words", "word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words")


def with_features(stats: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    of = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return stats.withColumns(
        {
            "base_failed": failed,
            "x0": F.log1p(F.col("n_words").cast("double")),
            "x1": of("word_chars", "n_words"),
            "x2": F.log1p(100 * of("n_symbols", "word_chars")),
            "x3": F.sqrt(of("n_repeat_words", "n_words")),
            "x4": F.log1p(F.col("n_dup_lines").cast("double")),
        }
    )


def _grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with ``grp``: language and source, or what small groups are judged with; null where rows are too few."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    named = rows.withColumns({"_l": name("lang"), "_s": name("source")})
    own = named.where(~F.col("base_failed")).groupBy("_l", "_s").agg(F.count("*").alias("n_own"))
    small = own.where(F.col("n_own") < LEAST)
    of_lang = small.groupBy("_l").agg(F.sum("n_own").alias("n_lang"))
    n_rest = of_lang.where(F.col("n_lang") < LEAST).agg(F.sum("n_lang").alias("n")).first()["n"] or 0
    groups = own.join(of_lang, "_l", "left")
    grp = (
        F.when(F.col("n_own") >= LEAST, F.to_json(F.struct("_l", "_s")))
        .when(F.col("n_lang") >= LEAST, F.to_json(F.struct("_l")))
        .when(F.lit(n_rest >= LEAST), F.lit("{}"))
    )
    return named.join(_by_group(groups.select("_l", "_s", grp.alias("grp")), "groups"), ["_l", "_s"], "left").drop("_l", "_s")


def _estimates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, Cholesky factor of the covariance, and log determinant of each group."""
    sums = [F.avg(x).alias(f"m_{x}") for x in FEATURES]
    sums += [F.covar_pop(a, b).alias(f"c_{i}{j}") for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES[: i + 1])]
    out = rows.groupBy(*keys).agg(*sums)
    for i in range(len(FEATURES)):
        for j in range(i + 1):
            rest = F.col(f"c_{i}{j}") + (F.lit(SPREAD[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            out = out.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}{j}"))
    logs = [F.log(F.col(f"l_{i}{i}")) for i in range(len(FEATURES))]
    return out.select(*keys, *(f"m_{x}" for x in FEATURES), *(f"l_{i}{j}" for i in range(len(FEATURES)) for j in range(i + 1)), (2 * sum(logs[1:], logs[0])).alias("log_det"))


def _distance(rows: DataFrame) -> DataFrame:
    """With ``d``: squared Mahalanobis distance, by forward substitution."""
    out, parts = rows, []
    for i, x in enumerate(FEATURES):
        rest = F.col(x) - F.col(f"m_{x}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}{j}") * F.col(f"_y{j}")
        out = out.withColumn(f"_y{i}", rest / F.col(f"l_{i}{i}"))
        parts.append(F.pow(F.col(f"_y{i}"), 2))
    return out.withColumn("d", sum(parts[1:], parts[0])).drop(*(f"_y{i}" for i in range(len(FEATURES))))


def mcd(rows: DataFrame) -> DataFrame:
    """Estimates by ``grp`` for rows (grp, features): mean, Cholesky factor, and ``scale`` of the squared distances."""
    keys = ["grp", "start"]
    medians = _by_group(rows.groupBy("grp").agg(*(F.percentile_approx(x, 0.5, 2000).alias(f"med_{x}") for x in FEATURES)), "medians")
    centred = rows.join(medians, "grp")
    mads = _by_group(centred.groupBy("grp").agg(*(F.percentile_approx(F.abs(F.col(x) - F.col(f"med_{x}")), 0.5, 2000).alias(f"mad_{x}") for x in FEATURES)), "deviations")
    z = [F.abs(F.col(x) - F.col(f"med_{x}")) / (1.4826 * F.col(f"mad_{x}") + SPREAD[i]) for i, x in enumerate(FEATURES)]
    squares = [F.pow(v, 2) for v in z]
    starts = F.array(F.struct(F.lit(0).alias("start"), sum(squares[1:], squares[0]).alias("d")), F.struct(F.lit(1).alias("start"), F.greatest(*z).alias("d")))
    now = written(centred.join(mads, "grp").select("grp", *FEATURES, F.explode(starts).alias("s")).select("grp", *FEATURES, "s.start", "s.d"), "starts")
    base = now.drop("d")
    for _ in range(STEPS):
        nearest = _by_group(now.groupBy(*keys).agg(F.percentile_approx("d", COVERAGE, 2000).alias("most")), "nearest")
        inside = now.join(nearest, keys).where(F.col("d") <= F.col("most"))
        estimate = _by_group(_estimates(inside, keys), "estimates")
        now = _distance(base.join(estimate, keys)).select("grp", "start", *FEATURES, "d")
    scales = now.groupBy(*keys).agg((F.percentile_approx("d", 0.5, 2000) / MEDIAN).alias("scale"))
    best = estimate.groupBy("grp").agg(F.min(F.struct("log_det", "start")).alias("b")).select("grp", F.col("b.start").alias("start"))
    chosen = _by_group(estimate.join(best, keys).join(scales, keys).drop("start"), "chosen")
    usual = _distance(rows.join(chosen, "grp")).where(F.col("d") <= USUAL * F.greatest("scale", F.lit(1e-3)))
    return _by_group(_estimates(usual, ["grp"]), "reweighted")


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, ``base_failed``, ``kept`` and ``distance`` (null where the base rules alone decide) of every row."""
    rows = written(_grouped(with_features(written(base_statistics(docs), "statistics"))), "features")
    fit = rows.where(~F.col("base_failed") & F.col("grp").isNotNull()).select("grp", *FEATURES)
    judged = _distance(rows.join(mcd(fit), "grp", "left"))
    distance = F.when(~F.col("base_failed"), F.col("d"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(distance <= CUTOFF, F.lit(True))).alias("kept"), distance.alias("distance"),
    )


def op4_mcd(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
