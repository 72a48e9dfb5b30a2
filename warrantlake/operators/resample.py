"""Cluster bootstraps with draws from a hash: every draw looks its group up in packed blocks, or meets a matrix of wins.

Draws of one key and replicate stay in one task, so nothing that is summed by replicate is shuffled again; the more rows
are drawn, the more tasks share the replicates. Groups are
packed into blocks of ``BLOCK``, with an array for each count; blocks of up to ``HELD`` values are broadcast, larger
tables are joined by shuffles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warrantlake.functions.rng import draw
from warrantlake.operators import ranges as G
from warrantlake.operators.metrics import ratio
from warrantlake.sources.shared import written

COUNTS = ("tp", "fp", "tn", "fn")
#: Groups of a block, draws made from one row, tasks of all draws, and packed values that are broadcast at most.
BLOCK, RUN, TASKS, HELD = 256, 1 << 16, 64, 1 << 23
#: Rows that a task draws on the average at most, where more than ``TASKS`` tasks are needed for that.
DEALT = 1 << 19
#: Groups of a key at most for its matrix of wins, its cells for each counted row, ranges of scores, parts of replicates.
MATRIX, CELLS, RANGES, PARTS = 1024, 16, 64, 16
NUMBERS = ("tinyint", "smallint", "int", "bigint")


def numbered_groups(items: DataFrame, keys: list[str], unit: str, threshold: float, score: str = "score", prefix: str = "") -> DataFrame:
    """tp, fp, tn, fn of each unit, numbered from 0 by the order of its name, and the units of its key."""
    f, y = F.col(score) >= threshold, F.col("label") == 1
    g = items.groupBy(*keys, unit).agg(*(F.count_if(c).alias(prefix + n) for n, c in zip(COUNTS, (f & y, f & ~y, ~f & ~y, ~f & y), strict=True)))
    if dict(items.dtypes)[unit] not in NUMBERS:
        return g.withColumns({"g": F.row_number().over(Window.partitionBy(*keys).orderBy(unit)) - 1, "groups": F.count("*").over(Window.partitionBy(*keys))})
    sizes = g.groupBy(*keys).agg(F.count("*").alias("groups"))
    return G.numbered(g, keys, F.col(unit), [unit], "g").withColumn("g", F.col("g") - 1).join(sizes, keys)


def each_draw(sizes: DataFrame, keys: list[str], n: int, seed: Column | str, tasks: int = TASKS) -> DataFrame:
    """keys, rep, g: as many draws with replacement as the key has ``groups``, in each of ``n`` replicates, a row each."""
    reps = sizes.select(*keys, F.col("groups").cast("long").alias("groups"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep")).repartition(tasks, *keys, "rep")
    runs = reps.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(groups - 1) div {RUN}"))))
    each = runs.withColumn("i", F.explode(F.sequence(F.col("_run") * RUN, F.least(F.col("groups"), (F.col("_run") + 1) * RUN) - 1)))
    return each.select(*keys, "rep", (draw(F.lit(seed) if isinstance(seed, str) else seed, "rep", "i") % F.col("groups")).alias("g"))


def draws(groups: DataFrame, keys: list[str], n: int, seed: Column | str) -> DataFrame:
    """keys, rep, g and ``times`` that it was drawn."""
    sizes = groups.groupBy(*keys).agg(F.max("groups").alias("groups"))
    return each_draw(sizes, keys, n, seed).groupBy(*keys, "rep", "g").agg(F.count("*").alias("times"))


def _located(drawn: DataFrame, keys: list[str], blocks: DataFrame, held: bool) -> DataFrame:
    """Draws beside the block of their group, in which they stand at ``_at``."""
    at = drawn.withColumns({"_block": F.expr(f"g div {BLOCK}"), "_at": (F.col("g") % BLOCK).cast("int")})
    return at.join(F.broadcast(blocks) if held else blocks, [*keys, "_block"])


def _each(rows: str, field: str) -> Column:
    return F.transform(rows, lambda r: r[field])


def replicates(groups: DataFrame, keys: list[str], n: int, seed: Column | str, counts: list[str]) -> DataFrame:
    """Summed counts of each replicate: as many draws with replacement as the key has groups."""
    rows = groups.withColumn("_block", F.expr(f"cast(g as bigint) div {BLOCK}")).groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct("g", *counts))).alias("_rows"), F.max("groups").alias("groups"))
    blocks = written(rows.select(*keys, "_block", "groups", *(_each("_rows", c).alias(c) for c in counts)), "blocks")
    sizes = blocks.groupBy(*keys).agg(F.max("groups").alias("groups"))
    met = _located(each_draw(sizes, keys, n, seed), keys, blocks.drop("groups"), blocks.count() * BLOCK * len(counts) <= HELD)
    return met.groupBy(*keys, "rep").agg(*(F.sum(F.get(c, F.col("_at"))).alias(c) for c in counts))


def drawn_items(items: DataFrame, keys: list[str], n: int, seed: Column | str, values: list[str]) -> DataFrame:
    """keys, rep and ``values``, a row for each item of each drawn group.

    ``items``: keys, ``groups``, ``g`` and values; a group may have several rows, or none.
    """
    of_group = items.groupBy(*keys, "g").agg(F.collect_list(F.struct(*values)).alias("_rows"), F.count("*").cast("int").alias("_n"), F.max("groups").cast("long").alias("groups")).withColumn("g", F.col("g").cast("long"))
    every = of_group.groupBy(*keys).agg(F.max("groups").alias("groups")).select(*keys, "groups", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(groups - 1) div {BLOCK}"))).alias("_block"))
    every = every.withColumn("g", F.explode(F.sequence(F.col("_block") * BLOCK, F.least(F.col("groups"), (F.col("_block") + 1) * BLOCK) - 1)))
    of_group = every.join(of_group.drop("groups"), [*keys, "g"], "left").withColumns({"_n": F.coalesce("_n", F.lit(0)), "_rows": F.coalesce("_rows", F.array())})
    before = Window.partitionBy(*keys, "_block").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    placed = of_group.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("int"))
    rows = placed.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct("g", "_from", "_n", "_rows"))).alias("_all"), F.max("groups").alias("groups"))
    flat = rows.withColumn("_flat", F.flatten(_each("_all", "_rows")))
    blocks = written(flat.select(*keys, "_block", "groups", _each("_all", "_from").alias("_from"), _each("_all", "_n").alias("_n"), *(_each("_flat", c).alias(f"_of_{c}") for c in values)), "blocks")
    size = blocks.agg(F.sum(F.size(f"_of_{values[0]}").cast("long")).alias("rows"), F.max(F.array_max("_n")).alias("most")).first()
    sizes = blocks.groupBy(*keys).agg(F.max("groups").alias("groups"))
    tasks = max(TASKS, n * (size["rows"] or 0) // DEALT)
    met = _located(each_draw(sizes, keys, n, seed, tasks), keys, blocks.drop("groups"), (size["rows"] or 0) * len(values) <= HELD).where(F.get("_n", F.col("_at")) > 0)
    first = F.get("_from", F.col("_at"))
    if size["most"] != 1:
        met = met.withColumn("_p", F.explode(F.sequence(first, first + F.get("_n", F.col("_at")) - 1)))
        first = F.col("_p")
    return met.select(*keys, "rep", *(F.get(f"_of_{c}", first).alias(c) for c in values))


def replicated(counted: DataFrame, keys: list[str], more: list[str], n: int, seed: Column | str, counts: list[str]) -> DataFrame:
    """``replicates`` of counts by group and ``more``, a row for each of ``more`` that a replicate met."""
    met = drawn_items(counted, keys, n, seed, [*more, *counts])
    return met.groupBy(*keys, "rep", *more).agg(*(F.sum(c).alias(c) for c in counts))


def wins(grain: DataFrame, by: list[str]) -> DataFrame:
    """by, g, ``against``: how often g's positives rank above the negatives of each group 0, 1, ..., doubled, ties once.

    ``grain``: by, g, score, pos, neg. Scores are cut into ranges; within one the pairs are counted from running
    counts of each group, and a range's positives win against all negatives of the ranges below.
    """
    cuts = grain.groupBy(*by).agg(F.percentile_approx("score", [i / RANGES for i in range(1, RANGES)], 1000).alias("_cuts"))
    ranged = grain.join(cuts, by).select(*by, F.size(F.filter("_cuts", lambda c: c < F.col("score"))).alias("_range"), F.col("g").cast("long").alias("g"), "score", F.col("pos").cast("long").alias("pos"), F.col("neg").cast("long").alias("neg"))
    kinds = {c: t for c, t in ranged.dtypes}

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        size = int(rows["g"].max()) + 1
        scores, at = np.unique(rows["score"].to_numpy(), return_inverse=True)
        pos, neg = (np.zeros((len(scores), size), np.int64) for _ in range(2))
        for table, c in ((pos, "pos"), (neg, "neg")):
            np.add.at(table, (at, rows["g"].to_numpy()), rows[c].to_numpy())
        won = pos.T @ (2 * np.cumsum(neg, axis=0) - neg)
        g, h = np.nonzero(won)
        return pd.DataFrame({c: rows[c].iloc[0] for c in by} | {"g": g, "h": h, "won": won[g, h]}, columns=[*by, "g", "h", "won"], index=range(len(g)))

    inside = ranged.groupBy(*by, "_range").applyInPandas(within, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "g long", "h long", "won long"]))
    totals = ranged.groupBy(*by, "_range", "g").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lower = totals.where("neg > 0").select(*by, F.col("_range").alias("_lower"), F.col("g").alias("h"), "neg")
    across = totals.where("pos > 0").drop("neg").join(lower, by).where("_lower < _range").select(*by, "g", "h", (2 * F.col("pos") * F.col("neg")).alias("won"))
    cells = inside.unionByName(across).groupBy(*by, "g", "h").agg(F.sum("won").alias("won"))
    return cells.groupBy(*by, "g").agg(F.collect_list(F.struct("h", "won")).alias("against"))


def _by_matrix(grain: DataFrame, drawn: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    """The rank statistic of each replicate from the wins of group against group, whatever the number of items."""
    by = [*keys, *more]
    totals = grain.groupBy(*by, "g").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    known = totals.join(wins(grain, by), [*by, "g"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    side = known.toDF(*(f"_{c}" for c in known.columns))
    parted = drawn.withColumn("_part", F.col("rep") % PARTS)
    if more:
        parted = parted.join(grain.select(*by).distinct(), keys)
    kinds, known_columns = dict(known.dtypes), known.columns

    def met(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told.columns = known_columns
        size = int(max(rows["g"].max(), told["g"].max())) + 1
        won, sides = np.zeros((size, size), np.int64), np.zeros((size, 2), np.int64)
        for g, pos, neg, against in zip(told["g"], told["pos"], told["neg"], told["against"], strict=True):
            sides[g] = pos, neg
            for cell in against if against is not None else ():
                won[g, cell["h"]] = cell["won"]
        reps, at = np.unique(rows["rep"].to_numpy(), return_inverse=True)
        times = np.zeros((len(reps), size), np.int64)
        times[at, rows["g"].to_numpy()] = rows["times"].to_numpy()
        found = times @ sides
        return pd.DataFrame({c: told[c].iloc[0] for c in by} | {"rep": reps, "won": ((times @ won) * times).sum(axis=1), "pos": found[:, 0], "neg": found[:, 1]}, columns=[*by, "rep", "won", "pos", "neg"])

    shape = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "rep int", "won long", "pos long", "neg long"])

    def both(key: tuple, rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        return met(rows, told) if len(rows) and len(told) else pd.DataFrame(columns=[*by, "rep", "won", "pos", "neg"])

    return parted.groupBy(*by, "_part").cogroup(side.groupBy(*(f"_{c}" for c in (*by, "_part")))).applyInPandas(both, shape)


def _by_scores(grain: DataFrame, keys: list[str], more: list[str], n: int, seed: Column | str) -> DataFrame:
    """The same from counts of each replicate at each distinct score, in the task that made its draws."""
    at = [*more, "score"]
    counted = drawn_items(grain, keys, n, seed, [*at, "pos", "neg"]).groupBy(*keys, "rep", *at).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    upto = F.sum("neg").over(Window.partitionBy(*keys, "rep", *more).orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("won", F.col("pos") * (2 * upto - F.col("neg"))).groupBy(*keys, *more, "rep").agg(*(F.sum(c).alias(c) for c in ("won", "pos", "neg")))


def replicate_areas(grain: DataFrame, keys: list[str], more: list[str], n: int, seed: Column | str) -> DataFrame:
    """keys, more, rep, ``v``: the rank statistic of each replicate, ties at half; null where a class is missing.

    ``grain``: keys, ``groups``, g, more, score, pos, neg; one draw of a key's groups serves all of ``more``. Where a key
    has few groups beside its counted rows, they meet as a matrix of wins, else each draw brings its group's rows.
    """
    of_key = grain.groupBy(*keys).agg(F.max("groups").cast("double").alias("g"), F.count("*").alias("rows"))
    size = of_key.agg(F.max("g").alias("most"), F.sum(F.col("g") * F.col("g")).alias("cells"), F.sum("rows").alias("rows")).first()
    if size["most"] is not None and size["most"] <= MATRIX and size["cells"] <= CELLS * size["rows"]:
        found = _by_matrix(grain.drop("groups"), draws(grain, keys, n, seed), keys, more)
    else:
        found = _by_scores(grain, keys, more, n, seed)
    return found.select(*keys, *more, "rep", ratio(F.col("won"), 2 * F.col("pos") * F.col("neg")).alias("v"))


def replicate_auroc(items: DataFrame, groups: DataFrame, keys: list[str], unit: str, n: int, seed: Column | str) -> DataFrame:
    """keys, rep, ``v`` of ``replicate_areas`` over the items' groups."""
    grain = items.groupBy(*keys, unit, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    numbered = grain.join(groups.select(*keys, unit, "g", "groups"), [*keys, unit]).drop(unit)
    return replicate_areas(written(numbered, "grain"), keys, [], n, seed)


def interval(reps: DataFrame, keys: list[str], statistic: Column, level: float = 0.95, one_sided: bool = False) -> DataFrame:
    """Percentile interval of the defined replicates; none where more than a tenth of them is undefined.

    One-sided, all of the error lies at the upper end.
    """
    x = reps.withColumn("v", statistic)
    low, high = (0.0, level) if one_sided else ((1 - level) / 2, (1 + level) / 2)
    q = lambda p: F.when(10 * F.count_if(F.col("v").isNull()) <= F.count("*"), F.percentile("v", F.lit(p)))
    return x.groupBy(*keys).agg(q(low).alias("ci_low"), q(high).alias("ci_high"), F.count("v").alias("replicates"), F.count_if(F.col("v").isNull()).alias("undefined"))


def recall(prefix: str = ""):
    return ratio(F.col(prefix + "tp"), F.col(prefix + "tp") + F.col(prefix + "fn"))


def precision(prefix: str = ""):
    return ratio(F.col(prefix + "tp"), F.col(prefix + "tp") + F.col(prefix + "fp"))


def flag_rate(prefix: str = ""):
    return ratio(F.col(prefix + "tp") + F.col(prefix + "fp"), F.col(prefix + "tp") + F.col(prefix + "fp") + F.col(prefix + "tn") + F.col(prefix + "fn"))
