"""Two scores compared on the items that both models held out: rank statistic and recall, in two threshold regimes.

Clusters are drawn once and both models are recomputed on that one draw, so what they share cancels in the
difference. ``pinned`` judges both at the baseline's thresholds; ``own`` judges each at its own, within the same
flag-rate budgets. A key with too few items held out by both is refused, with no numbers.

Recall of a replicate comes from counts by cluster, its rank statistic from counts by cluster and distinct score, or
from the wins of cluster against cluster where clusters are few beside items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warrantlake.functions.rng import draw
from warrantlake.operators import metrics as M
from warrantlake.operators import ranges as G
from warrantlake.operators import resample as R
from warrantlake.operators import thresholds as H
from warrantlake.sources.shared import written

MODELS = ("baseline", "variant")
Z_ALPHA, Z_BETA = 1.96, 0.8416
LEAST, BOUND = 200, 0.1


def relationship(old: DataFrame, new: DataFrame, keys: list[str], item: str, least: int = LEAST) -> DataFrame:
    """By key: items that both splits hold out for testing, what one trains on that the other tests, and whether it is enough."""
    x = old.select(*keys, item, F.col("split").alias("was")).join(new.select(*keys, item, F.col("split").alias("now")), [*keys, item], "full")
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    out = x.groupBy(*keys).agg(
        F.count_if(is_("was", "test") & is_("now", "test")).alias("n_paired"),
        F.count_if(is_("was", "train") & is_("now", "test")).alias("leaked_from_old_train"),
        F.count_if(is_("was", "test") & is_("now", "train")).alias("leaked_from_new_train"),
    )
    return out.withColumn("usable", F.col("n_paired") >= least)


def held_out_by_both(items: DataFrame, old: DataFrame, new: DataFrame, keys: list[str], item: str) -> DataFrame:
    tested = lambda s: s.where("split = 'test'").select(*keys, item)
    return items.join(tested(old), [*keys, item], "left_semi").join(tested(new), [*keys, item], "left_semi")


def stacked(items: DataFrame) -> DataFrame:
    """A row for each item and model, with the model's score as ``score``."""
    return items.withColumn("m", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in MODELS]))).withColumns({"model": F.col("m.model"), "score": F.col("m.score")}).drop("m", *MODELS)


def thresholds(items: DataFrame, keys: list[str], budgets: list[float]) -> DataFrame:
    """(keys, budget, baseline, variant): both models' thresholds within each budget."""
    found = H.within_budgets(stacked(items), [*keys, "model"], budgets)
    return found.groupBy(*keys, "budget").agg(*(F.max(F.when(F.col("model") == m, F.col("threshold"))).alias(m) for m in MODELS))


def _judged(items: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """Items with a list of judgements: a regime and budget, and whether each model flags the item."""
    known = cuts.groupBy(*keys).agg(F.collect_list(F.struct("budget", *(F.col(m).alias(f"t_{m}") for m in MODELS))).alias("cuts"))
    flags = lambda c, regime: F.struct(
        F.lit(regime).alias("regime"), c["budget"].alias("budget"), (F.col("baseline") >= c["t_baseline"]).alias("a"),
        (F.col("variant") >= (c["t_baseline"] if regime == "pinned" else c["t_variant"])).alias("b"),
    )
    both = F.concat(F.transform("cuts", lambda c: flags(c, "pinned")), F.transform("cuts", lambda c: flags(c, "own")))
    return items.join(known, keys).withColumn("judged", both).drop("cuts")


def _summary(reps: DataFrame, observed: DataFrame, by: list[str], level: float) -> DataFrame:
    tail = (1 - level) / 2
    spread = reps.groupBy(*by).agg(F.percentile("v", F.lit(tail)).alias("ci_low"), F.percentile("v", F.lit(1 - tail)).alias("ci_high"), F.stddev_samp("v").alias("standard_error"), F.count("v").alias("defined"))
    return observed.join(spread, by, "left")


def compare(items: DataFrame, keys: list[str], unit: str, cuts: DataFrame, n: int, seed: str, level: float = 0.95, bound: float = BOUND) -> DataFrame:
    """(keys, regime, quantity, baseline, variant, difference, ci_low, ci_high, standard_error, minimum_detectable, n_paired, verdict).

    ``items``: keys, ``unit``, label and both scores; ``cuts`` as of ``thresholds``. The rank statistic needs no
    threshold and is the same in both regimes.
    """
    judged = written(_judged(items, cuts, keys).select(*keys, unit, "label", *MODELS, "judged"), "judged")
    groups = judged.groupBy(*keys, unit).agg(F.count("*").alias("size")).withColumn("_h", draw(F.lit("g"), unit))
    of_key = groups.groupBy(*keys).agg(F.count("*").alias("groups"))
    numbered = written(G.numbered(groups, keys, F.col("_h"), ["_h", unit], "g").withColumn("g", F.col("g") - 1).join(of_key, keys).drop("_h"), "groups")
    paired = numbered.groupBy(*keys).agg(F.sum("size").alias("n_paired"))

    counts = judged.where("label = 1").select(*keys, unit, F.explode("judged").alias("j")).groupBy(*keys, unit, "j.regime", "j.budget").agg(F.count("*").alias("p"), F.count_if(F.col("j.a")).alias("a"), F.count_if(F.col("j.b")).alias("b"))
    by = [*keys, "regime", "quantity"]
    quantity = F.concat(F.lit("recall@"), F.col("budget").cast("string"))
    recall = lambda c: M.ratio(F.sum(c), F.sum("p"))
    observed = counts.groupBy(*keys, "regime", quantity.alias("quantity")).agg(recall("a").alias("baseline"), recall("b").alias("variant"))
    met = R.replicated(counts.join(numbered.select(*keys, unit, "g", "groups"), [*keys, unit]), keys, ["regime", "budget"], n, seed, ["p", "a", "b"])
    reps = met.select(*keys, "regime", quantity.alias("quantity"), "rep", (M.ratio(F.col("b"), F.col("p")) - M.ratio(F.col("a"), F.col("p"))).alias("v"))

    long = stacked(judged.drop("judged"))
    grain = long.groupBy(*keys, unit, "model", "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    grain = written(grain.join(numbered.select(*keys, unit, "g", "groups"), [*keys, unit]).select(*keys, "groups", "g", "model", "score", "pos", "neg"), "grain")
    sides = lambda x, c, *by: x.groupBy(*keys, *by).agg(*(F.max(F.when(F.col("model") == m, F.col(c))).alias(m) for m in MODELS))
    area = sides(M.auroc(long, [*keys, "model"]), "auroc")
    each = sides(R.replicate_areas(grain, keys, ["model"], n, seed), "v", "rep")
    regimes = lambda x: x.withColumn("regime", F.explode(F.array(F.lit("pinned"), F.lit("own")))).withColumn("quantity", F.lit("auroc"))

    observed = observed.unionByName(regimes(area))
    spread = _summary(reps.select(*by, "v"), observed.where("quantity <> 'auroc'"), by, level).unionByName(_summary(regimes(each.select(*keys, (F.col("variant") - F.col("baseline")).alias("v"))), regimes(area), by, level))
    mde = (Z_ALPHA + Z_BETA) * F.col("standard_error")
    verdict: Column = F.when((F.col("ci_low") > 0) | (F.col("ci_high") < 0), "difference").when(mde <= bound, "bounded").otherwise("UNDERPOWERED")
    told = spread.join(paired, keys).withColumns({"difference": F.col("variant") - F.col("baseline"), "minimum_detectable": mde, "verdict": verdict})
    return told.select(*by, "baseline", "variant", "difference", "ci_low", "ci_high", "standard_error", "minimum_detectable", "n_paired", "verdict")


def compare_models(items: DataFrame, old: DataFrame, new: DataFrame, keys: list[str], item: str, unit: str, budgets: list[float], n: int, seed: str, least: int = LEAST, level: float = 0.95) -> DataFrame:
    """``compare`` on what both splits hold out, for keys with enough of it; the others are one row each, REFUSED."""
    known = written(relationship(old, new, keys, item, least), "relationship")
    paired = held_out_by_both(items, old, new, keys, item).join(known.where("usable").select(*keys), keys, "left_semi")
    told = compare(paired, keys, unit, thresholds(items, keys, budgets), n, seed, level)
    refused = known.where("not usable").select(*keys, "n_paired", F.lit("REFUSED").alias("verdict"))
    return told.unionByName(refused, allowMissingColumns=True)

