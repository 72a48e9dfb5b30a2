"""A linear probe over vectors: standardised, balanced logistic regression, with its controls, in ``pyspark.ml``."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warrantlake.functions.rng import draw
from warrantlake.operators.metrics import auroc


def fit(train: DataFrame, c: float, max_iter: int = 100):
    """Minimises C times the weighted log loss plus half the squared weights; classes weigh alike."""
    n = train.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("p")).first()
    weight = F.when(F.col("label") == 1, n["n"] / (2 * max(1, n["p"]))).otherwise(n["n"] / (2 * max(1, n["n"] - n["p"])))
    rows = train.select(array_to_vector("vec").alias("raw"), F.col("label").cast("double").alias("label"), weight.alias("weight"))
    steps = [StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True), LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=1 / (c * n["n"]), standardization=False, maxIter=max_iter, tol=1e-10)]
    return Pipeline(stages=steps).fit(rows)


def score(model, items: DataFrame) -> DataFrame:
    out = model.transform(items.withColumn("raw", array_to_vector("vec")))
    return out.withColumn("score", vector_to_array("probability")[1]).drop("raw", "features", "rawPrediction", "probability", "prediction")


def select_c(train: DataFrame, validation: DataFrame, grid: list[float]) -> tuple[float, object]:
    """The C of the largest validation AUROC; of equal ones the smallest."""
    best = None
    for c in sorted(grid):
        model = fit(train, c)
        area = auroc(score(model, validation).withColumn("all", F.lit(0)), ["all"]).first()["auroc"]
        if best is None or area is not None and area > best[0]:
            best = (area, c, model)
    return best[1], best[2]


def shuffled(train: DataFrame, key: str, seed: str) -> DataFrame:
    """Labels permuted among the rows, by two hash orders."""
    from pyspark.sql import Window

    one = Window.partitionBy(F.lit(0))
    a = train.withColumn("r", F.row_number().over(one.orderBy(draw(F.lit(seed + "a"), key), key)))
    b = train.select(F.col("label").alias("moved"), F.row_number().over(one.orderBy(draw(F.lit(seed + "b"), key), key)).alias("r"))
    return a.join(b, "r").drop("r", "label").withColumnRenamed("moved", "label")
