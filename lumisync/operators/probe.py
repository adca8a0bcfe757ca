"""Linear probe: logistic regression on frozen features, and its accuracy."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Inverse regularisation strength and iteration limit.
INVERSE_STRENGTH = 0.316
MAX_ITERATIONS = 1000
TOLERANCE = 1e-8  # relative change of the loss; at Spark's 1e-6 a label near a tie may still be another one


def fit_probe(train: DataFrame, features: str = "features", label: str = "label",
              c: float = INVERSE_STRENGTH, max_iter: int = MAX_ITERATIONS) -> LogisticRegressionModel:
    """L2 logistic regression; `c` weighs the summed loss, so the penalty on the mean is 1/(c n)."""
    n = train.count()
    rows = train.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"),
                        F.col(label).cast("double").alias("label"))
    return LogisticRegression(
        regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=TOLERANCE,
    ).fit(rows)


def predict(model: LogisticRegressionModel, rows: DataFrame, features: str = "features") -> DataFrame:
    """Add the predicted label as an int column `prediction`."""
    vector = array_to_vector(F.col(features).cast("array<double>"))
    scored = model.setFeaturesCol("__features").transform(rows.withColumn("__features", vector))
    return scored.drop("__features", "rawPrediction", "probability").withColumn(
        "prediction", F.col("prediction").cast("int"))


def optimality(model: LogisticRegressionModel, train: DataFrame, features: str = "features", label: str = "label",
               c: float = INVERSE_STRENGTH) -> DataFrame:
    """(label, n, steepest): the largest entry of the gradient of the mean penalised loss in a class's weights.

    For class k that is mean((p_k - [label = k]) x) + w_k / (c n); the convex loss is least where it is zero.
    """
    vector = array_to_vector(F.col(features).cast("array<double>"))
    scored = model.setFeaturesCol("__features").transform(train.withColumn("__features", vector))
    rows = scored.select(F.col(label).alias("label"), F.col(features).alias("x"), vector_to_array("probability").alias("p"))
    n_classes, weights = model.numClasses, model.coefficientMatrix.toArray().tolist()
    if n_classes == 2 and len(weights) == 1:  # two classes have one row of weights, for the second
        raise ValueError("the probe of two classes has one weight vector; use three or more classes")
    misses = rows.select(F.posexplode("p").alias("class", "share"), "label", "x").select(
        "class", (F.col("share") - (F.col("label") == F.col("class")).cast("double")).alias("miss"), "x")
    slopes = misses.select("class", F.posexplode(F.transform("x", lambda v: v.cast("double") * F.col("miss"))).alias("at", "slope"))
    table = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in weights])
    n = rows.count()
    gradient = slopes.groupBy("class", "at").agg((F.sum("slope") / n).alias("g")).withColumn(
        "g", F.abs(F.col("g") + F.get(F.get(table, F.col("class")), F.col("at")) / (c * n)))
    worst = gradient.groupBy("class").agg(F.max("g").alias("steepest"))
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(worst, sizes["label"] == worst["class"]).select("label", "n", "steepest")


def accuracy(prediction: Column, label: Column) -> Column:
    """Share of equal values, in percent."""
    return F.avg((prediction == label).cast("double")) * 100
