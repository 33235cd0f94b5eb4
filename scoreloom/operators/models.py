"""Scorecard models on pyspark.ml, fitted on the training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import MinMaxScaler, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_digits, uniform
from .order import attach

#: A class is cut to 65,536 slices of its hashes.
SLICE_BITS = 16
SLICES = 1 << SLICE_BITS


def stratified_split(df: DataFrame, target: str, key: str, test_share: float = 0.3, seed: int = 42) -> DataFrame:
    """Adds is_test: an exact share of each class, rounded down, of the least hashed keys.

    Counts by the first digits of the hash tell which slice of each class the limit falls in; only rows of
    that slice, one in SLICES, are ordered. The last row that is taken, one a class, is then compared with every row where it is. ``key`` is unique.
    """
    rows = df.withColumn("__h", hash_digits(15, F.col(key), F.lit(seed))).withColumn("__slice", F.shiftright("__h", 60 - SLICE_BITS))
    counts = rows.groupBy(target, "__slice").agg(F.count("*").alias("__c"))
    slices = Window.partitionBy(target)
    upto = F.sum("__c").over(slices.orderBy("__slice"))
    limits = counts.select(target, "__slice", upto.alias("__upto"), F.col("__c"), F.floor(F.sum("__c").over(slices) * F.lit(test_share)).alias("__k"))
    limits = limits.where((F.col("__upto") >= F.col("__k")) & (F.col("__upto") - F.col("__c") < F.col("__k")) | (F.col("__k") == 0) & (F.col("__upto") == F.col("__c")))
    limits = limits.select(target, F.col("__slice").alias("__at"), (F.col("__k") - F.col("__upto") + F.col("__c")).alias("__left"))
    rows = attach(rows, limits, [target])
    # The last row of each class that is taken: a row a class, found among the rows of one slice.
    edge = rows.where(F.col("__slice") == F.col("__at"))
    placed = edge.select(target, "__left", F.struct(F.col("__h"), F.col(key).alias("__key")).alias("__own"), F.row_number().over(Window.partitionBy(target).orderBy("__h", key)).alias("__place"))
    last = placed.groupBy(target).agg(F.max(F.when(F.col("__place") <= F.col("__left"), F.col("__own"))).alias("__last"))
    taken = F.coalesce(F.struct(F.col("__h"), F.col(key).alias("__key")) <= F.col("__last"), F.lit(False))
    rows = attach(rows, last, [target])
    return rows.withColumn("is_test", (F.col("__slice") < F.col("__at")) | (F.col("__slice") == F.col("__at")) & taken).drop("__h", "__slice", "__at", "__left", "__last")


def hashed_split(df: DataFrame, key: str, test_share: float = 0.3, seed: int = 42) -> DataFrame:
    """Adds is_test by hash of the key alone, without a shuffle."""
    return df.withColumn("is_test", uniform(F.col(key), F.lit(seed)) < test_share)


def class_weights(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    """n / (2 n_class), so that both classes weigh alike and the weights add up to n."""
    counts = df.agg(F.count("*").alias("__n"), F.sum(F.col(target).cast("long")).alias("__p"))
    own = F.when(F.col(target) == 1, F.col("__p")).otherwise(F.col("__n") - F.col("__p"))
    return attach(df, counts).withColumn(out, F.col("__n") / F.nullif(2 * own, F.lit(0)).cast("double")).drop("__n", "__p")


def fit_logistic(train: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (), balanced: bool = True, c: float = 1.0, max_iter: int = 1000, scaling: str = "minmax") -> PipelineModel:
    """L2 logistic regression of strength 1 / (c n), on scaled numbers and alphabetical codes. scaling: "minmax", "zscore" or "none". Rows with a null number or target take no part in fitting."""
    train = train.dropna(subset=[*numeric, target])
    n = train.count()
    stages = [StringIndexer(inputCols=list(categorical), outputCols=[f"__i_{x}" for x in categorical], stringOrderType="alphabetAsc", handleInvalid="keep")] if categorical else []
    stages.append(VectorAssembler(inputCols=list(numeric), outputCol="__numbers", handleInvalid="keep"))
    if scaling != "none":
        kind = MinMaxScaler if scaling == "minmax" else StandardScaler
        stages.append(kind(inputCol="__numbers", outputCol="__scaled", **({"withMean": True} if scaling == "zscore" else {})))
    stages.append(VectorAssembler(inputCols=["__scaled" if scaling != "none" else "__numbers", *(f"__i_{x}" for x in categorical)], outputCol="__features", handleInvalid="keep"))
    weights = {"weightCol": "weight"} if balanced else {}
    stages.append(LogisticRegression(featuresCol="__features", labelCol=target, probabilityCol="__probability", predictionCol="__prediction", rawPredictionCol="__raw", regParam=1 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=max_iter, **weights))
    rows = class_weights(train, target) if balanced else train
    return Pipeline(stages=stages).fit(rows.withColumn(target, F.col(target).cast("double")))


def predict(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """``df`` with the probability of class 1; rows with a null number have none."""
    scored = model.transform(df)
    p = vector_to_array("__probability")[1]
    return scored.withColumn(out, F.when(~F.isnan(p), p)).select(*df.columns, out)


def coefficients(model: PipelineModel, df: DataFrame) -> DataFrame:
    """feature, coefficient, greatest first."""
    last = model.stages[-1]
    names = model.stages[-2].getInputCols()
    numeric = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    names = [*numeric, *(x.removeprefix("__i_") for x in names[1:])]
    rows = [(a, float(b)) for a, b in zip(names, last.coefficients)] + [("(intercept)", float(last.intercept))]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double").orderBy(F.desc("coefficient"), "feature")


def intercept_only(df: DataFrame, target: str, balanced: bool = False, out: str = "score") -> DataFrame:
    """The constant model: the event rate, or 1/2 when classes weigh alike."""
    if balanced:
        return df.withColumn(out, F.lit(0.5))
    return attach(df, df.agg(F.avg(F.col(target).cast("double")).alias(out)))


def apply_scorecard(df: DataFrame, intercept: float, weights: dict[str, float], out: str = "score") -> DataFrame:
    """The probability of class 1 by known coefficients of numeric columns, without a fitted model; null where a column is."""
    z = F.lit(float(intercept))
    for column, w in weights.items():
        z = z + F.col(column).cast("double") * F.lit(float(w))
    return df.withColumn(out, 1 / (1 + F.exp(-z)))
