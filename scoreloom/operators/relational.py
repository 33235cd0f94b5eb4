"""General table operators of the workflow, where Spark's own need some care."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import attach
from .transforms import BUFFERED, quantiles


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, variable, count, mean, std, min, p25, p50, p75, max): sample deviation, exact quartiles."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns)))
    long = df.select(*by, each.alias("__p")).select(*by, "__p.variable", "__p.value").where("value IS NOT NULL")
    numbers = [F.count("*").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")]
    shares = [0.25, 0.5, 0.75]
    if df.count() <= BUFFERED:
        out = long.groupBy(*by, "variable").agg(*numbers, F.percentile("value", F.array(*map(F.lit, shares))).alias("__q"))
    else:
        quartiles = quantiles(long, "value", shares, [*by, "variable"], "rank").withColumnRenamed("edges", "__q")
        out = attach(long.groupBy(*by, "variable").agg(*numbers), quartiles, [*by, "variable"])
    return out.select(*by, "variable", "count", "mean", "std", "min", F.col("__q")[0].alias("p25"), F.col("__q")[1].alias("p50"), F.col("__q")[2].alias("p75"), "max")


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(variable, nulls)."""
    columns = list(columns or df.columns)
    one = df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(columns)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(f"c{i}").alias("nulls")) for i, c in enumerate(columns)))).alias("x")).select("x.*")


def value_counts(df: DataFrame, column: str, by_value: bool = False) -> DataFrame:
    """(column, count), most frequent first, or by value."""
    out = df.groupBy(column).agg(F.count("*").alias("count"))
    return out.orderBy(column) if by_value else out.orderBy(F.desc("count"), column)


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | Column) -> DataFrame:
    """The first k rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def validate_counts(df: DataFrame, targets: DataFrame, key: str, flag: str) -> DataFrame:
    """Compares rows and flagged rows by key with ``targets`` (key, rows, flagged): differences of 0 are right."""
    own = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col(flag).cast("long")).alias("k"))
    return targets.join(own, key).select(key, "rows", "n", "flagged", "k", (F.col("n") - F.col("rows")).alias("rows_off"), (F.col("k") - F.col("flagged")).alias("flagged_off"))


def head(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """The first k rows in an order; without one the first k are not defined. Each task keeps k rows."""
    return df.orderBy(*order).limit(k)


def formatted(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Columns as text by printf formats, for reports; null stays null."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string(f, F.col(c))) for c, f in formats.items()})
