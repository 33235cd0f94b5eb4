"""Lift by quantile of descending score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .discrimination import scored
from .once import once
from .order import attach, running


def lift_table(df: DataFrame, y: str = "y", score: str = "score", key: str = "key", n: int = 10, of_non_events: bool = False) -> DataFrame:
    """decile (1 is highest score), count, events, event_rate, lift and the cumulative ones.

    Row i of m, from 0, is in the quantile of its place, ceil(i n / (m - 1)), 1 at least: quantiles of row
    numbers, not the even split of ntile. With fewer rows than quantiles some are missing. Rows without a score or target take no part.
    """
    flag = F.col(y).cast("long")
    rows = once(df.where(scored(y, score)).select(F.col(score).cast("double").alias("score"), F.col(key).alias("key"), (1 - flag if of_non_events else flag).alias("y")))
    ranked = attach(running(rows, "score", {"place": F.lit(1).cast("long")}, tie=["key"], descending=True, held=True), rows.agg(F.count("*").alias("m")))
    i, m = F.col("place") - 1, F.col("m")
    decile = F.when(m <= 1, 1).otherwise(F.greatest(F.floor((i * n + m - 2) / F.greatest(m - 1, F.lit(1))), F.lit(1))).cast("int")
    out = ranked.groupBy(decile.alias("decile")).agg(F.count("*").alias("count"), F.sum("y").alias("events"))
    upto = Window.partitionBy(F.lit(0)).orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(0))
    rate = F.sum("events").over(every) / F.sum("count").over(every)
    out = out.withColumns({"event_rate": F.col("events") / F.col("count"), "__rate": F.nullif(rate, F.lit(0.0)), "cumulative_events": F.sum("events").over(upto), "cumulative_count": F.sum("count").over(upto)})
    out = out.withColumn("cumulative_event_rate", F.col("cumulative_events") / F.col("cumulative_count"))
    return out.withColumn("lift", F.col("event_rate") / F.col("__rate")).withColumn("cumulative_lift", F.col("cumulative_event_rate") / F.col("__rate")).drop("__rate")


def lift_summary(table: DataFrame, upto: int = 3) -> DataFrame:
    """top_lift, top_cumulative_lift and captured_pct (share of events) of the first quantiles."""
    first = lambda c, d: F.max(F.when(F.col("decile") == d, F.col(c)))
    return table.agg(first("lift", 1).alias("top_lift"), first("cumulative_lift", upto).alias("top_cumulative_lift"), (first("cumulative_events", upto) / F.nullif(F.sum("events"), F.lit(0)) * 100).alias("captured_pct"))
