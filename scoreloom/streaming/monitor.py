"""Stability monitoring of a stream: frozen edges, tumbling windows, bounded state, and counts kept by an idempotent sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.stability import psi_component
from ..operators.transforms import by_edges


def binned_counts(stream: DataFrame, time: str, value: str, edges: Sequence[float], window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(start, bin, n) by event-time window; rows later than ``delay`` are dropped once their window has closed. State: windows that are open, times bins."""
    n = len(edges) - 1
    rows = stream.withWatermark(time, delay).where(F.col(value).isNotNull())
    binned = rows.withColumn("bin", by_edges(F.col(value).cast("double"), F.array(*map(F.lit, map(float, edges))), n))
    out = binned.groupBy(F.window(time, window), "bin").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "bin", "n")


def window_psi(counts: DataFrame, expected: Sequence[float]) -> DataFrame:
    """(start, psi) of counts against the expected share of each bin; bins without rows count."""
    k = len(expected)
    wide = counts.groupBy("start").agg(*(F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("n"))), F.lit(0)).alias(f"b{b}") for b in range(k)), F.sum("n").alias("total"))
    parts = [psi_component(F.col(f"b{b}") / F.col("total"), F.lit(float(e))) for b, e in enumerate(expected)]
    return wide.select("start", sum(parts[1:], parts[0]).alias("psi"))


def keep_counts(stream: DataFrame, path: str, period: Column, value: str, edges: Sequence[float], checkpoint: str) -> DataStreamWriter:
    """A writer that keeps bin counts by period in ``path``, a micro-batch being a folder of its own (batch=<id>).

    A batch that is sent again after a failure replaces its own folder and nothing else, so replays change nothing and no row is counted twice. A row of counts is (period,
    bin, n), so what is kept grows with batches, periods and bins, not with rows. Missing values are the null bin. Start it with any trigger.
    """
    n = len(edges) - 1
    frozen = F.array(*map(F.lit, map(float, edges)))

    def write(rows: DataFrame, batch: int) -> None:
        x = F.col(value).cast("double")
        binned = rows.select(period.alias("period"), F.when(x.isNotNull(), by_edges(x, frozen, n)).alias("bin"))
        binned.groupBy("period", "bin").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def compact_counts(spark: SparkSession, path: str, out: str) -> None:
    """The kept counts of all batches summed to one table, (period, bin, n), for a long run's history."""
    kept_counts(spark, path).write.parquet(out)


def kept_counts(spark: SparkSession, path: str) -> DataFrame:
    """(period, bin, n) over all batches that were kept."""
    rows = spark.read.schema("period string, bin int, n bigint, batch bigint").parquet(path)
    return rows.groupBy("period", "bin").agg(F.sum("n").alias("n"))


def kept_shares(counts: DataFrame, is_actual: Column, bins: DataFrame | None = None) -> DataFrame:
    """(bin, expected, actual) from kept counts, as ``stability.shares`` gives it from rows; ``is_actual`` is a condition on the period."""
    flag = F.coalesce(is_actual, F.lit(False))
    sums = counts.groupBy("bin").agg(F.sum(F.when(~flag, F.col("n"))).alias("e"), F.sum(F.when(flag, F.col("n"))).alias("a"))
    if bins is not None:
        sums = bins.join(sums, "bin", "left").unionByName(sums.where("bin IS NULL"))
    total = sums.agg(F.sum("e").alias("ne"), F.sum("a").alias("na"))
    part = lambda c, n: F.coalesce(F.col(c), F.lit(0)) / F.nullif(F.col(n), F.lit(0))
    return sums.crossJoin(F.broadcast(total)).select("bin", part("e", "ne").alias("expected"), part("a", "na").alias("actual"))
