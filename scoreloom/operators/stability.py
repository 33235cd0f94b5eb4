"""Population stability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from .evidence import clamped, frozen_edges, unpivot
from .order import attach
from .transforms import by_edges


def psi_component(actual: Column, expected: Column) -> Column:
    """(a - e) ln(a / e) of shares of at least 1e-4, in the difference as well."""
    a, e = clamped(actual), clamped(expected)
    return (a - e) * F.log(a / e)


def shares(df: DataFrame, bin: str, is_actual: Column, by: Sequence[str] = (), bins: DataFrame | None = None) -> DataFrame:
    """(by, bin, expected, actual): each period's share of rows by bin, from one aggregation. Bins of either period are there, and those of ``bins`` (bin) if given.

    Rows with a missing value are a bin of their own, null, where there are such; so shares of a period always add up to 1. A row is of
    the expected period unless ``is_actual`` is true.
    """
    flag = F.coalesce(is_actual, F.lit(False)).cast("long")
    counts = df.groupBy(*by, F.col(bin).alias("bin")).agg(F.sum(1 - flag).alias("__e"), F.sum(flag).alias("__a"))
    totals = counts.groupBy(*by).agg(F.sum("__e").alias("__ne"), F.sum("__a").alias("__na"))
    if bins is not None:
        grid = attach(bins, totals) if not by else totals.crossJoin(F.broadcast(bins))
        missing = attach(counts.where("bin IS NULL"), totals, by)
        out = grid.join(counts, [*by, "bin"], "left")
        out = out.unionByName(missing.select(out.columns))
    else:
        out = attach(counts, totals, by)
    part = lambda c, n: F.coalesce(F.col(c), F.lit(0)) / F.nullif(F.col(n), F.lit(0))
    return out.select(*by, "bin", part("__e", "__ne").alias("expected"), part("__a", "__na").alias("actual"))


def psi_table(dist: DataFrame) -> DataFrame:
    """bin shares in per cent, their difference and the component, of a table of (bin, expected, actual)."""
    return dist.withColumns({"development_pct": F.col("expected") * 100, "production_pct": F.col("actual") * 100, "difference_pct": (F.col("actual") - F.col("expected")) * 100, "psi_component": psi_component(F.col("actual"), F.col("expected"))})


def psi(dist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """psi and its label."""
    out = dist.groupBy(*by).agg(F.sum(psi_component(F.col("actual"), F.col("expected"))).alias("psi"))
    return out.withColumn("psi_label", labels.label(F.col("psi"), labels.PSI))


def psi_between(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """psi of two tables of (bin, share); a bin of one only has share 0 in the other."""
    e, a = expected.select("bin", F.col("share").alias("expected")), actual.select("bin", F.col("share").alias("actual"))
    return psi(e.join(a, "bin", "full").select("bin", F.coalesce("expected", F.lit(0.0)).alias("expected"), F.coalesce("actual", F.lit(0.0)).alias("actual")))


def grid(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))


def psi_ranking(df: DataFrame, columns: Sequence[str], is_actual: Column, n: int = 10) -> DataFrame:
    """variable, psi and label of numeric columns, in bins frozen on the expected rows and one of missing values; greatest first."""
    df = df.withColumn("__actual", F.coalesce(is_actual, F.lit(False)))
    edges = frozen_edges(df.where(~F.col("__actual")), columns, n)
    long = unpivot(df, columns, ["__actual"]).join(F.broadcast(edges), "variable")
    binned = long.withColumn("bin", by_edges(F.col("value"), F.col("edges"), n))
    return psi(shares(binned, "bin", F.col("__actual"), ["variable"], grid(df, n)), ["variable"]).orderBy(F.desc("psi"), "variable")
