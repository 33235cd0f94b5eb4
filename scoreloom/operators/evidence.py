"""Weight of evidence and information value. Good is target 0, bad is target 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from .order import attach
from .transforms import BUFFERED, by_edges, quantiles

FLOOR = 1e-4


def _all(by: Sequence[str]):
    # over a row a bin, not over data rows
    return Window.partitionBy(*(by or [F.lit(0)]))


def bin_statistics(df: DataFrame, bin: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """bin, total, goods, bads, pct_goods, pct_bads and conversion_rate (goods / total) of each bin that has rows. A class without rows has null shares."""
    y = F.col(target)
    out = df.groupBy(*by, F.col(bin).alias("bin")).agg(F.count("*").alias("total"), F.sum((y == 0).cast("long")).alias("goods"), F.sum((y == 1).cast("long")).alias("bads"))
    share = lambda c: F.col(c) / F.nullif(F.sum(c).over(_all(by)), F.lit(0))
    return out.withColumns({"pct_goods": share("goods"), "pct_bads": share("bads"), "conversion_rate": F.col("goods") / F.col("total")})


def clamped(p: Column) -> Column:
    """At least FLOOR; null, of a class without rows, stays null."""
    return F.when(p.isNotNull(), F.greatest(p, F.lit(FLOOR)))


def woe(pct_goods: Column, pct_bads: Column) -> Column:
    return F.log(clamped(pct_goods) / clamped(pct_bads))


def with_woe(stats: DataFrame, zero_policy: str = "clamp") -> DataFrame:
    """Adds woe and iv_component.

    "clamp": shares of less than FLOOR count as FLOOR in the logarithm only. "replace": shares of exactly 0
    are FLOOR in the difference too.
    """
    g, b = F.col("pct_goods"), F.col("pct_bads")
    if zero_policy == "clamp":
        w = woe(g, b)
    elif zero_policy == "replace":
        g, b = (F.when(p == 0, FLOOR).otherwise(p) for p in (g, b))
        w = F.log(g / b)
    else:
        raise ValueError(zero_policy)
    return stats.withColumn("woe", w).withColumn("iv_component", (g - b) * w)


def information_value(stats: DataFrame, by: Sequence[str] = (), zero_policy: str = "clamp") -> DataFrame:
    """iv and its label; the components' absolute values add up under "clamp", as they are under "replace"."""
    rows = with_woe(stats, zero_policy)
    c = F.col("iv_component")
    out = rows.groupBy(*by).agg(F.sum(F.abs(c) if zero_policy == "clamp" else c).alias("iv"))
    return out.withColumn("iv_label", labels.label(F.col("iv"), labels.IV))


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str], kind: str = "double") -> DataFrame:
    """(variable, value, keep...) rows, so that all variables go through one aggregation."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast(kind).alias("value")) for c in columns)))
    return df.select(*keep, pairs.alias("__p")).select(*keep, "__p.variable", "__p.value")


def frozen_edges(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """(variable, edges): the n-quantiles of each column, from one pass; of a table above BUFFERED rows from ranks of distinct values."""
    if df.count() > BUFFERED:
        return quantiles(unpivot(df, columns, []), "value", [k / n for k in range(n + 1)], ["variable"], "rank", few_groups=True)
    shares = F.array(*(F.lit(k / n) for k in range(n + 1)))
    one = df.agg(*(F.percentile(F.col(c).cast("double"), shares).alias(c) for c in columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).alias("edges")) for c in columns)))
    return one.select(pairs.alias("__p")).select("__p.*")


def binned_columns(df: DataFrame, columns: Sequence[str], target: str, n: int) -> DataFrame:
    """(__y, variable, bin): equal-frequency bins of each column. Columns are binned side by side, so that rows unpivot as small numbers.

    The edges, n - 1 numbers a column, are constants of the plan.
    """
    edges = {r.variable: r.edges for r in frozen_edges(df, columns, n).collect()}

    def bin_of(c: str) -> Column:
        x, found = F.col(c).cast("double"), edges.get(c)
        if not found or found[0] is None:  # a column without values
            return F.lit(None).cast("int")
        out = F.lit(0)
        for k in range(1, n):
            out = out + (x >= F.lit(found[k])).cast("int")
        return F.when(x.isNotNull(), out)

    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), bin_of(c).alias("bin")) for c in columns)))
    return df.select(F.col(target).alias("__y"), pairs.alias("__p")).select("__y", "__p.*")


def iv_ranking(df: DataFrame, columns: Sequence[str], target: str, n: int = 10) -> DataFrame:
    """variable, iv and iv_label of numeric columns in n equal-frequency bins, greatest first."""
    stats = bin_statistics(binned_columns(df, columns, target, n), "bin", "__y", ["variable"])
    return information_value(stats, ["variable"]).orderBy(F.desc("iv"), "variable")


def rate_table(df: DataFrame, category: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """total, converted, not_converted and rate of each category that has rows."""
    y = F.col(target).cast("long")
    out = df.groupBy(*by, category).agg(F.count("*").alias("total"), F.sum(y).alias("converted"), F.avg(y).alias("rate"))
    return out.withColumn("not_converted", F.col("total") - F.col("converted"))


__all__ = ["attach", "bin_statistics", "frozen_edges", "information_value", "iv_ranking", "rate_table", "unpivot", "with_woe", "woe"]
