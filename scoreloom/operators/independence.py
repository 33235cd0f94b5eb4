"""Chi-square tests on counts in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi2_sf
from .evidence import unpivot
from .once import once
from .order import attach


#: Cells of a table with its zeros, which is for display.
MOST_CELLS = 4_000_000


def counted(df: DataFrame, row: str, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, row_key, col_key, observed) of the cells that have rows. A null is a key of its own."""
    return df.groupBy(*by, F.col(row).alias("row_key"), F.col(column).alias("col_key")).agg(F.count("*").alias("observed"))


def contingency(df: DataFrame, row: str, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, row_key, col_key, observed) with zero cells, of at most MOST_CELLS cells; a larger table is an error, as tests need ``counted`` alone.

    The grid is that of the distinct keys, whose numbers are looked at first.
    """
    counts = once(counted(df, row, column, by))
    rows, cols = counts.select(*by, "row_key").distinct(), counts.select(*by, "col_key").distinct()
    sizes = [x.groupBy(*by).agg(F.count("*").cast("double").alias(name)) for x, name in ((rows, "__r"), (cols, "__c"))]
    size = attach(sizes[0], sizes[1], by).agg(F.sum(F.col("__r") * F.col("__c"))).first()[0] or 0
    if size > MOST_CELLS:
        raise ValueError(f"{size:.0f} cells with zeros; tests of independence take the counted cells")
    cells = attach(rows, cols.groupBy(*by).agg(F.collect_list(F.struct("col_key")).alias("__cols")), by).select(*by, "row_key", F.explode("__cols").alias("__col")).select(*by, "row_key", "__col.col_key")
    cells = cells.select(*(F.col(k).alias(f"__{k}") for k in (*by, "row_key", "col_key")))
    on = F.lit(True)
    for k in (*by, "row_key", "col_key"):
        on = on & F.col(f"__{k}").eqNullSafe(F.col(k))
    return cells.join(counts, on, "left").select(*(F.col(f"__{k}").alias(k) for k in (*by, "row_key", "col_key")), F.coalesce("observed", F.lit(0)).alias("observed"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence | None = None) -> DataFrame:
    """Wide counts for display."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def expected_cells(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds expected, deviation (observed - expected) and represented ("over", "under", "even")."""
    total = lambda *keys: F.sum("observed").over(Window.partitionBy(*keys)).cast("double")
    grand = total(*(by or [F.lit(0)]))
    e = total(*by, "row_key") * total(*by, "col_key") / F.nullif(grand, F.lit(0.0))
    out = cells.withColumn("expected", e).withColumn("deviation", F.col("observed") - F.col("expected"))
    return out.withColumn("represented", F.when(F.col("deviation") > 0, "over").when(F.col("deviation") < 0, "under").otherwise("even"))


def independence(cells: DataFrame, by: Sequence[str] = (), alpha: float = 0.05, correction: bool = True) -> DataFrame:
    """chi2, df, p_value, is_significant. With one degree of freedom each deviation shrinks by up to a half (Yates).

    Only cells with rows are needed: the statistic is N (sum of o^2 / (r c) - 1), with the totals r and c of a cell's row and column, whatever
    the number of empty cells. In a table of two by two all deviations are alike, so that the correction follows from the statistic and
    the totals. Totals go to the cells by joins, broadcast while they are few.
    """
    held = once(cells.where("observed > 0").select(*by, "row_key", "col_key", F.col("observed").cast("double").alias("__o")))
    total = {k: held.groupBy(*by, k).agg(F.sum("__o").alias(f"__{k}")) for k in ("row_key", "col_key")}
    parts = attach(attach(held, total["row_key"], [*by, "row_key"]), total["col_key"], [*by, "col_key"])
    stat = parts.groupBy(*by).agg(F.sum("__o").alias("__n"), F.sum(F.col("__o") / F.col("__row_key") * (F.col("__o") / F.col("__col_key"))).alias("__s"))
    for k, t in total.items():
        stat = attach(stat, t.groupBy(*by).agg(F.count("*").alias(f"__{k}s"), F.sum(1 / F.col(f"__{k}")).alias(f"__{k}i")), by)
    plain = F.greatest(F.col("__n") * (F.col("__s") - 1), F.lit(0.0))
    inverse = F.col("__n") * F.col("__row_keyi") * F.col("__col_keyi")  # the sum of 1 / expected
    d = F.sqrt(plain / inverse)
    shrunk = d - F.least(d, F.lit(0.5))
    out = stat.withColumn("df", (F.col("__row_keys") - 1) * (F.col("__col_keys") - 1))
    chi2 = F.when((F.col("df") == 1) & F.lit(correction), shrunk * shrunk * inverse).otherwise(plain)
    return _judged(out.withColumn("chi2", chi2).select(*by, "df", "chi2"), alpha)


def goodness_of_fit(cells: DataFrame, observed: str = "observed", expected: str = "expected", by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """chi2, df (rows less 1), p_value, is_significant."""
    o, e = F.col(observed), F.col(expected)
    out = cells.groupBy(*by).agg(F.sum((o - e) * (o - e) / F.nullif(e.cast("double"), F.lit(0.0))).alias("chi2"), (F.count("*") - 1).alias("df"))
    return _judged(out, alpha)


def _judged(df: DataFrame, alpha: float) -> DataFrame:
    p: Column = chi2_sf(F.col("chi2"), F.col("df"))
    return df.withColumn("p_value", p).withColumn("is_significant", F.col("p_value") < alpha)


def chi2_ranking(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """variable, chi2, df, p_value, is_significant of categorical columns against the target, greatest first; one pass over the rows."""
    long = unpivot(df, columns, [target], "string")
    return independence(counted(long, "value", target, ["variable"]), ["variable"]).orderBy(F.desc("chi2"), "variable")
