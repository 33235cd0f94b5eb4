"""Ranks and running totals over a whole table, without bringing it into one partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .once import if_small, once

#: Rows of a range, ranges of a table at most (beyond, they hold more rows), and sampled rows a range.
ROWS_PER_RANGE, MOST_RANGES, SAMPLED = 2_000_000, 1 << 15, 32


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str] = (), small: bool | None = None) -> DataFrame:
    """``df`` with the columns of ``stats``, which has a row for each group, or one row without ``by``.

    Few groups are broadcast, so that a table isn't dealt out by a key of some values: those of ``small`` statistics (MOST_RANGES rows at
    most), or, where that isn't said, such as have been counted. Many groups are joined by a shuffle.
    """
    if not by:
        return df.crossJoin(F.broadcast(stats))
    renamed = stats.select(*(F.col(k).alias(f"__k_{k}") for k in by), *(c for c in stats.columns if c not in by))
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in by]
    on = same[0]
    for c in same[1:]:
        on = on & c
    renamed = F.broadcast(renamed) if small else if_small(renamed) if small is None else renamed
    return df.join(renamed, on).drop(*(f"__k_{k}" for k in by))


def running(df: DataFrame, order: str, sums: dict[str, Column], by: Sequence[str] = (), tie: Sequence[str] = (), descending: bool = False, rows_per_range: int = ROWS_PER_RANGE, held: bool = False) -> DataFrame:
    """Adds, for each name in ``sums``, the running total of its expression up to and including the row, in each group of ``by``.

    Rows are ordered by ``order`` (a number) and then ``tie``, which should be a key. They are evaluated once,
    to a checkpoint (``held``: ``df`` is one already), and counted there; a table of up to ``rows_per_range`` rows is one window. A larger one is cut into ranges of about
    that many rows of the order (by, order, tie), wherever groups or equal values begin, so that neither a
    large group nor a value that very many rows share is one task. Cuts are places of a sample by hash;
    totals of ranges give each range its offset, and windows run within ranges. Rows that are equal in all
    of these columns are in one range, so the result does not depend on where the cuts are.
    """
    key = F.col(order).desc() if descending else F.col(order).asc()
    keys = [key, *(F.col(t).asc() for t in tie)]
    upto = (Window.unboundedPreceding, Window.currentRow)
    df = df if held else once(df)
    n = df.count()
    if n <= rows_per_range:
        w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*keys).rowsBetween(*upto)
        return df.withColumns({name: F.sum(x).over(w) for name, x in sums.items()})
    # as the window orders: ascending nulls first, descending nulls and then the least last
    first = [F.col(order).isNull(), ~F.isnan(F.col(order).cast("double")), -F.col(order)] if descending else [F.col(order)]
    whole = F.struct(*(F.col(k) for k in by), *first, *(F.col(t) for t in tie))
    ranges = min(MOST_RANGES, -(-n // rows_per_range))
    every = max(1, n // (ranges * SAMPLED))
    sample = df.select(whole.alias("__w")).where(F.pmod(F.xxhash64("__w"), F.lit(every)) == 0)
    # some SAMPLED rows a range
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__w"))
    cuts = sample.select("__w", place.alias("__at")).where(F.col("__at") % SAMPLED == 0).agg(F.sort_array(F.collect_set("__w")).alias("__cuts"))
    steps = F.array(*(F.lit(1 << k) for k in range(MOST_RANGES.bit_length(), -1, -1)))
    search = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("__cuts", at + step - 1) < F.col("__w"), at + step).otherwise(at))
    cutted = df.withColumn("__w", whole).crossJoin(F.broadcast(cuts)).withColumn("__range", search).drop("__cuts", "__w")
    totals = cutted.groupBy(*by, "__range").agg(*(F.sum(x).alias(f"__t_{name}") for name, x in sums.items()))
    # a row for each range of a group
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, F.col("__range"), *(F.coalesce(F.sum(f"__t_{name}").over(before), F.lit(0)).alias(f"__o_{name}") for name in sums))
    w = Window.partitionBy(*by, "__range").orderBy(*keys).rowsBetween(*upto)
    out = cutted.withColumns({name: F.sum(x).over(w) for name, x in sums.items()})
    out = attach(out, offsets, [*by, "__range"], small=not by)
    return out.withColumns({name: F.col(name) + F.col(f"__o_{name}") for name in sums}).drop("__range", *(f"__o_{name}" for name in sums))
