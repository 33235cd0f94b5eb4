"""Binning under constraints, best splits and mergeable quantiles: of many variables at once, each in its own task or aggregate."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evidence import unpivot
from .once import once
from .order import attach, running
from .transforms import chi_merge

FLOOR = 1e-4
#: Fine bins of a variable, and those of one whose weights of evidence have to be monotone; beyond, it is an error.
MOST_FINE, MOST_MONOTONE = 30_000, 2_000


def _runs(goods: np.ndarray, bads: np.ndarray, least: float):
    """(goods and bads up to each bin, and of bins up to j the number of starts i such that i..j has the least share of rows)."""
    g, b = np.concatenate([[0.0], np.cumsum(goods)]), np.concatenate([[0.0], np.cumsum(bads)])
    rows = g + b
    starts = np.searchsorted(rows, rows - least * rows[-1] + 1e-9 * rows[-1], "right") if least > 0 else np.arange(len(rows))
    return g / max(g[-1], 1), b / max(b[-1], 1), np.minimum(starts, np.arange(len(rows)))


def _free(goods: np.ndarray, bads: np.ndarray, n: int, least: float) -> list[int]:
    """Starts of the runs of greatest information value, by dynamic programming over prefix sums: each end takes one array operation a number of runs."""
    g, b, starts = _runs(goods, bads, least)
    m = len(goods)
    best = np.full((n + 1, m + 1), -np.inf)
    back = np.zeros((n + 1, m + 1), np.int64)
    best[0, 0] = 0.0
    for j in range(1, m + 1):
        k = starts[j]
        if not k:
            continue
        x, y = g[j] - g[:k], b[j] - b[:k]
        v = (x - y) * np.log(np.maximum(x, FLOOR) / np.maximum(y, FLOOR))
        sums = best[:n, :k] + v
        back[1:, j] = sums.argmax(1)
        best[1:, j] = sums.max(1)
    p = int(best[1:, m].argmax()) + 1
    if best[p, m] == -np.inf:
        return [0]
    out, j = [], m
    for q in range(p, 0, -1):
        j = int(back[q, j])
        out.append(j)
    return out[::-1]


def _monotone(goods: np.ndarray, bads: np.ndarray, n: int, least: float, rising: bool) -> tuple[float, list[int]]:
    """The same with weights of evidence that never fall (or rise) from run to run.

    A state is the end of a run, the number of runs and the last weight; of states that end alike only those that no other beats, with a better value at
    a weight that binds less, are kept, as a sorted frontier that all later runs search at once.
    """
    g, b, starts = _runs(goods, bads, least)
    m = len(goods)
    value, weight = np.full((m, m + 1), -np.inf), np.zeros((m, m + 1))
    for j in range(1, m + 1):
        k = starts[j]
        x, y = g[j] - g[:k], b[j] - b[:k]
        weight[:k, j] = np.log(np.maximum(x, FLOOR) / np.maximum(y, FLOOR))
        value[:k, j] = (x - y) * weight[:k, j]
    if not rising:
        weight = -weight
    # total[i, j]: the best value of runs of which the last is i..j; prior: the start of the run before it
    total = np.full((m, m + 1), -np.inf)
    total[0] = value[0]
    layers, ends = [], [(total[0, m], 0)]
    for _ in range(2, n + 1):
        new, prior = np.full((m, m + 1), -np.inf), np.zeros((m, m + 1), np.int32)
        for i in range(1, m):
            own = np.flatnonzero(total[:i, i] > -np.inf)
            if not len(own):
                continue
            own = own[np.lexsort((own, weight[own, i]))]
            tops = np.maximum.accumulate(total[own, i])
            better = np.concatenate([[True], total[own, i][1:] > tops[:-1]])
            front = own[better]
            place = np.searchsorted(weight[front, i], weight[i, i + 1 :] + 1e-12, "right") - 1
            fits = np.flatnonzero((place >= 0) & (value[i, i + 1 :] > -np.inf))
            at = fits + i + 1
            new[i, at] = total[front, i][place[fits]] + value[i, at]
            prior[i, at] = front[place[fits]]
        layers.append(prior)
        total = new
        last = int(total[:, m].argmax())
        ends.append((total[last, m], last))
    p = max(range(len(ends)), key=lambda k: ends[k][0])
    if ends[p][0] == -np.inf:
        return -np.inf, [0]
    out, j = [ends[p][1]], m
    for layer in layers[:p][::-1]:
        i = out[-1]
        out.append(int(layer[i, j]))
        j = i
    return float(ends[p][0]), out[::-1]


def optimal_binning(stats: DataFrame, n: int = 5, by: Sequence[str] = (), least_share: float = 0.0, monotone: str | None = None) -> DataFrame:
    """(by, bin, merged_bin): fine bins (by, bin, goods, bads) cut into at most ``n`` runs of the greatest information value; merged_bin is a run's lowest bin.

    ``least_share`` is the least share of rows of a run. ``monotone``: weights of evidence "rising", "falling", or "either", whichever gives more.
    The optimum is exact. Each variable (``by``) is a task of its own over at most MOST_FINE bins, MOST_MONOTONE if they have to be monotone; more
    are an error. Where no cut meets the constraints, all bins are one run. Bins that are null are left out.
    """
    if monotone not in (None, "rising", "falling", "either"):
        raise ValueError(monotone)
    kinds = dict(stats.dtypes)

    def cut_up(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin", ignore_index=True)
        most = MOST_FINE if monotone is None else MOST_MONOTONE
        if len(rows) > most:
            raise ValueError(f"{len(rows)} fine bins; at most {most}")
        goods, bads = rows["goods"].to_numpy(np.float64), rows["bads"].to_numpy(np.float64)
        if monotone is None:
            starts = _free(goods, bads, n, least_share)
        else:
            ways = [w for w in ("rising", "falling") if monotone in (w, "either")]
            starts = max((_monotone(goods, bads, n, least_share, w == "rising") for w in ways), key=lambda o: o[0])[1]
        run = np.array(starts)[np.searchsorted(starts, np.arange(len(rows)), "right") - 1]
        return rows[[*by, "bin"]].assign(merged_bin=rows["bin"].to_numpy()[run])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", " * bool(by) + f"bin {kinds['bin']}, merged_bin {kinds['bin']}"
    fine = stats.where("bin IS NOT NULL").select(*by, "bin", "goods", "bads")
    return fine.groupBy(*(by or [F.lit("all")])).applyInPandas(cut_up, schema)


def distinct_counts(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(variable, bin, goods, bads): the finest bins there are, the distinct values of each column."""
    y = F.col(target)
    rows = unpivot(df, columns, [target]).where(F.col("value").isNotNull() & y.isNotNull())
    return rows.groupBy("variable", F.col("value").alias("bin")).agg(F.sum((y == 0).cast("long")).alias("goods"), F.sum((y == 1).cast("long")).alias("bads"))


def best_splits(df: DataFrame, columns: Sequence[str], classes: str, most_classes: int = 100) -> DataFrame:
    """variable, threshold, n_left, n_right, impurity, reduction, place: the best binary split (value <= threshold) of each numeric column, greatest reduction of Gini impurity first.

    All columns are counted by distinct value at once; class counts run over the ordered values, by ranges where there are very many. Rows with a null value or
    class take no part in that column. Equal reductions (to twelve places) go to the lower threshold, then to the column's name. A column of one value has no split.
    """
    found = [r[0] for r in df.where(F.col(classes).isNotNull()).select(F.col(classes)).distinct().orderBy(classes).limit(most_classes + 1).collect()]
    if len(found) > most_classes:
        raise ValueError(f"more than {most_classes} classes")
    rows = unpivot(df, columns, [classes]).where(F.col("value").isNotNull() & ~F.isnan("value") & F.col(classes).isNotNull())
    names = [f"__c{k}" for k in range(len(found))]
    counts = once(rows.groupBy("variable", "value").agg(*(F.sum((F.col(classes) == F.lit(c)).cast("long")).alias(name) for c, name in zip(found, names)), F.count("*").alias("__n")))
    left = running(counts, "value", {f"{x}_l": F.col(x) for x in (*names, "__n")}, ["variable"], held=True)
    whole = attach(left, counts.groupBy("variable").agg(*(F.sum(x).alias(f"{x}_t") for x in (*names, "__n"))), ["variable"])
    d = lambda x: F.col(x).cast("double")
    squares = lambda of: sum((of(x) * of(x) for x in names), F.lit(0.0))
    nl, nt = d("__n_l"), d("__n_t")
    nr = nt - nl
    parent = 1 - squares(lambda x: d(f"{x}_t")) / (nt * nt)
    # the weighted mean of 1 - sum of squares / n^2 is 1 - (sum of squares / n of either side) / n
    children = 1 - (squares(lambda x: d(f"{x}_l")) / nl + squares(lambda x: d(f"{x}_t") - d(f"{x}_l")) / F.nullif(nr, F.lit(0.0))) / nt
    cuts = whole.where("__n_l < __n_t").select("variable", "value", F.col("__n_l").alias("n_left"), (F.col("__n_t") - F.col("__n_l")).alias("n_right"), parent.alias("impurity"), F.round(parent - children, 12).alias("reduction"))
    best = cuts.groupBy("variable").agg(F.max_by(F.struct("value", "n_left", "n_right", "impurity", "reduction"), F.struct("reduction", -F.col("value"))).alias("b"))
    rows = best.select("variable", F.col("b.value").alias("threshold"), "b.n_left", "b.n_right", "b.impurity", "b.reduction")
    # a row a column
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("reduction"), "variable")))


def rank_error(k: int) -> float:
    """How far the rank of a sketch's quantile may be from the wanted one, as a share of the rows, at 99 % confidence; an empirical fit published for KLL sketches."""
    return 2.296 / k**0.9021


def sketch_quantiles(df: DataFrame, value: str, by: Sequence[str] = (), k: int = 400) -> DataFrame:
    """(by, n, sketch): a mergeable sketch of the values that are numbers, of about 8 k bytes whatever the rows are."""
    x = F.col(value).cast("double")
    x = F.when(~F.isnan(x), x)
    return df.where(x.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(x, k).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of parts (days, sources) as one a group: the same as one of all their rows, within the rank error."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_edges(sketches: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, edges): n + 1 quantiles, each within ``rank_error(k)`` of its rank; to be used as other frozen edges are."""
    shares = F.array(*(F.lit(i / n) for i in range(n + 1)))
    return sketches.select(*by, F.kll_sketch_get_quantile_double("sketch", shares).alias("edges"))


def _chi2(g1: Column, b1: Column, g2: Column, b2: Column) -> Column:
    """The statistic of two neighbours' two-by-two table; 0 where a class is missing from both."""
    det = g1 * b2 - b1 * g2
    n = g1 + b1 + g2 + b2
    return F.coalesce(n * det * det / F.nullif((g1 + b1) * (g2 + b2) * (g1 + g2) * (b1 + b2), F.lit(0.0)), F.lit(0.0))


def chi_merge_rounds(stats: DataFrame, most_bins: int = 5, p_value: float = 0.05, last: int = 1000, block: int = 100_000) -> DataFrame:
    """(bin, merged_bin) for any number of fine bins (bin, goods, bads), such as the distinct values of a column.

    While more than ``last`` bins are left, a round merges every pair of neighbours that differs less than both pairs beside it, all at once; equal
    differences are ordered by a hash of the place, so about a third of the bins goes in a round wherever they tie. Bins have consecutive
    places, so a block of places, with two more on either side, is all that a task needs. The remaining bins are merged one pair
    at a time (``transforms.chi_merge``), and so is a table that has no more from the start: then the result is that of the plain loop. Otherwise a
    pair is merged when it is least nearby rather than least of all, which is a choice of order; tests hold the rounds against plain Python.
    A null bin is left out.
    """
    spark = stats.sparkSession
    fine = once(stats.where("bin IS NOT NULL").select(F.col("bin").alias("lo"), F.col("goods").cast("double").alias("g"), F.col("bads").cast("double").alias("b")))
    state = once(running(fine, "lo", {"p": F.lit(1).cast("long")}, held=True).withColumn("p", F.col("p") - 1))
    n = state.count()
    while n > last:
        own = F.expr(f"p div {block}")
        places = F.array_distinct(F.array(own, F.expr(f"(p - 2) div {block}"), F.expr(f"(p + 2) div {block}")))
        rows = state.select("*", F.explode(places).alias("blk")).where((F.col("blk") >= 0) & (F.col("blk") <= (n - 1) // block))
        w = Window.partitionBy("blk").orderBy("p")
        before = lambda c: F.lag(c).over(w)
        key = F.when(before("p").isNotNull(), F.struct(_chi2(before("g"), before("b"), F.col("g"), F.col("b")).alias("v"), F.xxhash64("p").alias("h")))
        rows = rows.withColumn("key", key)
        less = lambda other: other.isNull() | (F.col("key") < other)
        merge = F.col("key").isNotNull() & less(before("key")) & less(F.lead("key").over(w))
        rows = once(rows.withColumn("m", merge.cast("long")).where(F.col("blk") == own).select("p", "lo", "g", "b", "m", "blk"))
        sums = rows.groupBy("blk").agg(F.sum("m").alias("t"))
        offset = sums.select("blk", F.coalesce(F.sum("t").over(Window.partitionBy(F.lit(0)).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
        placed = attach(rows.withColumn("upto", F.sum("m").over(w)), offset, ["blk"])
        state = once(placed.groupBy((F.col("p") - F.col("upto") - F.col("offset")).alias("p")).agg(F.min("lo").alias("lo"), F.sum("g").alias("g"), F.sum("b").alias("b")))
        n = state.count()
    merged = chi_merge(state.select(F.col("p").cast("int").alias("bin"), F.col("g").alias("goods"), F.col("b").alias("bads")), most_bins, p_value)
    first = state.join(F.broadcast(merged.select(F.col("merged_bin").cast("long").alias("p")).distinct()), "p")
    lows = first.agg(F.sort_array(F.collect_list("lo")).alias("__lows"))
    # a handful of bins are left, at most ``last``
    return attach(stats.where("bin IS NOT NULL").select("bin"), lows).select("bin", F.array_max(F.filter("__lows", lambda x: x <= F.col("bin"))).alias("merged_bin"))
