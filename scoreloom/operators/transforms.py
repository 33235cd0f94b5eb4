"""Feature transformations: scaling, binning, encoding. Nulls stay null; ``by`` makes every statistic one of the group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import attach, running

#: Rows up to which quantiles count distinct values in a buffer.
BUFFERED = 5_000_000


def min_max_scale(df: DataFrame, column: str, out: str, by: Sequence[str] = (), low: float | None = None, high: float | None = None, symmetric: bool = False) -> DataFrame:
    """(x - min) / (max - min), 0 where all are equal; with low and high by these bounds; symmetric: to [-1, 1]."""
    x = F.col(column).cast("double")
    if low is None or high is None:
        stats = df.groupBy(*by).agg(F.min(column).cast("double").alias("__lo"), F.max(column).cast("double").alias("__hi"))
        df = attach(df, stats, by)
        lo, hi = F.col("__lo") if low is None else F.lit(float(low)), F.col("__hi") if high is None else F.lit(float(high))
    else:
        lo, hi = F.lit(float(low)), F.lit(float(high))
    scaled = F.when(x.isNull(), None).when(hi == lo, 0.0).otherwise((x - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return df.withColumn(out, 2 * scaled - 1 if symmetric else scaled).drop("__lo", "__hi")


def z_score(df: DataFrame, column: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / population standard deviation, 0 where that is 0."""
    x = F.col(column).cast("double")
    stats = df.groupBy(*by).agg(F.avg(x).alias("__mu"), F.stddev_pop(x).alias("__sd"))
    return attach(df, stats, by).withColumn(out, F.when(x.isNull(), None).when(F.col("__sd") == 0, 0.0).otherwise((x - F.col("__mu")) / F.nullif(F.col("__sd"), F.lit(0.0)))).drop("__mu", "__sd")


def by_edges(x: Column, edges: Column, n: int, right_closed: bool = False) -> Column:
    """Number of interior edges at or below x (below x if right_closed): bin 0 to n - 1."""
    out = F.lit(0)
    for k in range(1, n):
        edge = F.get(edges, F.lit(k))
        out = out + (x > edge if right_closed else x >= edge).cast("int")
    return out


def equal_width_edges(df: DataFrame, column: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    x = F.col(column).cast("double")
    stats = df.groupBy(*by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    edges = F.array(*(F.col("lo") + F.lit(float(k)) * ((F.col("hi") - F.col("lo")) / float(n)) for k in range(n + 1)))
    return stats.select(*by, edges.alias("edges"))


def quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), method: str = "auto", few_groups: bool = False) -> DataFrame:
    """(by, edges): linearly interpolated quantiles of the values that are not null.

    method: "percentile" holds counts of distinct values in one aggregate buffer a group; "rank" ranks
    distinct values by ranges instead, exact as well and without such a buffer; "auto" is the first for a
    table of up to BUFFERED rows, else the second; "approx" is a sketch. few_groups: so few that a row a
    group and share can be broadcast.
    """
    x = F.col(value).cast("double")
    if method == "auto":
        method = "percentile" if df.count() <= BUFFERED else "rank"
    if method == "approx":
        return df.groupBy(*by).agg(F.percentile_approx(x, F.array(*map(F.lit, shares)), F.lit(10_000)).alias("edges"))
    if method == "percentile":
        return df.groupBy(*by).agg(F.percentile(x, F.array(*map(F.lit, shares))).alias("edges"))
    rows = df.select(*by, x.alias("__x")).where("__x IS NOT NULL").groupBy(*by, "__x").agg(F.count("*").alias("__c"))
    counts = running(rows, "__x", {"__upto": F.col("__c")}, by)
    total = rows.groupBy(*by).agg(F.sum("__c").alias("__n"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("id"), F.lit(float(p)).alias("p")) for k, p in enumerate(shares))))
    places = total.withColumn("__s", each).select(*by, F.col("__s.id").alias("__id"), (F.col("__s.p") * (F.col("__n") - 1)).alias("__at"))
    places = places.select(*(F.col(k).alias(f"__k_{k}") for k in by), "__id", "__at", F.explode(F.array_distinct(F.array(F.floor("__at"), F.ceil("__at")))).alias("__place"))
    on = (F.col("__place") < F.col("__upto")) & (F.col("__place") >= F.col("__upto") - F.col("__c"))
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    held = counts.join(F.broadcast(places) if few_groups or not by else places, on)
    edges = held.groupBy(*by, "__id", "__at").agg(F.min_by("__x", "__place").alias("a"), F.max_by("__x", "__place").alias("b"))
    edges = edges.select(*by, "__id", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("__at") - F.floor("__at"))).alias("e"))
    return edges.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("__id", "e"))), lambda s: s["e"]).alias("edges"))


def equal_frequency_edges(df: DataFrame, column: str, n: int, by: Sequence[str] = (), method: str = "auto") -> DataFrame:
    """The n-quantiles, n + 1 edges; method as for ``quantiles``."""
    return quantiles(df, column, [k / n for k in range(n + 1)], by, method)


def apply_edges(df: DataFrame, column: str, edges: DataFrame, n: int, out: str = "bin", by: Sequence[str] = (), right_closed: bool = False) -> DataFrame:
    """Frozen edges on any rows: what lies outside falls in the first or last bin."""
    x = F.col(column).cast("double")
    return attach(df, edges.withColumnRenamed("edges", "__edges"), by).withColumn(out, F.when(x.isNotNull(), by_edges(x, F.col("__edges"), n, right_closed))).drop("__edges")


def equal_width_bins(df: DataFrame, column: str, n: int, out: str = "bin", by: Sequence[str] = ()) -> DataFrame:
    """Left-closed bins of equal width, 0 to n - 1; a constant column is all in the last."""
    return apply_edges(df, column, equal_width_edges(df, column, n, by), n, out, by)


def equal_frequency_bins(df: DataFrame, column: str, n: int, out: str = "bin", by: Sequence[str] = (), method: str = "auto") -> DataFrame:
    """Left-closed bins between quantiles; equal values share a bin, so some numbers may stay empty."""
    return apply_edges(df, column, equal_frequency_edges(df, column, n, by, method), n, out, by)


def fixed_bins(df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[str], out: str = "label", order: str | None = None) -> DataFrame:
    """Right-closed labelled bins (a, b], the lowest edge included; outside: null."""
    x = F.col(column).cast("double")
    name, number = F.when(x < edges[0], None), F.when(x < edges[0], None)
    for k, (top, text) in enumerate(zip(edges[1:], labels)):
        name, number = name.when(x <= top, text), number.when(x <= top, k)
    df = df.withColumn(out, name)
    return df if order is None else df.withColumn(order, number)


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Codes 0, 1, ... in alphabetical order of the values; null has none."""
    codes = df.select(F.col(column).alias("__v")).where("__v IS NOT NULL").distinct()
    codes = running(codes, "__v", {"__code": F.lit(1)}).select("__v", (F.col("__code") - 1).cast("int").alias(out))
    return df.join(codes, F.col(column) == F.col("__v"), "left").drop("__v")


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def round_half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)


def truncate(x: Column) -> Column:
    return x.cast("int")


def small_bins(stats: DataFrame, share: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """``stats`` (with total) with each bin's share of rows and whether that is under ``share``."""
    part = F.col("total") / F.sum("total").over(Window.partitionBy(*(by or [F.lit(0)])))
    return stats.withColumn("share", part).withColumn("too_small", F.col("share") < share)


def _fine(stats: DataFrame) -> list[list]:
    """Fine bins as [lowest bin, goods, bads]; a table of at most some hundred rows, as made by a binning operator. More than 1,000 are an error."""
    rows = stats.orderBy("bin").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 fine bins; bin the variable more coarsely first")
    return [[r.bin, r.goods, r.bads] for r in rows]


def chi_merge(stats: DataFrame, most_bins: int = 5, p_value: float = 0.05) -> DataFrame:
    """Merges neighbouring bins (bin, goods, bads) that differ least, until ``most_bins`` are left and all neighbours differ significantly.

    Returns (bin, merged_bin) with the lowest bin of each merger. The loop runs on the small table of bins.
    """
    spark, bins = stats.sparkSession, _fine(stats)
    groups = [[b[0]] for b in bins]
    counts = [(b[1], b[2]) for b in bins]
    critical = _critical(stats, p_value)

    def chi2(a, b):
        total, out = a[0] + a[1] + b[0] + b[1], 0.0
        for row in (a, b):
            for j in (0, 1):
                expected = sum(row) * (a[j] + b[j]) / total if total else 0
                out += (row[j] - expected) ** 2 / expected if expected else 0
        return out

    while len(groups) > 1:
        values = [chi2(a, b) for a, b in zip(counts, counts[1:])]
        k = min(range(len(values)), key=values.__getitem__)
        if len(groups) <= most_bins and values[k] >= critical:
            break
        groups[k : k + 2] = [groups[k] + groups[k + 1]]
        counts[k : k + 2] = [(counts[k][0] + counts[k + 1][0], counts[k][1] + counts[k + 1][1])]
    return spark.createDataFrame([(b, g[0]) for g in groups for b in g], "bin int, merged_bin int")


def _critical(df: DataFrame, p: float) -> float:
    """The chi-square value of one degree of freedom that is exceeded with probability p, by bisection on 60 steps of one row."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(1 - p / 2) ** 2


def optimal_bins(stats: DataFrame, n: int = 5) -> DataFrame:
    """Cuts of fine bins (bin, goods, bads) into at most ``n`` runs with the greatest information value; (bin, merged_bin).

    Dynamic programming over the small table of bins, so the optimum is exact.
    """
    from math import log

    spark, bins = stats.sparkSession, _fine(stats)
    goods, bads = sum(b[1] for b in bins) or 1, sum(b[2] for b in bins) or 1

    good_upto, bad_upto = [0], [0]
    for _, g, b in bins:
        good_upto.append(good_upto[-1] + g)
        bad_upto.append(bad_upto[-1] + b)

    def value(i, j):
        g, b = (good_upto[j] - good_upto[i]) / goods, (bad_upto[j] - bad_upto[i]) / bads
        return (g - b) * log(max(g, 1e-4) / max(b, 1e-4))

    best = {(0, 0): (0.0, [])}
    for parts in range(1, min(n, len(bins)) + 1):
        for j in range(parts, len(bins) + 1):
            options = [(best[parts - 1, i][0] + value(i, j), best[parts - 1, i][1] + [i]) for i in range(parts - 1, j) if (parts - 1, i) in best]
            best[parts, j] = max(options, key=lambda o: (o[0], [-c for c in o[1]]))
    ends = [best[p, len(bins)] for p in range(1, min(n, len(bins)) + 1)]
    starts = max(ends, key=lambda o: o[0])[1] if ends else []
    rows = [(b[0], bins[max(s for s in starts if s <= k)][0]) for k, b in enumerate(bins)]
    return spark.createDataFrame(rows, "bin int, merged_bin int")
