"""How well a score separates target 1 from target 0.

A scored table has a binary target ``y``, a numeric ``score`` and a unique ``key`` that breaks ties.
Metrics that see only the order of distinct scores work on the aggregated score distribution.

One rule for gaps holds in all measures, here, in ``fit`` and in ``lift``: a row without a score (null or
NaN) or without a target takes no part. Measures of one row a group give the number of such rows as
n_unscored; ``coverage`` gives it for the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from .once import once
from .order import attach, running


def scored(y: str, score: str) -> Column:
    """Whether a row takes part: it has a target, and a score that is a number. Never null."""
    x = F.col(score).cast("double")
    return F.col(y).isNotNull() & x.isNotNull() & ~F.isnan(F.coalesce(x, F.lit(0.0)))


def coverage(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """(by) n, n_unscored and scored_share: how many rows there are, and how many of them take no part."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum((~scored(y, score)).cast("long")), F.lit(0)).cast("long").alias("n_unscored"))
    return out.withColumn("scored_share", 1 - F.col("n_unscored") / F.nullif(F.col("n"), F.lit(0)))


def distribution(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """(by, score, pos, neg): the counts of each distinct score of the rows that take part."""
    rows = df.where(scored(y, score))
    return rows.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) == 0).cast("long")).alias("neg"))


def with_unscored(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``distribution`` with n_unscored; the rows that take no part, if a group has such, are one row without a score or counts."""
    there = scored(y, score)
    hit = lambda v: F.sum((there & (F.col(y) == v)).cast("long"))
    shown = F.when(there, F.col(score).cast("double"))
    return df.groupBy(*by, shown.alias("score")).agg(F.coalesce(hit(1), F.lit(0)).cast("long").alias("pos"), F.coalesce(hit(0), F.lit(0)).cast("long").alias("neg"), F.sum((~there).cast("long")).alias("n_unscored"))


def auc(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """auc, gini (2 auc - 1) and its labels, n_pos, n_neg, n_unscored. Ties count half; a single class has auc 1/2 and gini 0."""
    dist = running(with_unscored(df, y, score, by), "score", {"neg_upto": F.col("neg")}, by)
    half = F.col("pos") * (F.col("neg_upto") - F.col("neg") / F.lit(2.0))
    out = dist.groupBy(*by).agg(F.sum(half).alias("__u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.coalesce(F.sum("n_unscored"), F.lit(0)).cast("long").alias("n_unscored"))
    a = F.coalesce(F.col("__u") / F.nullif(F.col("n_pos").cast("double") * F.col("n_neg"), F.lit(0.0)), F.lit(0.5))
    out = out.withColumn("auc", a).withColumn("gini", 2 * F.col("auc") - 1).drop("__u")
    return out.withColumn("gini_label", labels.label(F.col("gini"), labels.GINI)).withColumn("gini_label_short", labels.label(F.col("gini"), labels.GINI_THREE, inclusive=True))


def roc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """threshold, tpr, fpr by descending threshold, from (infinity, 0, 0). Points inside straight lines are left out."""
    dist = once(distribution(df, y, score))
    run = running(dist, "score", {"tp": F.col("pos"), "fp": F.col("neg"), "place": F.lit(1).cast("long")}, descending=True, held=True)
    other = lambda d: run.select((F.col("place") - d).alias("place"), F.col("pos").alias(f"pos{d}"), F.col("neg").alias(f"neg{d}"))
    # steps to a point and from it are the counts at it and at the next; bends have unlike ones
    bend = run.join(other(1), "place", "left")
    bend = bend.where((F.col("place") == 1) | F.col("pos1").isNull() | (F.col("pos") != F.col("pos1")) | (F.col("neg") != F.col("neg1")))
    totals = dist.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    points = attach(bend.select(F.col("score").alias("threshold"), "tp", "fp"), totals)
    rate = lambda c, n: F.col(c) / F.nullif(F.col(n), F.lit(0)).cast("double")
    points = points.select("threshold", rate("tp", "P").alias("tpr"), rate("fp", "N").alias("fpr"))
    start = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return start.unionByName(points)


def operating_points(points: DataFrame, wanted: Sequence[float] = (0.3, 0.5, 0.7)) -> DataFrame:
    """The ROC point whose threshold is nearest to each wanted one (the greater of two): wanted, threshold, tpr, fpr, specificity."""
    each = points.withColumn("wanted", F.explode(F.array(*(F.lit(float(u)) for u in wanted))))
    nearest = F.min_by(F.struct("threshold", "tpr", "fpr"), F.struct(F.abs(F.col("threshold") - F.col("wanted")), -F.col("threshold"))).alias("p")
    return each.groupBy("wanted").agg(nearest).select("wanted", "p.*", (1 - F.col("p.fpr")).alias("specificity"))


def confusion(df: DataFrame, y: str = "y", score: str = "score", threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """(by, actual, predicted, n): all four cells of the rows that take part; predicted is score >= threshold."""
    there = scored(y, score)
    hit = (F.col(score) >= threshold).cast("int")
    cells = [F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.sum((there & (F.col(y) == a) & (hit == p)).cast("long")).alias("n")) for a in (0, 1) for p in (0, 1)]
    return df.groupBy(*by).agg(F.array(*cells).alias("c")).select(*by, F.explode("c").alias("c")).select(*by, "c.actual", "c.predicted", F.coalesce("c.n", F.lit(0)).cast("long").alias("n"))


def _ranked(df: DataFrame, y: str, score: str, key: str, descending: bool) -> tuple[DataFrame, DataFrame]:
    rows = once(df.where(scored(y, score)).select(F.col(score).cast("double").alias("score"), F.col(key).alias("key"), F.col(y).cast("long").alias("y")))
    ranked = running(rows, "score", {"place": F.lit(1).cast("long"), "cum": F.col("y")}, tie=["key"], descending=descending, held=True)
    return ranked, rows.agg(F.count("*").alias("n"), F.sum("y").alias("P"))


def lorenz(df: DataFrame, y: str = "y", score: str = "score", key: str = "key", n_points: int = 10, descending: bool = False) -> DataFrame:
    """point, cum_pop, cum_bads at n_points + 1 even places of the rows by ascending score; descending: the CAP curve."""
    ranked, totals = _ranked(df, y, score, key, descending)
    points = attach(df.sparkSession.range(n_points + 1).select(F.col("id").cast("int").alias("point")), totals)
    points = points.withColumn("at", F.floor(F.col("point") * F.col("n") / n_points))
    held = ranked.select(F.col("place").alias("at"), "cum").join(F.broadcast(points), "at")
    origin = points.where("at = 0").withColumn("cum", F.lit(0).cast("long"))
    rows = held.unionByName(origin.select(held.columns))
    share = lambda c, n: F.col(c) / F.nullif(F.col(n), F.lit(0)).cast("double")
    return rows.select("point", share("at", "n").alias("cum_pop"), F.coalesce(share("cum", "P"), F.lit(0.0)).alias("cum_bads"))


def _area(cum: str) -> Column:
    """The sum of running totals, which grows with the square of the rows: exact, beyond what a long holds."""
    return F.sum(F.col(cum).cast("decimal(20,0)")).cast("double")


def lorenz_gini_area(df: DataFrame, y: str = "y", score: str = "score", key: str = "key") -> DataFrame:
    """gini_area: 1 - 2 * the trapezoid area under the curve through every row. Not 2 auc - 1: (1 - event rate) times it, but for ties."""
    ranked, _ = _ranked(df, y, score, key, False)
    out = ranked.agg(F.count("*").alias("n"), F.sum("y").cast("double").alias("P"), _area("cum").alias("C"))
    return out.select((1 - (2 * F.col("C") - F.col("P")) / F.nullif(F.col("n") * F.col("P"), F.lit(0.0))).alias("gini_area"))


def concentration(df: DataFrame, shares: Sequence[float] = (0.1, 0.2, 0.3, 0.5), y: str = "y", score: str = "score", key: str = "key", descending: bool = False) -> DataFrame:
    """share, captured: the part of events in that share of rows, of lowest score, or of highest if descending."""
    ranked, totals = _ranked(df, y, score, key, descending)
    wanted = attach(df.sparkSession.range(1).select(F.explode(F.array(*(F.lit(float(p)) for p in shares))).alias("share")), totals).withColumn("at", F.floor(F.col("share") * F.col("n")))
    # events up to the last of the first rows, which is one row a share
    held = ranked.select(F.col("place").alias("at"), "cum").join(F.broadcast(wanted.where("at > 0").select("share", "at")), "at").select("share", "cum")
    out = wanted.join(held, "share", "left")
    return out.select("share", (F.coalesce("cum", F.lit(0)) / F.nullif("P", F.lit(0)).cast("double")).alias("captured"))


def accuracy_ratio(df: DataFrame, y: str = "y", score: str = "score", key: str = "key") -> DataFrame:
    """accuracy_ratio: the CAP curve's area above the diagonal over that of a perfect score."""
    ranked, _ = _ranked(df, y, score, key, True)
    out = ranked.agg(F.count("*").alias("n"), F.sum("y").cast("double").alias("P"), _area("cum").alias("C"))
    n, p = F.col("n").cast("double"), F.nullif(F.col("P"), F.lit(0.0))
    area = (2 * F.col("C") - F.col("P")) / (2 * n * p)
    return out.select(((area - 0.5) / F.nullif((1 - p / n) / 2, F.lit(0.0))).alias("accuracy_ratio"))


def trapezoid_gini(points: DataFrame, x: str = "cum_pop", y: str = "cum_bads") -> DataFrame:
    """gini of a curve given as a few points, from the origin: 1 - sum of (x - x') (y + y')."""
    w = Window.partitionBy(F.lit(0)).orderBy(x, y)
    step = (F.col(x) - F.coalesce(F.lag(x).over(w), F.lit(0.0))) * (F.col(y) + F.coalesce(F.lag(y).over(w), F.lit(0.0)))
    return points.select(step.alias("s")).agg((1 - F.sum("s")).alias("gini"))


def impurity(df: DataFrame, classes: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """(by, n, impurity): 1 - the sum of squared class shares of each node."""
    counts = df.groupBy(*by, classes).agg(F.sum(weight if weight is not None else F.lit(1)).alias("__c"))
    c, total = F.col("__c").cast("double"), F.sum("__c")
    whole = total.cast("double")
    return counts.groupBy(*by).agg(total.alias("n"), (1 - F.sum(c * c) / F.nullif(whole * whole, F.lit(0.0))).alias("impurity"))


def impurity_reduction(df: DataFrame, classes: str, split: str) -> DataFrame:
    """parent, children (weighted mean) and reduction of impurity by a split."""
    parent = impurity(df, classes).select(F.col("impurity").alias("parent"))
    children = impurity(df, classes, [split]).agg((F.sum(F.col("n") * F.col("impurity")) / F.sum("n")).alias("children"))
    return attach(parent, children).withColumn("reduction", F.col("parent") - F.col("children"))


def histogram(df: DataFrame, value: str, n: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, low, n, density) in n equal widths over all rows; densities of each group integrate to 1. Empty bins are left out."""
    x = F.col(value).cast("double")
    bounds = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    rows = attach(df.where(x.isNotNull()), bounds)
    width = (F.col("hi") - F.col("lo")) / float(n)
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((x - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(n - 1))).cast("int")
    counts = rows.withColumn("bin", b).groupBy(*by, "bin", "lo", width.alias("width")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)])))
    return counts.select(*by, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), "n", (F.col("n") / F.nullif(total * F.col("width"), F.lit(0.0))).alias("density"))
