"""Model fit, and inference on Gini coefficients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.special import chi2_sf, normal_quantile, normal_two_sided
from .discrimination import auc, scored, with_unscored
from .once import once
from .order import attach, running

EDGE = 1e-15


def deviance_term(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.when(p.isNotNull(), -2 * (y * F.log(q) + (1 - y) * F.log(1 - q)))


def deviance(df: DataFrame, y: str = "y", p: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """deviance of the probabilities; null_deviance of the base rate and null_deviance_balanced of 1/2; n, events and n_unscored; all from one pass.

    Rows without a probability or target count in n_unscored alone.
    """
    there = scored(y, p)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    out = df.groupBy(*by).agg(F.sum(F.when(there, deviance_term(F.col(y), F.col(p).cast("double")))).alias("deviance"), count(there).alias("n"), F.sum(F.when(there, F.col(y).cast("long"))).alias("events"), count(~there).alias("n_unscored"))
    k, n = F.col("events"), F.col("n")
    rate = k / F.nullif(n, F.lit(0)).cast("double")
    null = n * (rate * deviance_term(F.lit(1.0), rate) + (1 - rate) * deviance_term(F.lit(0.0), rate))
    return out.withColumn("null_deviance", null).withColumn("null_deviance_balanced", 2 * n * F.log(F.lit(2.0)))


def fit_summary(dev: DataFrame, n_parameters: int, null: str = "null_deviance") -> DataFrame:
    """mcfadden_r2 and label, reduction, aic, and the likelihood-ratio test of all parameters."""
    d, d0 = F.col("deviance"), F.col(null)
    out = dev.withColumn("mcfadden_r2", 1 - d / F.nullif(d0, F.lit(0.0)))
    out = out.withColumns({"r2_label": labels.label(F.col("mcfadden_r2"), labels.R_SQUARED, inclusive=True), "deviance_reduction": d0 - d, "aic": d + 2.0 * n_parameters})
    return out.withColumn("lr_p_value", chi2_sf(F.col("deviance_reduction"), F.lit(n_parameters)))


def gini_variance(a: Column, n_pos: Column, n_neg: Column) -> Column:
    """Four times the Hanley-McNeil variance of the AUC."""
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    return 4 * (a * (1 - a) + (n_pos - 1) * (q1 - a * a) + (n_neg - 1) * (q2 - a * a)) / F.nullif(n_pos.cast("double") * n_neg, F.lit(0.0))


def gini_interval(df: DataFrame, y: str = "y", score: str = "score", level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """auc, gini, variance, standard_error, lower, upper."""
    z = normal_quantile((1 + level) / 2)
    out = auc(df, y, score, by).withColumn("variance", gini_variance(F.col("auc"), F.col("n_pos"), F.col("n_neg")))
    out = out.withColumn("standard_error", F.sqrt("variance"))
    return out.withColumns({"lower": F.col("gini") - z * F.col("standard_error"), "upper": F.col("gini") + z * F.col("standard_error")})


def gini_difference(g1: Column, v1: Column, g2: Column, v2: Column, alpha: float = 0.05) -> dict[str, Column]:
    """difference (second less first), z_statistic, two-sided p_value, is_significant, and which is better. The samples count as independent."""
    diff = g2 - g1
    z = diff / F.nullif(F.sqrt(v1 + v2), F.lit(0.0))
    p = normal_two_sided(z)
    return {"difference": diff, "z_statistic": z, "p_value": p, "is_significant": p < alpha, "verdict": F.when(p >= alpha, "no difference").when(diff > 0, "second better").otherwise("first better")}


def compare_scores(df: DataFrame, first: str, second: str, y: str = "y") -> DataFrame:
    """gini_difference of two scores of the same rows, as one row."""
    a = gini_interval(df, y, first).select(F.col("gini").alias("gini_1"), F.col("variance").alias("variance_1"))
    b = gini_interval(df, y, second).select(F.col("gini").alias("gini_2"), F.col("variance").alias("variance_2"))
    return a.crossJoin(b).withColumns(gini_difference(F.col("gini_1"), F.col("variance_1"), F.col("gini_2"), F.col("variance_2")))


def placements(dist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``dist`` (by, score, pos, neg) with P, N, v10 and v01: the placement values of a score's events and non-events.

    v10 is the share of non-events with a lower score, ties counting half; v01 the share of events with a higher one. Both come from the
    midrank of the score in the other class, so from one running total over distinct scores.
    """
    held = once(dist)
    ranked = running(held, "score", {"pos_upto": F.col("pos"), "neg_upto": F.col("neg")}, by, held=True)
    out = attach(ranked, held.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")), by)
    lower = F.col("neg_upto") - F.col("neg") / F.lit(2.0)
    higher = F.col("P") - F.col("pos_upto") + F.col("pos") / F.lit(2.0)
    share = lambda x, n: x / F.nullif(F.col(n).cast("double"), F.lit(0.0))
    return out.withColumns({"v10": share(lower, "N"), "v01": share(higher, "P")}).drop("pos_upto", "neg_upto")


def _class_sum(weight: str, x: Column) -> Column:
    # a class that a row lacks adds nothing, also where its placement is null
    return F.coalesce(F.sum(F.when(F.col(weight) > 0, F.col(weight) * x)), F.lit(0.0))


def _delong_variance(s10: Column, s01: Column, p: Column, n: Column) -> Column:
    """S10 / P + S01 / N of sums of squares or products of centred placements; null for a class of fewer than two rows."""
    part = lambda s, m: s / F.nullif((m - 1).cast("double"), F.lit(0.0)) / F.nullif(m.cast("double"), F.lit(0.0))
    return part(s10, p) + part(s01, n)


def delong(df: DataFrame, y: str = "y", score: str = "score", level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """(by) n_pos, n_neg, n_unscored, auc, gini, variance and standard_error of the Gini by DeLong, lower, upper.

    The variance is that of the placement values, without an assumption on the scores' distribution; it needs two rows of either class, else
    it is null. All of it works on counts by distinct score, and ranks by ranges of them.
    """
    z = normal_quantile((1 + level) / 2)
    placed = once(placements(with_unscored(df, y, score, by), by))
    means = placed.groupBy(*by).agg(F.max("P").alias("n_pos"), F.max("N").alias("n_neg"), F.sum("n_unscored").alias("n_unscored"), (_class_sum("pos", F.col("v10")) / F.nullif(F.max("P").cast("double"), F.lit(0.0))).alias("auc"))
    means = means.withColumn("auc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("auc")))
    d10, d01 = F.col("v10") - F.col("auc"), F.col("v01") - F.col("auc")
    sums = attach(placed, means.select(*by, "auc"), by).groupBy(*by).agg(_class_sum("pos", d10 * d10).alias("__s10"), _class_sum("neg", d01 * d01).alias("__s01"))
    out = attach(means, sums, by).withColumn("gini", 2 * F.col("auc") - 1)
    out = out.withColumn("variance", F.when(F.col("auc").isNotNull(), 4 * _delong_variance(F.col("__s10"), F.col("__s01"), F.col("n_pos"), F.col("n_neg")))).withColumn("standard_error", F.sqrt("variance"))
    return out.withColumns({"lower": F.col("gini") - z * F.col("standard_error"), "upper": F.col("gini") + z * F.col("standard_error")}).drop("__s10", "__s01")


def delong_compare(df: DataFrame, first: str, second: str, y: str = "y", alpha: float = 0.05, level: float = 0.95) -> DataFrame:
    """Two scores of the same rows, with their correlation, as one row.

    n_pos, n_neg, n_unscored, gini_1, gini_2, variance_1, variance_2, covariance and correlation (of the Ginis), difference (second less first), its
    standard_error, lower and upper, z_statistic, p_value, is_significant and verdict. Rows that lack either score or the target take
    no part. Equal scores have a difference of exactly 0 and no z_statistic; the verdict is then "no difference".

    Rows are counted by pair of scores first. Each score's placements come from its distinct values, and go back to the pairs by joins on the score,
    which AQE can split where very many pairs share one.
    """
    z = normal_quantile((1 + level) / 2)
    there = scored(y, first) & scored(y, second)
    flags = df.select(F.when(there, F.col(first).cast("double")).alias("s1"), F.when(there, F.col(second).cast("double")).alias("s2"), (there & (F.col(y) == 1)).cast("long").alias("p"), (there & (F.col(y) == 0)).cast("long").alias("n"), (~there).cast("long").alias("u"))
    pairs = once(flags.groupBy("s1", "s2").agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"), F.sum("u").alias("n_unscored")))
    rows = pairs.where("s1 IS NOT NULL")
    sides = []
    for side in "12":
        placed = once(placements(rows.groupBy(F.col(f"s{side}").alias("score")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))))
        mean = placed.agg((_class_sum("pos", F.col("v10")) / F.nullif(F.max("P").cast("double"), F.lit(0.0))).alias("a"))
        sides.append(attach(placed, mean).select(F.col("score").alias(f"s{side}"), F.col("a").alias(f"auc_{side}"), (F.col("v10") - F.col("a")).alias(f"d10_{side}"), (F.col("v01") - F.col("a")).alias(f"d01_{side}")))
    joined = rows.join(sides[0], "s1").join(sides[1], "s2")
    c = F.col
    sums = {f"s{kind}_{a}{b}": _class_sum(of, c(f"d{kind}_{a}") * c(f"d{kind}_{b}")) for kind, of in (("10", "pos"), ("01", "neg")) for a, b in ("11", "22", "12")}
    one = joined.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"), F.max("auc_1").alias("auc_1"), F.max("auc_2").alias("auc_2"), *(x.alias(name) for name, x in sums.items()))
    one = attach(one, pairs.agg(F.coalesce(F.sum("n_unscored"), F.lit(0)).alias("n_unscored")))
    both = (c("n_pos") > 0) & (c("n_neg") > 0)
    var = lambda ab: F.when(both, 4 * _delong_variance(c(f"s10_{ab}"), c(f"s01_{ab}"), c("n_pos"), c("n_neg")))
    out = one.select("n_pos", "n_neg", "n_unscored", *(F.when(both, 2 * c(f"auc_{k}") - 1).alias(f"gini_{k}") for k in "12"), var("11").alias("variance_1"), var("22").alias("variance_2"), var("12").alias("covariance"))
    out = out.withColumn("correlation", c("covariance") / F.nullif(F.sqrt(c("variance_1") * c("variance_2")), F.lit(0.0))).withColumn("difference", c("gini_2") - c("gini_1"))
    # rounding can leave a variance of equal scores a little below 0
    out = out.withColumn("standard_error", F.sqrt(F.greatest(c("variance_1") + c("variance_2") - 2 * c("covariance"), F.lit(0.0))))
    out = out.withColumns({"lower": c("difference") - z * c("standard_error"), "upper": c("difference") + z * c("standard_error")})
    settled = F.abs("difference") < 1e-12
    out = out.withColumn("z_statistic", F.when(~settled, c("difference") / F.nullif(c("standard_error"), F.lit(0.0))))
    out = out.withColumn("p_value", F.when(settled, 1.0).otherwise(normal_two_sided(c("z_statistic")))).withColumn("is_significant", c("p_value") < alpha)
    return out.withColumn("verdict", F.when(c("p_value") >= alpha, "no difference").when(c("difference") > 0, "second better").when(c("difference") < 0, "first better"))
