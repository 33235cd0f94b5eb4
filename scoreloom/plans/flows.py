"""The workflows from end to end: each takes tables and returns the tables of its report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import discrimination, evidence, fit, lift, markov, models, stability, transforms
from ..operators.relational import validate_counts
from ..sources import synthetic


def evaluate_features(df: DataFrame, columns: Sequence[str], target: str, n: int = 5) -> DataFrame:
    """Bins, weight of evidence and information value of each column: (variable, bin, total, goods, bads, woe, iv_component, iv, iv_label).

    All columns are binned side by side and counted in one aggregation.
    """
    stats = evidence.with_woe(evidence.bin_statistics(evidence.binned_columns(df, columns, target, n), "bin", "__y", ["variable"]))
    value = evidence.information_value(stats.drop("woe", "iv_component"), ["variable"])
    return stats.select("variable", "bin", "total", "goods", "bads", "woe", "iv_component").join(value, "variable")


def monitor_stability(df: DataFrame, columns: Sequence[str], is_actual: Column, n: int = 10) -> DataFrame:
    """(variable, bin, development_pct, production_pct, difference_pct, psi_component, psi, psi_label), bins frozen on development."""
    df = df.withColumn("__actual", is_actual)
    edges = evidence.frozen_edges(df.where(~F.col("__actual")), columns, n)
    long = evidence.unpivot(df, columns, ["__actual"]).join(F.broadcast(edges), "variable")
    shares = stability.shares(long.withColumn("bin", transforms.by_edges(F.col("value"), F.col("edges"), n)), "bin", F.col("__actual"), ["variable"], stability.grid(df, n))
    return stability.psi_table(shares).drop("expected", "actual").join(stability.psi(shares, ["variable"]), "variable")


def build_scorecard(df: DataFrame, key: str, target: str, numeric: Sequence[str], categorical: Sequence[str] = (), challenger: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Split, scale, encode, fit and score, then every measure of the scored test rows (key, y, score, challenger).

    Rows that a missing number leaves without a score take no part in the measures; ``coverage`` counts them. The models are compared with
    the correlation of their scores.

    The scored table is what all measures read; write or cache it if they are all wanted. The challenger is an unweighted model of some of the numbers, the first by default.
    """
    split = models.stratified_split(df, target, key)
    train, test = split.where(~F.col("is_test")), split.where("is_test").drop("is_test")
    model = models.fit_logistic(train, target, numeric, categorical)
    other = models.fit_logistic(train, target, list(challenger or numeric[:1]), balanced=False)
    scored = models.predict(other, models.predict(model, test), "challenger").select(F.col(key).alias("key"), F.col(target).alias("y"), "score", "challenger")
    deviance = fit.deviance(scored)
    table = lift.lift_table(scored)
    return {
        "scored": scored,
        "coverage": discrimination.coverage(scored),
        "coefficients": models.coefficients(model, df),
        "gini": fit.gini_interval(scored),
        "roc": discrimination.roc(scored),
        "confusion": discrimination.confusion(scored),
        "lorenz": discrimination.lorenz(scored),
        "lift": table,
        "lift_summary": lift.lift_summary(table),
        "fit": fit.fit_summary(deviance, len(numeric) + len(categorical) + 1),
        "challenger": fit.delong_compare(scored, "score", "challenger"),
    }


def project_portfolio(spark: SparkSession, seed: int = 42) -> dict[str, DataFrame]:
    """A synthetic portfolio against its targets, evidence by band, and its projection with losses and provisions."""
    clients = synthetic.portfolio(spark, seed=seed)
    targets = spark.createDataFrame([(b, markov.CLIENTS[b], markov.DEFAULTS[b]) for b in markov.CLIENTS], "banda int, rows long, flagged long")
    projection = markov.project(markov.transition_table(spark), markov.initial_table(spark))
    held = markov.client_table(spark)
    return {
        "portfolio": clients,
        "validation": validate_counts(clients, targets, "banda", "default"),
        "evidence": evidence.with_woe(evidence.bin_statistics(clients, "banda", "default")),
        "gini": discrimination.auc(clients, "default", "prob_default"),
        "projection": projection,
        "speed": markov.deterioration(projection),
        "losses": markov.projected_loss(projection, held),
        "provisions": markov.provisions(projection, held),
    }
