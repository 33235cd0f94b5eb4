"""One rule for rows without a score, a target or a value."""

import math

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import discrimination as G
from scoreloom.operators import fit as V
from scoreloom.operators import lift as L
from scoreloom.operators import models as M
from scoreloom.operators import stability as P
from scoreloom.plans import flows


@pytest.fixture(scope="module")
def both(spark):
    """Ten scored rows that the score ranks without a fault, alone and among ninety without a score, two NaN and one without a target."""
    rows = [(i, int(i >= 5), 0.05 + 0.09 * i) for i in range(10)]
    schema = "key long, y int, score double"
    more = [(100 + i, i % 2, None) for i in range(90)] + [(300, 1, math.nan), (301, 0, math.nan), (302, None, 0.4)]
    return spark.createDataFrame(rows, schema), spark.createDataFrame(rows + more, schema)


def test_fit_leaves_unscored_rows_out(both):
    plain, gaps = (V.fit_summary(V.deviance(x), 2).first() for x in both)
    assert (plain.n_unscored, gaps.n_unscored, gaps.n, gaps.events) == (0, 93, 10, 5)
    for name in ("deviance", "null_deviance", "mcfadden_r2", "aic", "deviance_reduction", "lr_p_value"):
        assert getattr(plain, name) == pytest.approx(getattr(gaps, name))


def test_rank_measures_leave_unscored_rows_out(both):
    plain, gaps = (G.auc(x).first() for x in both)
    assert (gaps.auc, gaps.n_pos, gaps.n_neg, gaps.n_unscored) == (1.0, 5, 5, 93) and plain.n_unscored == 0
    for f in (G.confusion, G.lorenz, L.lift_table, G.roc, G.lorenz_gini_area, G.accuracy_ratio, G.concentration):
        a, b = (sorted(map(tuple, f(x).collect())) for x in both)
        assert a == b, f
    assert G.coverage(both[1]).first().asDict() == {"n": 103, "n_unscored": 93, "scored_share": pytest.approx(10 / 103)}


def test_nothing_scored(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 0, None)], "key long, y int, score double")
    assert G.auc(df).first().asDict()["n_unscored"] == 2 and G.auc(df).first().auc == 0.5
    assert V.deviance(df).first().n == 0 and V.delong(df).first().variance is None
    assert G.coverage(df.limit(0)).first().n_unscored == 0


def test_scorecard_of_rows_with_gaps(spark):
    """Rows with a null number get no score, and the report is that of the others."""
    rows = [(i, int((i * 37) % 100 < 30 + i % 10 * 4), float(i % 10), None if i % 4 == 0 else float((i * 7) % 13)) for i in range(800)]
    df = spark.createDataFrame(rows, "key long, y int, a double, b double")
    out = flows.build_scorecard(df, "key", "y", ["a", "b"], challenger=["a"])
    n = out["scored"].count()
    missing = out["scored"].where("score IS NULL").count()
    assert 0 < missing < n
    assert out["gini"].first().n_unscored == missing and out["fit"].first().n_unscored == missing
    assert out["fit"].first().n == n - missing and sum(r.n for r in out["confusion"].collect()) == n - missing
    assert out["lift"].agg(F.sum("count")).first()[0] == n - missing
    assert out["coverage"].first().n_unscored == missing
    assert out["challenger"].first().n_unscored == missing


def test_shares_add_up_with_missing_values(spark):
    rows = [(i, None if i % 4 == 0 else i % 3, False) for i in range(240)] + [(i, None if i % 2 == 0 else i % 3, True) for i in range(240)] + [(1, 2, None)]
    df = spark.createDataFrame(rows, "key long, bin int, late boolean")
    for bins in (None, P.grid(df, 4)):
        out = {r.bin: (r.expected, r.actual) for r in P.shares(df, "bin", F.col("late"), bins=bins).collect()}
        assert sum(e for e, _ in out.values()) == pytest.approx(1) and sum(a for _, a in out.values()) == pytest.approx(1)
        assert out[None] == (pytest.approx(60 / 241), pytest.approx(0.5))
        assert len(out) == (5 if bins is not None else 4)
    same = df.where("late").unionByName(df.where("late").withColumn("late", F.lit(False)))
    assert P.psi(P.shares(same, "bin", F.col("late"), bins=P.grid(df, 4))).first().psi == pytest.approx(0)


def test_ranking_with_missing_values(spark):
    """Half of the production values are missing at random: that is a shift by itself, of the missing bin and not of the others' sum."""
    rows = [(float(i % 50), float(i % 7), False) for i in range(1000)] + [(float(i % 50) if i % 2 else None, float(i % 7), True) for i in range(1000)]
    df = spark.createDataFrame(rows, "a double, b double, late boolean")
    out = {r.variable: r.psi for r in P.psi_ranking(df, ["a", "b"], F.col("late")).collect()}
    assert out["b"] == pytest.approx(0, abs=1e-3)
    share = [(0.05, 0.1)] * 10 + [(0.5, 1e-4)]
    assert out["a"] == pytest.approx(sum((a - e) * math.log(a / e) for a, e in share), rel=0.05)


def test_split_is_exact_and_without_a_shuffle_of_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("key"), F.when(F.col("id") % 10 == 0, 1).when(F.col("id") % 997 != 5, 0).alias("y"), F.lit("payload").alias("text"))
    out = M.stratified_split(df, "y", "key", 0.3, 5)
    got = {r.y: (r.n, r.t) for r in out.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    assert {y: t for y, (n, t) in got.items()} == {y: int(n * 0.3) for y, (n, t) in got.items()} and None in got
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
