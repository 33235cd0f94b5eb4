import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import labels
from scoreloom.functions.special import chi2_sf, normal_cdf
from scoreloom.operators import discrimination as G
from scoreloom.operators import evidence as E
from scoreloom.operators import fit as V
from scoreloom.operators import independence as X
from scoreloom.operators import lift as L
from scoreloom.operators import markov as C
from scoreloom.operators import models as M
from scoreloom.operators import relational as R
from scoreloom.operators import segments as S
from scoreloom.operators import stability as P
from scoreloom.operators import transforms as T
from scoreloom.operators.order import running

near = lambda *x: pytest.approx(x if len(x) > 1 else x[0], abs=1e-6)


@pytest.fixture(scope="module")
def incomes(spark):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate([15000, 35000, 8000, 42000, 12000])], "id int, x double")


def column(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_scaling(spark, incomes):
    assert column(T.min_max_scale(incomes, "x", "y"), "y") == pytest.approx([0.205882, 0.794118, 0, 1, 0.117647], abs=1e-6)
    assert column(T.min_max_scale(incomes, "x", "y", low=3000, high=50000), "y")[0] == near(0.255319)
    assert min(column(T.min_max_scale(incomes, "x", "y", symmetric=True), "y")) == -1
    assert column(T.z_score(incomes, "x", "y"), "y") == pytest.approx([-0.548, 0.932, -1.066, 1.450, -0.770], abs=1e-3)
    same = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "id int, x double")
    assert column(T.min_max_scale(same, "x", "y"), "y") == column(T.z_score(same, "x", "y"), "y") == [0, 0, None]
    assert column(T.equal_width_bins(same, "x", 4), "bin") == [3, 3, None]


def test_binning(spark, incomes):
    assert column(T.equal_frequency_bins(incomes, "x", 3), "bin") == [1, 2, 0, 2, 0]
    assert column(T.equal_frequency_bins(incomes, "x", 3, method="rank"), "bin") == [1, 2, 0, 2, 0]
    assert column(T.equal_width_bins(incomes, "x", 3), "bin") == [0, 2, 0, 2, 0]
    edges = T.equal_frequency_edges(incomes, "x", 3)
    out = spark.createDataFrame([(0, -1.0), (1, 1e9), (2, None)], "id int, x double")
    assert column(T.apply_edges(out, "x", edges, 3), "bin") == [0, 2, None]
    ties = spark.createDataFrame([(i, v) for i, v in enumerate([1.0] * 8 + [2.0, 3.0])], "id int, x double")
    assert set(column(T.equal_frequency_bins(ties, "x", 5), "bin")) == set(column(T.equal_frequency_bins(ties, "x", 5, method="rank"), "bin"))
    fixed = T.fixed_bins(spark.createDataFrame([(0, 0.0), (1, 8000.0), (2, 8000.1), (3, 50001.0), (4, 50002.0), (5, -1.0)], "id int, x double"), "x", [0, 8000, 15000, 50001], ["a", "b", "c"])
    assert column(fixed, "label") == ["a", "a", "b", "c", None, None]


def test_edges_by_rank_equal_percentile(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.choice([rng.random(), 0.5, 2.0]),) for _ in range(2001)], "x double")
    a, b = (T.equal_frequency_edges(df, "x", 10, method=m).first().edges for m in ("percentile", "rank"))
    assert a == pytest.approx(b, abs=1e-12)


def test_encode_clip_round(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "id int, c string")
    assert column(T.label_encode(df, "c", "k"), "k") == [1, 0, None, 1]
    row = spark.range(1).select(T.clip(F.lit(7.0), 0.0, 5.0).alias("a"), T.round_half_even(F.lit(2.5)).alias("b"), T.truncate(F.lit(-1.9)).alias("c"), T.clip(F.lit(None).cast("double"), 0.0, 1.0).alias("d")).first()
    assert tuple(row) == (5.0, 2.0, -1, None)


def bins_of(spark, rows):
    return spark.createDataFrame(rows, "bin int, goods long, bads long").withColumn("total", F.col("goods") + F.col("bads")).withColumns({"pct_goods": F.col("goods") / F.lit(sum(r[1] for r in rows)), "pct_bads": F.col("bads") / F.lit(sum(r[2] for r in rows))})


def test_evidence_goldens(spark):
    stats = bins_of(spark, list(zip(range(5), [135, 240, 196, 108, 36], [15, 60, 84, 72, 54])))
    assert column(E.with_woe(stats), "woe", "bin") == pytest.approx([1.2774, 0.4665, -0.0725, -0.5143, -1.3253], abs=1e-4)
    assert E.information_value(stats).first().iv == near(0.470453)
    assert E.information_value(stats).first().iv_label == "Strong"
    clients, defaults = C.CLIENTS, C.DEFAULTS
    bands = bins_of(spark, [(b, clients[b] - defaults[b], defaults[b]) for b in clients])
    assert column(E.with_woe(bands, "replace"), "woe", "bin") == pytest.approx([-3.7377, -0.7419, 0.5931, 1.4700, 2.3848], abs=1e-4)
    assert E.information_value(bands, zero_policy="replace").first().iv == near(2.950449)
    guide = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, 1), (1, 0), (2, 1), (2, 1), (2, 1), (2, 0), (0, 0)], "bin int, target int")
    assert E.information_value(E.bin_statistics(guide, "bin", "target")).first().iv > 0.5


def test_evidence_edges(spark):
    one = spark.createDataFrame([(0, 1), (1, 1)], "bin int, target int")
    rows = E.with_woe(E.bin_statistics(one, "bin", "target")).collect()
    assert all(r.woe is None and r.pct_goods is None for r in rows)
    zero = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 1)], "bin int, target int")
    clamp, replace = (E.with_woe(E.bin_statistics(zero, "bin", "target"), p).orderBy("bin").first() for p in ("clamp", "replace"))
    assert clamp.woe == replace.woe and clamp.iv_component != replace.iv_component
    flipped = zero.withColumn("target", 1 - F.col("target"))
    assert E.information_value(E.bin_statistics(zero, "bin", "target")).first().iv == near(E.information_value(E.bin_statistics(flipped, "bin", "target")).first().iv)


def test_psi(spark):
    table = lambda e, a: spark.createDataFrame(list(zip(range(len(e)), e, a)), "bin int, expected double, actual double")
    e = [0.1, 0.2, 0.4, 0.3]
    assert P.psi(table(e, e)).first().psi == 0
    assert P.psi(table([0.5, 0.5, 0.0], [0.4, 0.5, 0.1])).first().psi > 0.25
    one = lambda d: spark.createDataFrame(list(d.items()), "bin string, share double")
    assert P.psi_between(one({"a": 1.0}), one({"b": 1.0})).first().psi > 5
    rows = spark.createDataFrame([(0, False), (0, False), (1, True)], "bin int, late boolean")
    got = P.shares(rows, "bin", F.col("late"), bins=P.grid(rows, 3)).orderBy("bin").collect()
    assert [(r.expected, r.actual) for r in got] == [(1, 0), (0, 1), (0, 0)]


def test_chi2(spark):
    cells = [(r, c, n) for r, row in enumerate([[320, 180], [240, 60], [70, 30], [85, 15]]) for c, n in enumerate(row)]
    row = X.independence(spark.createDataFrame(cells, "row_key int, col_key int, observed long")).first()
    assert (row.chi2, row.df) == (near(33.492823), 3) and row.p_value == pytest.approx(2.535e-7, rel=1e-3) and row.is_significant
    two = spark.createDataFrame([(0, 0, 10), (0, 1, 20), (1, 0, 30), (1, 1, 5)], "row_key int, col_key int, observed long")
    n, chi = 65, 65 * (abs(10 * 5 - 20 * 30) - 65 / 2) ** 2 / (30 * 35 * 40 * 25)
    assert X.independence(two).first().chi2 == near(chi) and n
    sparse = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "r string, c string")
    assert sorted(tuple(r) for r in X.contingency(sparse, "r", "c").collect()) == [("a", "x", 2), ("a", "y", 0), ("b", "x", 0), ("b", "y", 1)]


def test_distribution_functions(spark):
    for x, d, p in [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251178, 3, 0.05), (18.307038053275146, 10, 0.05), (0.0, 4, 1.0), (2000.0, 3, 0.0)]:
        assert spark.range(1).select(chi2_sf(F.lit(x), F.lit(d)).alias("p")).first().p == pytest.approx(p, abs=1e-9)
    assert spark.range(1).select(normal_cdf(F.lit(-1.959963984540054)).alias("p")).first().p == pytest.approx(0.025, abs=1e-12)
    assert spark.range(1).select(chi2_sf(F.lit(None).cast("double"), F.lit(2)).alias("p")).first().p is None


def scored(spark, n, ties=False, seed=3):
    rng = random.Random(seed)
    rows = [(i, int(rng.random() < 0.3), rng.random()) for i in range(n)]
    return spark.createDataFrame([(i, y, round(s + 0.3 * y, 1 if ties else 9)) for i, y, s in rows], "key int, y int, score double")


@pytest.mark.parametrize("ties", [False, True])
def test_auc(spark, ties):
    df = scored(spark, 300, ties)
    rows = df.collect()
    pos, neg = ([r.score for r in rows if r.y == k] for k in (1, 0))
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    assert G.auc(df).first().auc == near(want)
    assert G.auc(df.withColumn("y", 1 - F.col("y"))).first().gini == near(1 - 2 * want)
    assert G.accuracy_ratio(df).first().accuracy_ratio == (near(2 * want - 1) if not ties else pytest.approx(2 * want - 1, abs=0.1))
    if not ties:
        rate = len(pos) / 300
        assert G.lorenz_gini_area(df).first().gini_area == pytest.approx((1 - rate) * (2 * want - 1), abs=1e-6)
    curve = [(r.fpr, r.tpr) for r in G.roc(df).orderBy("fpr", "tpr").collect()]
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:]))
    assert curve[0] == (0, 0) and curve[-1] == (1, 1) and area == near(want)


def test_single_class_and_small(spark):
    ones = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.7)], "key int, y int, score double")
    row = G.auc(ones).first()
    assert (row.auc, row.gini) == (0.5, 0.0)
    assert L.lift_table(ones.limit(1)).first().decile == 1
    assert [r.decile for r in L.lift_table(scored(spark, 5)).orderBy("decile").collect()] == [1, 3, 5, 8, 10]
    got = {r.decile: r["count"] for r in L.lift_table(scored(spark, 15)).collect()}
    assert got == {1: 2, 2: 1, 3: 2, 4: 1, 5: 2, 6: 1, 7: 1, 8: 2, 9: 1, 10: 2}
    last = L.lift_table(scored(spark, 91)).orderBy(F.desc("decile")).first()
    assert last.cumulative_lift == near(1.0) and last.cumulative_count == 91


def test_curves(spark):
    df = scored(spark, 97)
    rows = sorted(df.collect(), key=lambda r: (r.score, r.key))
    total = sum(r.y for r in rows)
    want = [(k, (k * 97 // 10) / 97, sum(r.y for r in rows[: k * 97 // 10]) / total) for k in range(11)]
    assert [tuple(r) for r in G.lorenz(df).orderBy("point").collect()] == [pytest.approx(w) for w in want]
    got = {r.share: r.captured for r in G.concentration(df).collect()}
    assert got[0.2] == near(sum(r.y for r in rows[:19]) / total)
    assert len(G.lorenz(df.limit(3)).collect()) == 11
    assert {(r.actual, r.predicted): r.n for r in G.confusion(spark.createDataFrame([(1, 0.5)], "y int, score double")).collect()} == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 1}


def test_running_totals_equal_a_plain_sort(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([0.1, 0.2, rng.random()]), rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, s double, v int").repartition(7)
    for down in (False, True):
        total, want = 0, {}
        for i, s, v in sorted(rows, key=lambda r: (-r[1] if down else r[1], r[0])):
            total += v
            want[i] = (total, len(want) + 1)
        got = running(df, "s", {"t": F.col("v"), "n": F.lit(1)}, tie=["k"], descending=down)
        assert {r.k: (r.t, r.n) for r in got.collect()} == want


def test_impurity(spark):
    rows = [(n, c) for n, (g, b) in enumerate([(200, 0), (150, 50), (100, 100), (0, 200)]) for c in ["g"] * g + ["b"] * b]
    df = spark.createDataFrame(rows, "node int, c string")
    assert column(G.impurity(df, "c", ["node"]), "impurity", "node") == pytest.approx([0, 0.375, 0.5, 0])
    out = G.impurity_reduction(df, "c", "node").first()
    assert out.reduction == near(out.parent - (0 + 0.375 + 0.5 + 0) / 4)
    flat = G.histogram(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v", 5).first()
    assert (flat.bin, flat.n, flat.density) == (0, 2, None)


def test_fit(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 1.0), (1, 0.5)], "y int, score double")
    assert 100 < V.deviance(df).first().deviance < 200
    rate = spark.createDataFrame([(int(i < 285), 0.285) for i in range(1000)], "y int, score double")
    row = V.fit_summary(V.deviance(rate), 1).first()
    assert row.null_deviance == pytest.approx(1195.228, abs=1e-3) and row.mcfadden_r2 == near(0.0)
    row = spark.range(1).select(V.gini_variance(F.lit(0.76), F.lit(715), F.lit(285)).alias("v")).first()
    assert row.v == pytest.approx(0.000937461, abs=1e-9)
    lo, hi = (0.52 + s * 1.959963984540054 * row.v**0.5 for s in (-1, 1))
    assert (lo, hi) == (pytest.approx(0.45999, abs=1e-5), pytest.approx(0.58001, abs=1e-5))
    d = V.gini_difference(F.lit(0.520), F.lit(0.031**2), F.lit(0.548), F.lit(0.029**2))
    row = spark.range(1).select(*(c.alias(k) for k, c in d.items())).first()
    assert (row.z_statistic, row.p_value, row.is_significant, row.verdict) == (pytest.approx(0.6596, abs=1e-4), pytest.approx(0.5095, abs=1e-4), False, "no difference")


def test_calinski(spark):
    row = spark.range(1).select(S.ch_index(F.lit(485230.0), F.lit(1052480.0), F.lit(1000), F.lit(3)).alias("ch")).first()
    assert row.ch == pytest.approx(229.826, abs=1e-3)
    df = spark.createDataFrame([([float(i % 2 * 10), float(i)], i % 2) for i in range(10)], "v array<double>, label int")
    out = S.calinski_harabasz(df, "v", "label").first()
    total = sum((10 * (i % 2) - 5) ** 2 + (i - 4.5) ** 2 for i in range(10))
    assert out.wcss + out.bcss == near(total)
    assert S.calinski_harabasz(df.withColumn("label", F.lit(1)), "v", "label").first().calinski_harabasz is None


def test_markov(spark):
    p = C.project(C.transition_table(spark), C.initial_table(spark)).cache()
    last = p.where("month = 12").orderBy("band").collect()
    assert [r.default_share for r in last] == pytest.approx([0.993964, 0.698455, 0.266706, 0.106410, 0.038913], abs=1e-6)
    assert all(r.current + r.arrears + r.default_share == near(1.0) for r in p.collect())
    assert column(C.deterioration(p), "speed", "band") == pytest.approx([1.6164, 4.4038, 1.8059, 0.7201, 0.2409], abs=1e-4)
    assert [r.band for r in C.deterioration(p).where("is_fastest").collect()] == [2]
    assert column(C.time_to_default(p), "months", "band") == [3, None, None, None, None]
    row = C.provisions(p, C.client_table(spark)).first()
    assert tuple(row) == pytest.approx((803.0, 2362.667482, 1559.667482, 194.230, 15596674.82), abs=1e-2)
    matrix = C.weighted_matrix(C.transition_table(spark), C.client_table(spark)).orderBy("from_state", "to_state").collect()
    assert [r.p for r in matrix] == pytest.approx([0.9261, 0.0599, 0.0140, 0.4098, 0.4841, 0.1061, 0, 0, 1], abs=1e-4)


def test_models(spark):
    rng = random.Random(4)
    rows = [(i, x := rng.random(), rng.choice("ab"), int(rng.random() < 0.2 + 0.6 * x)) for i in range(600)]
    df = M.stratified_split(spark.createDataFrame(rows, "id int, x double, c string, y int"), "y", "id").cache()
    counts = {(r.y, r.is_test): r["count"] for r in df.groupBy("y", "is_test").count().collect()}
    for y in (0, 1):
        assert counts[y, True] == int((counts[y, True] + counts[y, False]) * 0.3)
    model = M.fit_logistic(df.where("NOT is_test"), "y", ["x"], ["c"])
    scored = M.predict(model, df.where("is_test"))
    assert G.auc(scored).first().auc > 0.65
    weights = {r.feature: r.coefficient for r in M.coefficients(model, df).collect()}
    assert weights["x"] > 1 and set(weights) == {"x", "c", "(intercept)"}
    assert M.class_weights(df, "y").agg(F.sum("weight")).first()[0] == near(600.0)
    assert M.intercept_only(df, "y").first().score == near(sum(r[3] for r in rows) / 600)
    share = M.hashed_split(df, "id").where("is_test").count() / 600
    assert 0.2 < share < 0.4


def test_bin_merging(spark):
    stats = bins_of(spark, [(0, 50, 50), (1, 51, 49), (2, 80, 20), (3, 81, 19), (4, 95, 5)])
    merged = {r.bin: r.merged_bin for r in T.chi_merge(stats, 3).collect()}
    assert merged == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert {r.bin: r.merged_bin for r in T.optimal_bins(stats, 3).collect()} == merged


def test_general(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, 2), ("b", None, 1)], "g string, x double, n int")
    d = R.describe(df, ["x"], ["g"]).collect()
    assert [(r.g, r["count"], r["mean"], r.p50) for r in d] == [("a", 2, 2.0, 2.0)]
    assert {r.variable: r.nulls for r in R.null_counts(df).collect()} == {"g": 0, "x": 1, "n": 1}
    assert [tuple(r) for r in R.value_counts(df, "g").collect()] == [("a", 2), ("b", 1)]
    assert R.union_all(df, df, df).count() == 9
    assert R.top_k(df, ["g"], [F.desc("n")], 1).count() == 2


def test_labels(spark):
    rows = spark.createDataFrame([(0.0,), (0.02,), (0.3,), (0.5,), (None,)], "v double")
    assert [r[0] for r in rows.select(labels.label(F.col("v"), labels.IV)).collect()] == ["Not predictive", "Weak", "Strong", "Suspicious (possible overfitting)", None]
    assert [r[0] for r in rows.select(labels.label(F.col("v"), labels.GINI_THREE, True)).collect()] == ["Poor", "Poor", "Poor", "Acceptable", None]


@pytest.mark.parametrize("f", [T.chi_merge, T.optimal_bins])
def test_too_many_fine_bins_are_an_error(spark, f):
    with pytest.raises(ValueError, match="1,000"):
        f(spark.range(1001).selectExpr("cast(id AS int) AS bin", "1L AS goods", "1L AS bads"))


def sf_by_fraction(x, d):
    """The upper tail for whole d by the finite sums that it has."""
    h = x / 2
    if d % 2 == 0:
        return math.fsum(math.exp(k * math.log(h) - h - math.lgamma(k + 1)) for k in range(d // 2))
    return math.erfc(math.sqrt(h)) + math.fsum(math.exp((k - 0.5) * math.log(h) - h - math.lgamma(k + 0.5)) for k in range(1, d // 2 + 1))


@pytest.mark.parametrize(("x", "d"), [(1500.0, 2000), (1500.0, 10), (1500.0, 1), (1400.5, 1400), (2100.0, 2000), (300.0, 7), (80.0, 3), (40.0, 1), (1e-6, 1), (5.0, 6), (10_000.0, 10_001)])
def test_chi2_tail(spark, x, d):
    p = spark.range(1).select(chi2_sf(F.lit(x), F.lit(d)).alias("p")).first().p
    assert p == pytest.approx(sf_by_fraction(x, d), rel=1e-8, abs=1e-300)


def test_counts_beyond_what_products_hold(spark):
    n = 5_000_000_000
    cells = spark.createDataFrame([("a", "x", n), ("a", "y", n), ("b", "x", n), ("b", "y", 2 * n)], "row_key string, col_key string, observed long")
    assert X.independence(cells).first().is_significant
    g = spark.range(1).select(V.gini_variance(F.lit(0.7), F.lit(n), F.lit(n)).alias("v")).first().v
    assert 0 < g < 1e-8
    assert G.impurity(cells, "col_key", weight=F.col("observed")).first().impurity == pytest.approx(1 - (4 + 9) / 25)
    assert spark.range(3).select((F.lit(n) * 1_000_000_000).alias("cum")).agg(G._area("cum").alias("c")).first().c == pytest.approx(1.5e19)


def test_predict_keeps_rows_with_nulls(spark):
    rows = [(i, float(i % 7), None if i % 10 == 3 else float(i), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    scored = M.predict(M.fit_logistic(df, "y", ["a", "b"]), df)
    assert scored.count() == 60 and scored.where("score IS NULL").count() == 6 and scored.where("score IS NULL AND b IS NULL").count() == 6


def test_running_by_ranges_equals_one_window(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["g1", "g1", "g1", None, "g2"]), rng.choice([0.5, 0.5, 0.5, 1.5, None, float("nan"), rng.random()]), rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "key long, g string, score double, x int").repartition(3)
    for by in ([], ["g"]):
        for descending in (False, True):
            args = ("score", {"cum": F.col("x"), "place": F.lit(1)}, by, ["key"], descending)
            one = sorted((r.key, r.cum, r.place) for r in running(df, *args).collect())
            many = sorted((r.key, r.cum, r.place) for r in running(df, *args, rows_per_range=40).collect())
            assert one == many


def test_a_constant_score_is_more_than_one_task(spark):
    df = spark.range(20_000).select(F.col("id").alias("key"), F.lit(0.5).alias("score"))
    out = running(df, "score", {"place": F.lit(1)}, tie=["key"], rows_per_range=1000)
    with_range = out.withColumn("part", F.spark_partition_id())
    assert with_range.select("part").distinct().count() > 1
    assert out.agg(F.max("place"), F.sum("place")).first() == (20_000, 20_000 * 20_001 // 2)
    assert out.where("place <> key + 1").count() == 0


def test_quantiles_by_rank_equal_percentiles(spark):
    df = spark.range(997).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 > 0, F.col("id") * F.col("id") % 101).cast("double").alias("x"))
    shares = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    for by in ([], ["g"]):
        a, b = (sorted((r[:-1], r[-1]) for r in T.quantiles(df, "x", shares, by, m).collect()) for m in ("rank", "percentile"))
        assert [k for k, _ in a] == [k for k, _ in b]
        assert all(x == pytest.approx(y) for (_, x), (_, y) in zip(a, b))


def test_kmeans_finds_planted_clusters(spark):
    rng = random.Random(2)
    rows = [(i, [10.0 * (i % 4) + rng.gauss(0, 0.5), -5.0 * (i % 2) + rng.gauss(0, 0.5)]) for i in range(400)] + [(400, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    sweep = {r.k: r for r in S.k_sweep(df, "v", range(2, 7), range(3)).collect()}
    assert [k for k, r in sweep.items() if r.is_best] == [4]
    out = {r.id: r.cluster for r in S.kmeans(df, "v", 4, (1, 2)).collect()}
    assert out[400] is None and len({(i % 4, c) for i, c in out.items() if i < 400}) == 4
    own = S.calinski_harabasz(S.kmeans(df.where("id < 400"), "v", 4, (1, 2)), "v", "cluster").first().calinski_harabasz
    assert own == pytest.approx(sweep[4].calinski_harabasz, rel=1e-6)


@pytest.mark.parametrize("balanced", [True, False])
def test_logistic_regression_equals_newton(spark, balanced):
    """The fitted coefficients minimise the same weighted, penalised loss as Newton's method finds."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 2))
    y = (rng.random(800) < 1 / (1 + np.exp(-(-1.5 + 1.2 * x[:, 0] - 0.7 * x[:, 1])))).astype(float)
    df = spark.createDataFrame([(i, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "id long, a double, b double, y int")
    found = {r.feature: r.coefficient for r in M.coefficients(M.fit_logistic(df, "y", ["a", "b"], balanced=balanced, scaling="none"), df).collect()}
    weight = np.where(y == 1, 400 / y.sum(), 400 / (800 - y.sum())) if balanced else np.ones(800)
    design, beta = np.column_stack([np.ones(800), x]), np.zeros(3)
    penalty = np.diag([0.0, 1 / 800, 1 / 800])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (weight * (p - y)) / weight.sum() + penalty @ beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design / weight.sum() + penalty
        beta -= np.linalg.solve(hessian, gradient)
    assert [found["(intercept)"], found["a"], found["b"]] == pytest.approx(beta.tolist(), abs=1e-3)


def test_stratified_split_is_exact(spark):
    df = spark.range(10_007).select(F.col("id").alias("key"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    for share in (0.0, 0.3, 0.999):
        rows = {(r.y, r.is_test): r["count"] for r in M.stratified_split(df, "y", "key", share).groupBy("y", "is_test").count().collect()}
        for y, n in ((1, 1430), (0, 8577)):
            assert rows.get((y, True), 0) == math.floor(n * share) and rows.get((y, True), 0) + rows.get((y, False), 0) == n


def test_flows(spark, sf):
    from scoreloom import build_scorecard, evaluate_features, monitor_stability, project_portfolio

    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice", F.dayofyear("o_orderdate").cast("double").alias("day"), "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    assert evaluate_features(orders, ["o_totalprice", "day"], "y").select("variable").distinct().count() == 2
    psi = monitor_stability(orders, ["o_totalprice"], F.col("day") > 180).collect()
    assert len(psi) == 10 and sum(r.production_pct for r in psi) == near(100.0)
    report = build_scorecard(orders, "o_orderkey", "y", ["o_totalprice", "day"], ["o_orderpriority"])
    assert report["scored"].count() > 400 and all(df.count() > 0 for df in report.values())
    assert project_portfolio(spark)["provisions"].first().additional_provisions == pytest.approx(15_596_674.82, abs=0.01)
