"""DeLong's variance and comparison against plain Python over all pairs, and chi-square tests of sparse tables."""

import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import fit as V
from scoreloom.operators import independence as X
from scoreloom.operators import order


def placements(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    over = lambda a, b: 1.0 if a > b else 0.5 if a == b else 0.0
    return [sum(over(p, n) for n in neg) / len(neg) for p in pos], [sum(over(p, n) for p in pos) / len(pos) for n in neg]


def covariance(x, y):
    a, b = sum(x) / len(x), sum(y) / len(y)
    return sum((u - a) * (v - b) for u, v in zip(x, y)) / (len(x) - 1)


def made(n, seed, ties=20):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.35)
        u = rng.gauss(y * 0.8, 1)
        rows.append((i, "ab"[i % 2], y, round(u * ties) / ties, round((u * 0.7 + rng.gauss(y * 0.3, 0.8)) * ties) / ties))
    return rows


SCHEMA = "key long, grp string, y int, s1 double, s2 double"


@pytest.mark.parametrize("ties", [1, 20, 10**6])
def test_delong_against_all_pairs(spark, ties):
    rows = made(300, 3, ties)
    out = V.delong(spark.createDataFrame(rows, SCHEMA), score="s1").first()
    v10, v01 = placements([(r[2], r[3]) for r in rows])
    var = covariance(v10, v10) / len(v10) + covariance(v01, v01) / len(v01)
    assert out.auc == pytest.approx(sum(v10) / len(v10)) and out.variance == pytest.approx(4 * var) and (out.n_pos, out.n_neg) == (len(v10), len(v01))
    assert out.upper - out.lower == pytest.approx(2 * 1.959963984540054 * 2 * var**0.5)


def test_delong_by_group_is_that_of_each_group(spark):
    df = spark.createDataFrame(made(300, 4), SCHEMA)
    for r in V.delong(df, score="s1", by=["grp"]).collect():
        one = V.delong(df.where(F.col("grp") == r.grp), score="s1").first()
        assert (r.auc, r.variance, r.n_pos) == (pytest.approx(one.auc), pytest.approx(one.variance), one.n_pos)


def test_comparison_of_correlated_scores(spark):
    rows = made(300, 5)
    out = V.delong_compare(spark.createDataFrame(rows, SCHEMA), "s1", "s2").first()
    (a10, a01), (b10, b01) = placements([(r[2], r[3]) for r in rows]), placements([(r[2], r[4]) for r in rows])
    cov = lambda x, y: 4 * (covariance(x[0], y[0]) / len(x[0]) + covariance(x[1], y[1]) / len(x[1]))
    a, b = (a10, a01), (b10, b01)
    assert (out.variance_1, out.variance_2, out.covariance) == (pytest.approx(cov(a, a)), pytest.approx(cov(b, b)), pytest.approx(cov(a, b)))
    se = (cov(a, a) + cov(b, b) - 2 * cov(a, b)) ** 0.5
    assert out.standard_error == pytest.approx(se) and out.z_statistic == pytest.approx(out.difference / se)
    assert out.covariance > 0 and out.standard_error < (out.variance_1 + out.variance_2) ** 0.5


def test_comparison_edges(spark):
    rows = made(100, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    same = V.delong_compare(df, "s1", "s1").first()
    assert same.difference == 0 and same.z_statistic is None and same.p_value == 1 and same.verdict == "no difference"
    one = V.delong_compare(df.where("y = 1"), "s1", "s2").first()
    assert one.gini_1 is None and one.n_neg == 0 and one.verdict is None
    assert V.delong_compare(df.limit(0), "s1", "s2").first().n_pos == 0
    gaps = df.withColumn("s2", F.when(F.col("key") % 3 != 0, F.col("s2")))
    a, b = V.delong_compare(gaps, "s1", "s2").first(), V.delong_compare(df.where("key % 3 <> 0"), "s1", "s2").first()
    assert a.n_unscored == 34 and a.p_value == pytest.approx(b.p_value) and a.covariance == pytest.approx(b.covariance)


def test_delong_over_ranges(spark, monkeypatch):
    """Ranks by ranges of distinct scores give the same, in many small tasks."""
    df = spark.createDataFrame(made(400, 7, 10**6), SCHEMA)
    want = V.delong_compare(df, "s1", "s2").first()
    monkeypatch.setattr(order, "ROWS_PER_RANGE", 37)
    monkeypatch.setattr(order.running, "__defaults__", tuple(37 if d == 2_000_000 else d for d in order.running.__defaults__))
    got = V.delong_compare(df, "s1", "s2").first()
    assert got.covariance == pytest.approx(want.covariance) and got.p_value == pytest.approx(want.p_value)


def chi2(cells):
    r, c = {}, {}
    for (i, j), o in cells.items():
        r[i], c[j] = r.get(i, 0) + o, c.get(j, 0) + o
    n = sum(r.values())
    return sum((cells.get((i, j), 0) - r[i] * c[j] / n) ** 2 / (r[i] * c[j] / n) for i in r for j in c), (len(r) - 1) * (len(c) - 1)


def test_sparse_table_equals_the_grid(spark):
    rng = random.Random(8)
    cells = {}
    for _ in range(400):
        k = (rng.choice([None, *"abcdefghij"]), rng.randrange(15))
        cells[k] = cells.get(k, 0) + 1
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "r string, c int")
    out = X.independence(X.counted(df, "r", "c")).first()
    want, dof = chi2(cells)
    assert out.chi2 == pytest.approx(want) and out.df == dof
    grid = X.independence(X.contingency(df, "r", "c")).first()
    assert grid.chi2 == pytest.approx(want) and grid.df == dof


def test_yates_from_totals(spark):
    for cells in ({("a", 0): 12, ("a", 1): 5, ("b", 0): 6, ("b", 1): 9}, {("a", 0): 3, ("b", 1): 4}, {("a", 0): 2, ("a", 1): 2, ("b", 0): 2, ("b", 1): 2}):
        df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "r string, c int")
        full = {(i, j): cells.get((i, j), 0) for i in "ab" for j in (0, 1)}
        n = sum(full.values())
        e = {(i, j): sum(full[i, k] for k in (0, 1)) * sum(full[k, j] for k in "ab") / n for i, j in full}
        want = sum((abs(full[k] - e[k]) - min(0.5, abs(full[k] - e[k]))) ** 2 / e[k] for k in full)
        assert X.independence(X.counted(df, "r", "c")).first().chi2 == pytest.approx(want, abs=1e-9)


def test_large_sparse_table_has_no_grid(spark, monkeypatch):
    """20,000 by 20,000 keys: totals are joined, no cell without rows is made, and the grid is refused."""
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("r"), ((F.col("id") * 7919) % 20_000).alias("c"))
    test = X.independence(X.counted(df, "r", "c"))
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and test.first().df == 19_999**2
    with pytest.raises(ValueError, match="cells"):
        X.contingency(df, "r", "c")
