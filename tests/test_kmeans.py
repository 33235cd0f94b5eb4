"""Seeding over all rows, assignment with bounds, and models that are given their starts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import segments as S
from scoreloom.operators.once import once


def clouds(n, k, d, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, d)) * 5
    return centres[rng.integers(k, size=n)] + rng.normal(size=(n, d)) * spread


@pytest.mark.parametrize("k", [3, 16, 60])
def test_bounds_find_the_same_centres(k):
    x = clouds(3000, k, 6, k)
    centres = x[np.random.default_rng(1).choice(len(x), k, replace=False)]
    centres[-1] = centres[0]  # of equal centres the first
    work = []
    near, d = S.nearest(x, centres, work)
    whole = S._squared(x, centres)
    assert (near == whole.argmin(1)).all() and np.allclose(d, whole.min(1), atol=1e-8)
    # centres that lie apart, as fitted ones do: most distances are left out
    apart = np.random.default_rng(k).normal(size=(k, 6)) * 5
    x, work = apart[np.random.default_rng(2).integers(k, size=3000)] + np.random.default_rng(3).normal(size=(3000, 6)) * 0.2, []
    assert (S.nearest(x, apart, work)[0] == S._squared(x, apart).argmin(1)).all()
    if k == 60:
        assert work[0] < 0.6 * 3000 * k


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartition(3)


def test_seeding_costs_no_more_than_a_sample_would(spark):
    """A few rows far from all others are found as starts, which an even sample of a few rows misses."""
    x = np.concatenate([clouds(2000, 3, 4, 3), clouds(12, 4, 4, 4) + 100])
    df = frame(spark, x)
    rows = once(df.select(F.col("v").alias("x")))
    found = S.seeding(rows, [1, 2], 7)
    for s in (1, 2):
        points, weights = found[s]
        assert weights.sum() == len(x) and len(points) == len(np.unique(points, axis=0)) <= 1 + 5 * 14
        assert (points.min(1) > 50).any()
    fitted = S.fit_kmeans(df, "v", [(7, 1), (7, 2)])
    assert min(c for _, c in fitted) < 1.3 * 2012 * 4 * 0.04


def test_copies_are_one_candidate(spark):
    x = np.concatenate([np.ones((3000, 2)), np.array([[5.0, 5.0]] * 3), np.array([[9.0, 1.0]])])
    points, weights = S.seeding(once(frame(spark, x).select(F.col("v").alias("x"))), [3], 4)[3]
    assert sorted(map(tuple, points.tolist())) == [(1.0, 1.0), (5.0, 5.0), (9.0, 1.0)] and sorted(weights) == [1, 3, 3000]
    centres, cost = S.fit_kmeans(frame(spark, x), "v", [(3, 3)])[0]
    assert cost == 0 and len(centres) == 3


def test_given_starts_and_assignment(spark):
    df = frame(spark, np.array([[0.0], [1.0], [9.0], [10.0]])).union(spark.createDataFrame([(9, None)], "id int, v array<double>"))
    (centres, cost), = S.fit_kmeans(df, "v", [(2, 0)], starts=[np.array([[0.0], [1.0]])])
    assert sorted(centres.reshape(-1)) == [0.5, 9.5] and cost == pytest.approx(1.0)
    out = {r.id: (r.cluster, r.d) for r in S.assign(df, "v", centres, squared="d").collect()}
    assert out[0] == out[1] and out[0][1] == pytest.approx(0.25) and out[9] == (None, None)
    assert [tuple(r.centre) for r in S.centre_table(df, centres).orderBy("cluster").collect()] == [tuple(c) for c in centres]
    with pytest.raises(ValueError, match="no rows"):
        S.fit_kmeans(df.where("v IS NULL"), "v", [(2, 0)])


def test_moves_until_the_centres_are_means(spark):
    """Eight centres that start at one end of a line take more than a hundred moves to spread over it."""
    x = (np.arange(1000) / 1000)[:, None]
    (centres, cost), = S.fit_kmeans(frame(spark, x), "v", [(8, 0)], starts=[x[:8]])
    near, d = S.nearest(x, centres)
    assert max(abs(x[near == j].mean() - centres[j, 0]) for j in range(8)) <= 1e-6 and cost == pytest.approx(d.sum())


def test_ends_where_rounding_alone_moves_centres(spark, monkeypatch):
    """A tolerance below what rounding leaves in a mean, with passes that are never quite alike, ends where a clustering comes back."""
    rng, whole = np.random.default_rng(0), S._matrix
    monkeypatch.setattr(S, "_matrix", lambda column: whole(column) * (1 + 1e-13 * np.random.default_rng().normal()))
    x = np.concatenate([rng.normal(size=(50, 2)), rng.normal(size=(50, 2)) + 9])
    (centres, _), = S.fit_kmeans(frame(spark, x), "v", [(2, 0)], tolerance=0.0, starts=[x[[0, 99]]])
    assert np.allclose(sorted(centres.tolist()), sorted([x[:50].mean(0).tolist(), x[50:].mean(0).tolist()]))


def lloyd(x, c):
    while True:
        near = S.nearest(x, c)[0]
        new = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        if np.abs(new - c).max() <= 1e-9:
            return c, S.nearest(x, c)[1].sum()
        c = new


@pytest.mark.parametrize("packed", [False, True])
def test_models_side_by_side_end_where_each_would_alone(spark, monkeypatch, packed):
    """Several models of few centres and some of many, over blocks of a few rows; sums of many tasks are added up in tasks."""
    if packed:
        monkeypatch.setattr(S, "BLOCK_BYTES", 7 * 8 * 5)
        monkeypatch.setattr(S, "SUMS_BYTES", 0)
    x = clouds(700, 9, 5, 6, 1.5)
    starts = [x[np.random.default_rng(i).choice(len(x), k, replace=False)] for i, k in enumerate((2, 3, 17, 3, 17, 2, 7, 1))]
    starts.append(np.concatenate([x[:2], np.full((1, 5), 1e3)]))  # a centre without rows stays where it is
    found = S.fit_kmeans(frame(spark, x), "v", [(len(c), 0) for c in starts], tolerance=1e-9, starts=starts)
    for (centres, cost), start in zip(found, starts):
        want, least = lloyd(x, start)
        assert np.allclose(centres, want, atol=1e-8) and cost == pytest.approx(least)


def test_a_pass_is_one_stage(spark):
    """Passes are many, so each is one job of one stage over rows that are packed already, whatever their number of models."""
    x = clouds(400, 4, 3, 8, 1.0)
    df, sc = frame(spark, x), spark.sparkContext

    def stages(moves):
        sc.setJobGroup(f"moves {moves}", "")
        S.fit_kmeans(df, "v", [(4, 0), (3, 0)], max_iter=moves, tolerance=0.0, starts=[x[:4], x[:3]])
        sc.setLocalProperty("spark.jobGroup.id", None)
        jobs = sc.statusTracker().getJobIdsForGroup(f"moves {moves}")
        return sum(len(sc.statusTracker().getJobInfo(j).stageIds) for j in jobs)

    assert stages(4) - stages(1) == 3
