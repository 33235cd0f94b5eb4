"""Constrained binning against enumeration, best splits against all cuts, and sketches against exact ranks."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import binning as B
from scoreloom.operators import discrimination as G


def iv(runs):
    g, b = sum(x for x, _ in runs) or 1, sum(y for _, y in runs) or 1
    parts = [(x / g, y / b) for x, y in runs]
    woe = [math.log(max(p, 1e-4) / max(q, 1e-4)) for p, q in parts]
    return sum((p - q) * w for (p, q), w in zip(parts, woe)), woe


def enumerated(fine, n, least, monotone):
    best = -1.0
    total = sum(x + y for x, y in fine)
    for k in range(n):
        for cuts in itertools.combinations(range(1, len(fine)), k):
            edges = [0, *cuts, len(fine)]
            runs = [(sum(x for x, _ in fine[a:b]), sum(y for _, y in fine[a:b])) for a, b in zip(edges, edges[1:])]
            if any(x + y < least * total - 1e-9 for x, y in runs):
                continue
            value, woe = iv(runs)
            rising, falling = (all(s * a <= s * b + 1e-12 for a, b in zip(woe, woe[1:])) for s in (1, -1))
            if monotone is None or monotone == "rising" and rising or monotone == "falling" and falling or monotone == "either" and (rising or falling):
                best = max(best, value)
    return best


@pytest.mark.parametrize("monotone", [None, "rising", "falling", "either"])
@pytest.mark.parametrize("least", [0.0, 0.15])
def test_equals_enumeration(spark, monotone, least):
    rng = random.Random(9)
    tables = {f"v{t}": [(rng.randrange(0, 12), rng.randrange(0, 9)) for _ in range(rng.randrange(1, 10))] for t in range(25)}
    tables = {k: v for k, v in tables.items() if sum(map(sum, v))}
    df = spark.createDataFrame([(k, i, *x) for k, v in tables.items() for i, x in enumerate(v)] + [("v0", None, 3, 3)], "variable string, bin int, goods long, bads long")
    out = {}
    for r in B.optimal_binning(df, 4, ["variable"], least, monotone).collect():
        out.setdefault(r.variable, {})[r.bin] = r.merged_bin
    for k, v in tables.items():
        runs = {}
        for i, x in enumerate(v):
            runs.setdefault(out[k][i], []).append(x)
        got, woe = iv([(sum(a for a, _ in r), sum(b for _, b in r)) for r in runs.values()])
        want = enumerated(v, 4, least, monotone)
        assert got == pytest.approx(want if want >= 0 else got, abs=1e-9), (k, v)
        assert len(runs) <= 4 and (want >= 0 or len(runs) == 1)


def test_many_fine_bins_and_one_table(spark):
    rng = np.random.default_rng(1)
    goods, bads = rng.poisson(3, 20_000), rng.poisson(1 + 2 * np.sin(np.arange(20_000) / 3000) ** 2)
    began = time.process_time()
    starts = B._free(goods.astype(float), bads.astype(float), 5, 0.05)
    assert time.process_time() - began < 60 and len(starts) == 5
    df = spark.createDataFrame([(i, int(g), int(b)) for i, (g, b) in enumerate(zip(goods[:1500], bads[:1500]))], "bin int, goods long, bads long")
    out = B.optimal_binning(df, 4, least_share=0.1, monotone="either").collect()
    share = np.array([(goods[:1500] + bads[:1500])[[r.bin for r in out if r.merged_bin == m]].sum() for m in sorted({r.merged_bin for r in out})]) / (goods[:1500] + bads[:1500]).sum()
    assert len(out) == 1500 and (share >= 0.1).all()
    with pytest.raises(Exception, match="fine bins"):
        B.optimal_binning(spark.range(B.MOST_MONOTONE + 1).selectExpr("id AS bin", "1L AS goods", "1L AS bads"), monotone="rising").collect()


def test_best_splits_against_all_cuts(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xyz"), float(rng.randrange(12)), rng.random() if rng.random() < 0.9 else None, 1.0) for _ in range(300)] + [(None, 1.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "c string, a double, b double, one double")
    out = {r.variable: r for r in B.best_splits(df, ["a", "b", "one"], "c").collect()}
    assert set(out) == {"a", "b"}

    def gini(own):
        return 1 - sum((own.count(c) / len(own)) ** 2 for c in set(own)) if own else 0

    for name, k in (("a", 1), ("b", 2)):
        own = [(r[k], r[0]) for r in rows if r[k] is not None and r[0] is not None]
        cuts = []
        for t in sorted({x for x, _ in own})[:-1]:
            left, right = [c for x, c in own if x <= t], [c for x, c in own if x > t]
            cuts.append((round(gini([c for _, c in own]) - (len(left) * gini(left) + len(right) * gini(right)) / len(own), 12), -t, len(left)))
        best = max(cuts)
        assert (out[name].reduction, out[name].threshold, out[name].n_left) == (pytest.approx(best[0]), -best[1], best[2])
    assert sorted(r.place for r in out.values()) == [1, 2]
    # the reduction is that of the two-way split by the threshold
    both = df.where("c IS NOT NULL AND a IS NOT NULL").withColumn("left", F.col("a") <= out["a"].threshold)
    assert G.impurity_reduction(both, "c", "left").first().reduction == pytest.approx(out["a"].reduction)


def test_sketches_merge(spark):
    df = spark.range(20_000).select((F.col("id") % 5).alias("day"), F.when(F.col("id") % 50 != 0, F.sqrt(F.pmod(F.xxhash64("id"), F.lit(100_000)))).alias("x"))
    days = B.sketch_quantiles(df, "x", ["day"])
    merged = B.merged_sketches(days)
    edges = B.sketch_edges(merged, 10).first().edges
    values = np.sort([r.x for r in df.where("x IS NOT NULL").select("x").collect()])
    assert merged.first().n == len(values) and len(edges) == 11
    for k, e in enumerate(edges):
        low, high = np.searchsorted(values, e, "left") / len(values), np.searchsorted(values, e, "right") / len(values)
        assert low - B.rank_error(400) <= k / 10 <= high + B.rank_error(400)


def chi2(a, b):
    n, det = sum(a) + sum(b), a[0] * b[1] - a[1] * b[0]
    under = sum(a) * sum(b) * (a[0] + b[0]) * (a[1] + b[1])
    return n * det * det / under if under else 0.0


def rounds(fine, last):
    """The rounds of chi_merge_rounds in plain Python: [lowest bin, goods, bads]."""
    import xxhash

    def hashed(p):
        h = xxhash.xxh64_intdigest(p.to_bytes(8, "little"), seed=42)
        return h - 2**64 if h >= 2**63 else h

    rows = [list(x) for x in fine]
    while len(rows) > last:
        key = [None] + [(chi2(a[1:], b[1:]), hashed(p)) for p, (a, b) in enumerate(zip(rows, rows[1:]), 1)]
        merge = [k > 0 and (k == 1 or key[k] < key[k - 1]) and (k + 1 == len(rows) or key[k] < key[k + 1]) for k in range(len(rows))]
        out = []
        for row, m in zip(rows, merge):
            if m:
                out[-1][1] += row[1]
                out[-1][2] += row[2]
            else:
                out.append(list(row))
        rows = out
    return rows


def plain(rows, most, critical=3.841458820694124):
    rows = [list(x) for x in rows]
    while len(rows) > 1:
        values = [chi2(a[1:], b[1:]) for a, b in zip(rows, rows[1:])]
        k = values.index(min(values))
        if len(rows) <= most and values[k] >= critical:
            break
        rows[k : k + 2] = [[rows[k][0], rows[k][1] + rows[k + 1][1], rows[k][2] + rows[k + 1][2]]]
    return rows


@pytest.mark.parametrize("block", [7, 100_000])
def test_chi_merge_rounds_against_plain_python(spark, block):
    rng = random.Random(5)
    fine = []
    for i in range(900):
        n = rng.randrange(1, 4)
        bads = sum(rng.random() < (0.1 if i < 300 else 0.5 if i < 600 else 0.25) for _ in range(n))
        fine.append((i * 0.5, n - bads, bads))
    df = spark.createDataFrame([*fine, (None, 3, 4)], "bin double, goods long, bads long").repartition(3)
    got = B.chi_merge_rounds(df, 5, last=60, block=block).collect()
    want = plain(rounds(fine, 60), 5)
    assert sorted({r.merged_bin for r in got}) == [x[0] for x in want] and len(got) == 900
    # the three regimes are found
    assert len(want) <= 5 and all(any(abs(x[0] - edge) < 12 for x in want) for edge in (150.0, 300.0))
    # up to ``last`` bins it is the plain loop
    few = B.chi_merge_rounds(df.where("bin < 40"), 3, block=block).collect()
    assert sorted({r.merged_bin for r in few}) == [x[0] for x in plain(fine[:80], 3)]
