import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import hard_negatives as H


def brute(rows, every, k=10, positives=5, low=30, high=90):
    """Rows (id, label, vector) of integers; anchors are ids divisible by ``every``."""
    rows = sorted({(i, y, tuple(x)) for i, y, x in rows if i is not None and y is not None and x is not None and all(v is not None and abs(v) < float("inf") for v in x)})
    out = []
    dot = lambda a, b: int(sum(u * v for u, v in zip(a, b)))
    for i, y, x in rows:
        if i % every == 0:
            others = [(-dot(x, x2), i2, y2) for i2, y2, x2 in rows if i2 != i]
            for s, p, _ in sorted(r for r in others if r[2] == y)[:positives]:
                fits = sorted((n, j) for n, j, y2 in others if y2 != y and low * -s <= 100 * -n <= high * -s)
                out += [(i, p, r + 1, j, -s, -n) for r, (n, j) in enumerate(fits[:k])]
    return Counter(out)


def mined(spark, rows, every, schema="vec_id long, label int, embedding array<double>, id string, x int, h int", **options):
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], schema).repartition(3)
    return Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, int(r.positive_score), int(r.negative_score)) for r in H.mine(df, F.col("id") % every == 0, **options).collect())


def made(n, d, labels, seed, clusters=0):
    rng = random.Random(seed)
    centres = [[rng.randrange(-40, 41) for _ in range(d)] for _ in range(clusters)]
    point = lambda: [float(rng.randrange(-30, 31)) for _ in range(d)] if not clusters else [float(c + rng.randrange(-4, 5)) for c in rng.choice(centres)]
    return [(i, rng.randrange(labels), point()) for i in range(n)]


@pytest.mark.parametrize("rows", [made(600, 6, 3, 1), made(600, 5, 4, 2, clusters=7), made(500, 1, 2, 3), [(i, i % 3, [float(i % 5), 1.0]) for i in range(400)]], ids=["spread", "clusters", "line", "ties"])
def test_against_brute_force(spark, monkeypatch, rows):
    """Small leaves and blocks, so that bounds and blocks matter."""
    for name, value in (("SAMPLE", 128), ("LEAF_ROWS", 40), ("BLOCK_ROWS", 25)):
        monkeypatch.setattr(H, name, value)
    assert mined(spark, rows, 7) == brute(rows, 7)
    assert mined(spark, rows, 50, k=3, positives=2, low=10, high=80) == brute(rows, 50, 3, 2, 10, 80)


def test_copies_nulls_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", 30)
    rows = made(150, 4, 3, 5) + [(1000 + i, i % 2, [3.0, 4.0, -2.0, 1.0]) for i in range(200)]
    rows += [(2000, None, [1.0] * 4), (None, 1, [1.0] * 4), (2001, 1, None), (2002, 1, [1.0, None, 1.0, 1.0]), (2003, 1, [float("nan")] * 4), (2004, 2, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(2005, 1, []), (2006, 2, [5.0]), (2007, 0, [0.0] * 4), (2100, 1, [0.0] * 4)]
    rows += rows[:40] * 2 + [(10, 0, [9.0, 9.0, 9.0, 9.0]), (10, 1, [9.0, 9.0, 9.0, 8.0]), (20, 2, rows[20][2])]
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_few_rows(spark):
    schema = "vec_id long, label int, embedding array<double>"
    assert H.mine(spark.createDataFrame([], schema), F.col("id") % 2 == 0).collect() == []
    assert H.mine(spark.createDataFrame([(0, 1, [1.0])], schema), F.col("id") % 2 == 0).collect() == []
    assert H.mine(spark.createDataFrame([(1, 1, [1.0]), (3, 1, [1.0])], schema), F.col("id") % 2 == 0).collect() == []
    assert len(H.mine(spark.createDataFrame([(0, 1, [2.0]), (1, 1, [2.0]), (2, 2, [1.0])], schema), F.col("id") == 0).collect()) == 1


def test_text_labels_and_huge_numbers(spark):
    rows = [(i, "ab"[i % 2], [1e200 if i == 3 else float(i), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    assert {r.anchor_id for r in H.mine(df, F.col("id") % 10 == 0).collect()} == {10, 20, 30}


def test_query_equals_sql(spark):
    """At the scale of the correctness check."""
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    df = H.query(spark, sf)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert df.columns == names and [t for _, t in df.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    want = con.sql(H.ORACLE_SQL).select(*names).fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(want) and len(want) > 100


def test_bounds_hold_and_leave_leaves_out():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    centres *= 100 / np.linalg.norm(centres, axis=1)[:, None]  # of one length, as embeddings are
    x = np.floor(centres)[rng.integers(12, size=3000)] + rng.integers(-2, 3, (3000, 8))
    block = H.Block(np.arange(3000), np.zeros(3000, np.int64), np.zeros(3000, np.int64), x, float((x * x).sum(1).max()))
    q = x[:50]
    low, high = block.tree.bounds(q, block.least, block.most)
    scores = block.x @ q.T
    for k, (a, b) in enumerate(zip(block.starts, block.starts[1:])):
        assert (scores[a:b] >= low[:, k]).all() and (scores[a:b] <= high[:, k]).all()
    tenth = -np.sort(-scores, 0)[9]
    assert (high >= tenth[:, None]).mean() < 0.5


def test_no_leaf_is_deep_where_no_distance_parts():
    x = np.eye(1500)
    tree = H.Tree(H.augmented(x, 1.0), 16, 1.0)
    assert tree.depth < 90
