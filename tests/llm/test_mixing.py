import hashlib
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scoreloom.llm import mixing as M


def draw(mean, doc, seed=0):
    u = int(hashlib.md5(f"{seed}:{doc}".encode()).hexdigest()[:13], 16) / 2**52
    return sum(p <= u for p in M.poisson_terms(mean))


@pytest.mark.parametrize("mean", [0.05, 1.0, 7.3, 1500.0])
def test_poisson(spark, mean):
    steps = spark.range(1).select(M.poisson_steps(F.lit(mean)).alias("p")).first().p
    assert len(steps) == len(M.poisson_terms(mean)) and max(abs(a - b) for a, b in zip(steps, M.poisson_terms(mean))) < 1e-12
    assert abs(steps[-1] - 1) < 1e-9
    n = [draw(mean, d) for d in range(1000 if mean < 100 else 100)]
    assert abs(sum(n) / len(n) - mean) < 5 * (mean / len(n)) ** 0.5


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    out = M.query(spark, sf)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "order_key"]
    rows = out.withColumn("part", F.spark_partition_id()).toPandas()
    size = docs.text.str.len().groupby(docs.source).sum()
    rate = {s: w / (sum(M.SHARES.values()) + M.OTHERS) * size.sum() / size[s] for s, w in M.SHARES.items()}
    got = Counter(rows.doc_id)
    assert all(got[d] == draw(rate[s], d) for d, s in docs.source.items())
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in rows.groupby("doc_id")["copy"].apply(list))
    assert rows.sort_values(["part", "order_key"]).order_key.is_monotonic_increasing


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "aaaa", "a"), (2, None, "a"), (3, "", "b"), (4, "bb", None), (None, "cc", "c"), (5, "x" * 100_000, "z"), (1, "aaaa", "a")], "doc_id long, text string, source string").withColumn("copy", F.lit("old")).withColumn("__g", F.lit(1)).drop("__g")
    out = M.mix(docs, {"a": 1.0, "b": 1.0}, others=1.0, epochs=3.0, unit="docs")
    assert out.columns == ["doc_id", "text", "source", "copy", "order_key"]
    got = Counter(r.doc_id for r in out.collect())
    # 3 groups of a third of 21 rows: a has 3 documents, b one, the others 3
    assert got[1] == 2 * draw(7 / 3, 1) and got[2] == draw(7 / 3, 2) and got[3] == draw(7.0, 3) and got[4] == draw(7 / 3, 4)
    assert got[None] == draw(7 / 3, "text " + hashlib.md5(b"cc").hexdigest())
    clash = docs.withColumn("__g", F.lit(1)).withColumn("__drawn", F.lit(2)).withColumn("__steps", F.lit(3))
    out = M.mix(clash, {"a": 1.0, "b": 1.0}, others=1.0, epochs=3.0, unit="docs")
    assert out.columns == ["doc_id", "text", "source", "__g", "__drawn", "__steps", "copy", "order_key"] and {r["__drawn"] for r in out.collect()} == {2}
    assert M.mix(docs, {"b": 1.0}).count() == 0  # no chars in b
    assert M.mix(docs.limit(0), {"a": 1.0}).count() == 0
    with pytest.raises(ValueError):
        M.mix(docs, {"a": -1.0})
    with pytest.raises(ValueError):
        M.mix(docs, {})


def test_python_is_not_used(spark):
    plan = M.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_large_means(spark):
    """A mean above MOST_MEAN is a sum of draws; the time of a draw does not grow with the square of the mean."""
    docs = spark.createDataFrame([(i, "x", "a") for i in range(40)], "doc_id long, text string, source string")

    def counts(mean):
        began = time.perf_counter()
        got = M.mix(docs, {"a": 1.0}, epochs=mean, unit="docs").groupBy("doc_id").count().collect()
        return [r["count"] for r in got], time.perf_counter() - began

    counts(10.0)
    for mean in (1200.0, 8000.0):
        n, _ = counts(mean)
        assert len(n) == 40 and abs(sum(n) / 40 - mean) < 5 * (mean / 40) ** 0.5
        spread = sum((x - mean) ** 2 for x in n) / 40
        assert 0.3 * mean < spread < 2.5 * mean
    parts = [sum(sum(p <= int(hashlib.md5(f"0:{i}:part:{k}".encode()).hexdigest()[:13], 16) / 2**52 for p in M.poisson_terms(400.0)) for k in (1, 2, 3)) for i in range(40)]
    assert sorted(counts(1200.0)[0]) == sorted(parts)
    assert min(counts(32_000.0)[1] for _ in range(2)) < 4 * 2.6 * max(0.5, min(counts(8000.0)[1] for _ in range(2)))
