import hashlib
import re

import pytest
from pyspark.sql import functions as F

from scoreloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    text = text or ""
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        for k in range(max(1, len(w) - 12)):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    lengths = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))):
                    found |= x
                    hit[k : k + n] = [True] * n
        h = sum(hit)
        out.append((d, len(w), h, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), h > 0 and 20 * h >= len(w)))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


def test_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = rows(D.query(spark, sf))
    assert got == sorted(brute(docs, items), key=repr)
    assert sum(r[5] for r in got) > 0


@pytest.mark.parametrize("block_words", [4_000_000, 30])
def test_edge_cases(spark, block_words):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (2, "Alpha BETA gamma"), (3, None), (4, ""), (5, "one"), (None, "zzz"), (6, "same " * 20), (1, long), (7, " ".join(f"w{i}" for i in range(5, 18)))]
    docs = [(1, None), (2, ""), (3, "x " + " ".join(f"w{i}" for i in range(3, 30)) + " y"), (4, "alpha, beta! GAMMA delta one"), (5, "same " * 15), (6, "alpha beta"), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (None, "one"), (8, "gamma"), (9, "é" * 5 + " one " + "b " * 30_000), (10, " ".join(f"W{i}" for i in range(12))), (11, "alpha"), (12, "beta gamma")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit(5)).withColumn("item_ids", F.lit("x")).repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert rows(D.overlap(d, b, block_words=block_words)) == sorted(brute(docs, items), key=repr)
    kept = D.decontaminate(d, b, block_words=block_words)
    assert kept.columns == d.columns
    clean = [r[0] for r in brute(docs, items) if not r[5]]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(clean, key=repr)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert rows(D.overlap(d, b)) == sorted(brute([(1, "a b")], []))
    assert rows(D.overlap(d.limit(0), b)) == []
