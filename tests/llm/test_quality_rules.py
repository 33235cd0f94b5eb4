import re

import numpy as np
from pyspark.sql import functions as F

from scoreloom.llm import quality_rules as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(w) - 4):
        places.setdefault(tuple(w[i : i + 5]), []).append(i)
    hit = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    n, r = len(w), len(hit)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, r, n < 10 or 100 * r > 20 * n


def check(spark, docs):
    got = {(r.doc_id, r.text): tuple(r[c] for c in Q.COUNTS) for r in Q.with_counts(docs).collect()}
    assert got == {(r.doc_id, r.text): brute(r.text)[:5] for r in docs.collect()}


def test_counts_equal_brute_force(spark):
    check(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))


def test_counts_of_edge_cases(spark):
    texts = [None, "", " ", "\n\n", "a", "a b c d e a b c d e", "a b c d e f", "x\nx\n x\nx", "é é é é é é", "a\tb\x0bc\x0cd\re", "日本 語 # $", "a\n\na\n\n", "b " * 40_000, " a ", "tail\n", "\x1ca"]
    check(spark, spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, None), (4, "a")], "doc_id long, text string").repartition(3))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in Q.query(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows.keys() == docs.keys()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for i, r in rows.items():
        want = brute(docs[i])
        assert tuple(r[c] for c in Q.COUNTS) == want[:5] and r.base_failed == want[5]
        assert not (r.base_failed and r.kept)
    bad = [rows[i].kept for i, y in labels.items() if y == 0]
    good = [rows[i].kept for i, y in labels.items() if y == 1 and not rows[i].base_failed]
    assert np.mean(bad) < 0.05 and np.mean(good) > 0.98


def test_rules_of_a_known_concept():
    x = np.random.default_rng(0).random((3000, len(Q.FEATURES)))
    bad = (x[:, 1] > 0.8) & (x[:, 3] <= 0.5) | (x[:, 5] > 0.95)
    rules = Q.learn_rules(x, bad)
    found = np.any([r.mask(x) for r in rules], axis=0)
    assert (found == bad).mean() > 0.97
    assert all(1 <= len(r.conditions) <= 3 for r in rules)


def test_no_labels_no_rules(spark):
    x = np.random.default_rng(0).random((50, len(Q.FEATURES)))
    assert Q.learn_rules(x[:0], np.zeros(0, bool)) == Q.learn_rules(x, np.zeros(50, bool)) == Q.learn_rules(x, np.ones(50, bool)) == []
    docs = spark.createDataFrame([(1, "a b c d e f g h i j", 7), (2, None, None), (None, "k " * 30, 1), (3, "1 2 3 4 5 6 7 8 9 10 11", 2)], "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rules = Q.fit(docs, labels)
    assert rules == []
    kept = Q.filter_docs(docs, rules)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert {r.doc_id: r.kept for r in Q.judge(docs, rules).collect()} == {1: True, 2: False, None: False, 3: True}
    assert Q.judge(docs.limit(0), rules).count() == 0


def test_conflicting_and_null_labels_are_left_out(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(5)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (2, 0), (2, 0), (None, 1), (3, 1)], "doc_id long, quality int").withColumn("text", F.lit("no"))
    assert sorted((r.doc_id, r.label) for r in Q.sample_of(labels, docs, "quality", 10).collect()) == [(2, 0), (3, 1)]
    assert Q.sample_of(labels, docs, "quality", 1).count() == 1


def features(text):
    """All features of a text, by plain Python."""
    n, chars, symbols, dup, again, _ = brute(text)
    w = WORD.findall(text or "")
    of = lambda p: len(re.findall(p, text or ""))
    lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
    count = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": again, "n_letters": of("[A-Za-z]"), "n_upper": of("[A-Z]"), "n_bangs": of("!"), "n_digits": of("[0-9]"), "n_bars": of(r"\|"), "n_same_next": sum(a == b for a, b in zip(w, w[1:])), "n_lines": lines}
    return count, {"n_words": float(n)} | {k: count[a] / max(count[b], 1) for k, (a, b) in Q.RATIOS.items()}


def test_verdicts_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = Q.fit(docs, labels)
    assert rules
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in Q.judge(docs, rules).collect():
        count, f = features(texts[r.doc_id])
        assert {c: r[c] for c in count} == count
        rejected = any(all(f[name] > limit if above else f[name] <= limit for name, above, limit in rule.conditions) for rule in rules)
        assert r.kept == (not r.base_failed and not rejected)
