import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scoreloom.llm import near_dedup as N
from scoreloom.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, n):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def brute(docs, n, percent=80):
    sets = [(i, shingles(t, n)) for i, t in docs]
    groups, held = Sets(), defaultdict(list)
    by_set = defaultdict(list)
    for i, s in sets:
        if s and i is not None:
            by_set[s].append(i)
    for ids in by_set.values():
        for i in ids:
            groups.join(ids[0], i)
    reps = [(ids[0], s) for s, ids in by_set.items()]
    for k, (_, s) in enumerate(reps):
        for x in s:
            held[x].append(k)
    common = Counter()
    for ks in held.values():
        for a in range(len(ks)):
            for b in range(a):
                common[ks[b], ks[a]] += 1
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(reps[a][1]) + len(reps[b][1]) - c):
            groups.join(reps[a][0], reps[b][0])
    return [(i, len(s), None if i is None else groups.find(i), i is None or groups.find(i) == i) for i, s in sets]


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = rows(N.query(spark, sf))
    assert got == sorted(brute(docs, 2), key=repr)
    assert sum(not r[3] for r in got) > 50


@pytest.mark.parametrize("n", [1, 2, 5])
def test_chains_and_groups_around_the_threshold(spark, n):
    import random

    rng = random.Random(n)
    docs, i = [], 0
    for g in range(12):
        text = [f"g{g}w{k}" for k in range(rng.choice([8, 30, 60, 200]))]
        for _ in range(rng.choice([2, 15, 30])):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // (9 * n)))):
                copy[rng.randrange(len(copy))] = f"x{rng.random()}"
            if rng.random() < 0.3:
                text = copy
            docs.append((i := i + 1, " ".join(copy)))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(brute(docs, n), key=repr)
    assert rows(N.near_duplicates(df, n)) == want
    # lists and groups of many blocks
    assert rows(N.near_duplicates(df, n, list_block=3, set_block=150)) == want


def test_a_large_group_around_the_threshold(spark):
    """5,000 variants of one text, of which few pairs are similar enough, and as many that one hub holds together."""
    import random

    import numpy as np

    rng = random.Random(3)
    docs = []
    for i in range(5000):
        words = [f"w{k}" for k in range(60)]
        for _ in range(rng.choice([2, 3, 3, 4, 4, 4])):
            words[rng.randrange(60)] = f"v{rng.randrange(40)}"
        docs.append((i, " ".join(words)))
    for i in range(5000, 7000):
        words = [f"u{k}" for k in range(60)]
        for _ in range(2):
            words[rng.randrange(60)] = f"v{rng.random()}"
        docs.append((i, " ".join(words)))
    sets = [shingles(t, 2) for _, t in docs]
    number = {}
    for s in sets:
        for x in s:
            number.setdefault(x, len(number))
    held = Counter(x for s in sets for x in s)
    common = [x for x in number if held[x] > 1]
    column = {x: k for k, x in enumerate(common)}
    marks = np.zeros((len(docs), len(common)), np.float32)
    for k, s in enumerate(sets):
        marks[k, [column[x] for x in s if x in column]] = 1
    size = np.array([len(s) for s in sets], np.float32)
    groups, pairs = Sets(), 0
    for k in range(0, len(docs), 500):
        both = marks[k : k + 500] @ marks.T
        a, b = np.nonzero(100 * both >= 80 * (size[k : k + 500, None] + size - both))
        for i, j in zip((a + k).tolist(), b.tolist()):
            pairs += i < j and j < 5000
            groups.join(docs[i][0], docs[j][0])
    want = [groups.find(i) for i, _ in docs]
    assert pairs > 1000 and len(set(want[:5000])) > 500 and len(set(want[5000:])) == 1
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 2).collect()}
    assert [got[i] for i, _ in docs] == want


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One\ttwo"), (7, "one two"), (None, "one two"), (None, None), (8, "a " * 20_000), (9, "a a a"), (10, "É one"), (11, "é one"), (12, "p q r s"), (12, "x y z"), (13, "x y z"), (13, "k l m"), (14, "k l m")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit(3)).withColumn("sig", F.lit(None).cast("int")).repartition(3)
    want = brute(docs, 2)
    for i, j in ((13, 12), (14, 12)):  # by their ids
        want = [(d, s, j, False) if d == i else (d, s, c, k) for d, s, c, k in want]
    assert rows(N.near_duplicates(df, 2)) == sorted(want, key=repr)
    kept = N.keep_one(df, 2)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((w[0] for w in want if w[3]), key=repr)
    assert rows(N.near_duplicates(df.limit(0), 2)) == []


def test_components(spark):
    import random

    rng = random.Random(5)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(1000, k) for k in range(1001, 1300)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(170)] + [(5, 5)]
    groups = Sets()
    for a, b in pairs:
        groups.join(a, b)
    got = {r.id: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: groups.find(x) for p in pairs if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
