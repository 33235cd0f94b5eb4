"""Matrices and starts estimated from events against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import markov as C


def test_estimates_against_plain_python(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(12), t, rng.choice([0, 0, 0, 1, 1, 2]), t % 3) for t in range(300)] + [(None, 5, 1, 1), (3, 6, None, 1)]
    df = spark.createDataFrame(rows, "e int, t int, s int, b int")
    own = (df, "e", F.col("b"), F.col("s"), ["t"])
    steps, last = Counter(), {}
    by = defaultdict(list)
    for e, t, s, b in sorted(r for r in rows if r[0] is not None and r[2] is not None):
        by[e].append((s, b))
    for seq in by.values():
        for (s, b), (s2, _) in zip(seq, seq[1:]):
            steps[b, s, s2] += 1
    for e, seq in by.items():
        last[e] = seq[-1]
    got = {(r.band, r.from_state, r.to_state): r.p for r in C.observed_transitions(*own).collect()}
    assert len(got) == 27
    for b in range(3):
        for i in range(2):
            n = sum(steps[b, i, j] for j in range(3))
            for j in range(3):
                assert got[b, i, j] == pytest.approx(steps[b, i, j] / n)
        assert [got[b, 2, j] for j in range(3)] == [0, 0, 1]
    start, clients = C.observed_start(*own)
    want = Counter(b for _, b in last.values())
    assert {r.band: r.clients for r in clients.collect()} == want
    assert {(r.band, r.state): r.p for r in start.collect()} == {(b, i): pytest.approx(sum(x == (i, b) for x in last.values()) / want[b]) for b in want for i in range(3)}
    held = C.project(C.observed_transitions(*own), start, 6)
    assert all(r.current + r.arrears + r.default_share == pytest.approx(1) for r in held.collect())


def test_a_state_never_left(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (2, 1, 2)], "e int, t int, s int")
    got = {(r.from_state, r.to_state): r.p for r in C.observed_transitions(df, "e", F.lit(1), F.col("s"), ["t"]).collect()}
    assert got[0, 0] == 1 and got[1, 1] == 1 and got[2, 2] == 1 and sum(got.values()) == 3
    assert C.observed_transitions(df.limit(0), "e", F.lit(1), F.col("s"), ["t"]).collect() == []
