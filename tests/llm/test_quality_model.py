import zlib

import numpy as np

from scoreloom.llm import kernels as K
from scoreloom.llm import quality_model as Q


def test_gradients():
    rng = np.random.default_rng(3)
    bag = np.array([0, 2, 2, 5, 9, 12])
    x, y = rng.normal(size=(12, Q.WIDTH)), np.array([1.0, 0, 1, 0, 1])
    one = Q.train(x, bag, y, steps=1, rate=1e-3, decay=0)
    loss = lambda m: -np.mean(np.where(y == 1, np.log(m.score(x, bag)), np.log(1 - m.score(x, bag))))
    more = Q.train(x, bag, y, steps=40, rate=1e-2, decay=0)
    assert loss(more) < loss(one) < loss(Q.train(x, bag, y, steps=0)) + 1e-12


def test_attention_sums_to_one_and_finds_the_passage_that_decides():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400 * 5, Q.WIDTH)) * 0.3
    bag = np.arange(0, 2001, 5)
    y = (rng.random(400) < 0.5).astype(float)
    spot = bag[:-1] + rng.integers(0, 5, 400)
    x[spot[y == 0], 0] += 4
    m = Q.train(x, bag, y)
    a = m.attention(x, bag)
    assert np.allclose(np.add.reduceat(a, bag[:-1]), 1)
    assert ((m.score(x, bag) > 0.5) == y).mean() > 0.97
    assert a[spot[y == 0]].mean() > 0.4


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in Q.query(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    unseen = [(rows[i].predicted, y) for i, y in labels.items() if rows[i].held_out]
    assert len(unseen) > 50 and np.mean([p == y for p, y in unseen]) > 0.95


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", None), (2, "", None), (None, "a b", 1.0), (3, "w " * 50_000, 2.0), (4, " \n ", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    rows = Q.score(docs, model).collect()
    assert len(rows) == 6 and all(r.score == 0.5 for r in rows)
    assert {r.doc_id: r.n_passages for r in rows} == {1: 0, 2: 0, None: 1, 3: 782, 4: 0}
    assert Q.score(docs.limit(0), model).count() == 0


def test_encoding_does_not_depend_on_the_block():
    texts = ["alpha beta", "", "x " * 300, "été | ### !!"]
    whole = Q.encode(*pack(texts))
    for i, t in enumerate(texts):
        x, bag = Q.encode(*pack([t]))
        assert np.allclose(x, whole[0][whole[1][i] : whole[1][i + 1]])


def pack(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    return data, np.cumsum([0, *(len(t.encode()) for t in texts)])


def test_word_hashes_are_the_same_everywhere():
    data, offsets = pack(["abc xyz", "xyz abc"])
    s, e, _ = K.spans(data, offsets, K.NOT_SPACE)
    h = K.hashes(data, s, e)
    assert h[0] == h[3] and h[1] == h[2] and h[0] != h[1]


def brute_score(model, text):
    """The score of one text in plain Python, from the fitted weights."""
    import math
    import re

    mask = 2**64 - 1

    def mixed(h):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> shift) * factor & mask
        return h ^ h >> 31

    def hashed(word):
        total = sum((c + 32 * (65 <= c <= 90) + 1) * int(f) for c, f in zip(word, K._FACTORS)) & mask
        return mixed((total + len(word) * 0xA0761D6478BD642F) & mask)

    data = (text or "").encode()
    spots = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    w, states = {k: v.tolist() for k, v in model.weights.items()}, []
    for at in range(0, len(spots), Q.PASSAGE):
        own = spots[at : at + Q.PASSAGE]
        words, piece, n = [data[a:b] for a, b in own], data[own[0][0] : own[-1][1]], len(own)
        chars = sum(map(len, words))
        x = [sum(bool(members[c]) for c in piece) / chars for members in Q._SHAPE.values()]
        x += [chars / n / 10, math.log1p(n) / math.log1p(Q.PASSAGE), sum(len(y) == 1 for y in words) / n]
        codes = [hashed(y) for y in words]
        x += [sum(a == b for a, b in zip(codes, codes[lag:])) / n for lag in Q._LAGS]
        bag = [0.0] * Q.HASHED
        for h in codes:
            bag[(h >> 40) % Q.HASHED] += -1.0 if h >> 8 & 1 else 1.0
        x += [v / math.sqrt(n) / 4 for v in bag]
        x = [(v - s) * c for v, s, c in zip(x, model.shift.tolist(), model.scale.tolist())]
        h = [math.tanh(sum(v * row[j] for v, row in zip(x, w["enc"])) + w["enc0"][j]) for j in range(Q.EMBED)]
        gate = [math.tanh(sum(v * r[j] for v, r in zip(h, w["tan"]))) / (1 + math.exp(-sum(v * r[j] for v, r in zip(h, w["sig"])))) for j in range(Q.GATE)]
        states.append((math.exp(min(30, max(-30, sum(v * c for v, c in zip(gate, w["att"]))))), h))
    total = sum(e for e, _ in states)
    z = [sum(e * h[j] for e, h in states) / total if states else 0.0 for j in range(Q.EMBED)]
    return 1 / (1 + math.exp(-min(30, max(-30, sum(v * c for v, c in zip(z, w["out"])) + w["out0"][0]))))


def test_scores_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(docs, labels)
    more = [(10**6 + k, t) for k, t in enumerate([None, "", "one", "é | ### !!", "UPPER lower upper LOWER " * 40, "a b a b " * 33, "\x0b tab\tand\nline"])]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in both.collect()}
    got = {r.doc_id: r.score for r in Q.score(both, model).collect()}
    assert got.keys() == texts.keys()
    off = {i: (got[i], brute_score(model, t)) for i, t in texts.items()}
    assert all(abs(a - b) < 1e-4 for a, b in off.values()), [x for x in off.items() if abs(x[1][0] - x[1][1]) >= 1e-4][:3]


def test_training_bound_leaves_long_documents_out(spark, monkeypatch):
    """A labelled document of more passages than the bound is not trained on, the others are, and all are scored."""
    docs = spark.createDataFrame([(k, f"word{k} " * 70) for k in range(40)] + [(1000, "long text here " * 20_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(1000, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q, "train", lambda x, bag, y, **o: seen.append((len(x), len(y))) or Q.Model(np.zeros(Q.WIDTH), np.ones(Q.WIDTH), {}))
    trained = [k for k in [*range(40), 1000] if zlib.crc32(str(k).encode()) % 4 != 2]
    Q.fit(docs, labels, most_passages=200)
    Q.fit(docs, labels)
    Q.fit(docs, labels, most_labelled=10)
    short = [k for k in trained if k < 1000]
    assert seen[0] == (2 * len(short), len(short))
    assert seen[1][1] == len(trained) and seen[2][1] == 10
