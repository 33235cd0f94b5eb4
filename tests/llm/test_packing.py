import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from scoreloom.llm import encoders, packing

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return encoders.ByteLevel.from_file(FILE, specials=True)


def brute(texts, room):
    """(position, piece) to (start, length, crc) of every piece."""
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(FILE), {}
    for k, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % room or room
        starts = [0, *range(first, len(ids), room)]
        for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            out[k, n] = a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))
    return out


def whole(rows, room):
    """Every sequence is filled from 0 without gaps, within its room; the number of sequences."""
    own = defaultdict(list)
    for r in rows:
        own[r.sequence_id].append((r.offset, r.length))
    for places in own.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    return len(own)


def test_same_ids_as_the_file_gives(vocabulary):
    rng = random.Random(5)
    chars = [chr(c) for c in range(0x240)]
    texts = [f for c in chars for f in (f"a{c}b", f" {c} ", f"1{c}2", f"{c}{c} {c}x", f"  {c}'s", f"\n{c}\t{c}")]
    texts += ["".join(rng.choices(chars, k=rng.randrange(1, 60))) for _ in range(3000)]
    texts += ["".join(rng.choices(" \t\n\r\x0b\x0c\x85\xa0a1'-\x1c\x1fsté", k=rng.randrange(1, 40))) for _ in range(3000)]
    texts += ["日本語 テキスト", "привет мир", "ɀ x", "", "<|endoftext|>", "a <|endoftext|>b", " " * 30_000 + "x"]
    for specials in (True, False):
        v = encoders.ByteLevel(vocabulary.content, specials).worker()
        assert v.fast is not None
        for t in texts:
            ids = v.encode(t)
            assert ids == v.exact.encode(t, add_special_tokens=False).ids
            assert v.joined(ids) == t.encode()


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = packing.query(spark, sf).collect()
    want = {(docs[k].doc_id, n): v for (k, n), v in brute([d.text for d in docs], 1024).items()}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    total = sum(r.length for r in rows)
    least = max(-(-total // 1024), sum(r.length > 512 for r in rows))
    assert least <= whole(rows, 1024) <= 1.03 * least + 1


def test_edges_and_small_rooms(spark, vocabulary):
    texts = [None, "", "a", "a", "word " * 40, "<|endoftext|>", "x" * 300, "Größe 日本"] * 3
    docs = spark.createDataFrame([(None if k == 2 else k // 2, t, 1, 1, 1) for k, t in enumerate(texts)], "doc_id long, text string, piece int, sequence_id int, task int").repartition(3)
    for room in (1, 7, 16, 1024):
        rows = packing.pack_docs(docs, vocabulary, room).collect()
        want = Counter((None if k == 2 else k // 2, n, *v) for (k, n), v in brute(texts, room).items())
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        whole(rows, room)
    none = packing.pack_docs(docs.limit(0), vocabulary)
    assert none.collect() == [] and none.columns[-2:] == ["sequence_id", "offset"]


def test_sequences_hold_the_ids(spark, vocabulary):
    docs = spark.createDataFrame([(k, f"text number {k} " * (k % 9)) for k in range(60)], "doc_id long, text string")
    packed = packing.pack_docs(docs, vocabulary, 32, keep_ids=True)
    out = packing.sequences(packed).collect()
    assert sum(r.length for r in out) == sum(len(vocabulary.worker().encode(f"text number {k} " * (k % 9))) + 1 for k in range(60))
    assert all(len(r.ids) == r.length <= 32 for r in out)


def test_hot_length_is_dealt_out(spark, vocabulary):
    """One length has all the pieces of many tasks; ranks stay distinct."""
    docs = spark.range(5000, numPartitions=7).selectExpr("id AS doc_id", "'same text' AS text")
    rows = packing.pack_docs(docs, vocabulary).collect()
    length = rows[0].length
    assert whole(rows, 1024) == -(-5000 // (1024 // length)) and len({(r.sequence_id, r.offset) for r in rows}) == 5000


def least_sequences(sizes, room):
    """By exhaustive search."""
    best = len(sizes)

    def go(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b >= rest[0]}.values():
            go(rest[1:], [*bins[:k], bins[k] - rest[0], *bins[k + 1 :]])
        go(rest[1:], [*bins, room - rest[0]])

    go(sorted(sizes, reverse=True), [])
    return best


def test_plan_against_exhaustive_search():
    rng = random.Random(2)
    over = 0
    for _ in range(150):
        room = rng.choice([10, 16, 33])
        sizes = [rng.randrange(1, room + 1) for _ in range(rng.randrange(1, 11))]
        made = packing.plan(Counter(sizes), room)
        assert Counter(i for p, n in made for i in p * n) == Counter(sizes) and all(sum(p) <= room for p, _ in made)
        over += sum(n for _, n in made) - least_sequences(sizes, room)
    assert over <= 3


@pytest.mark.parametrize("scale", [50, 10**6])
def test_plan_is_near_the_bound_and_small(scale):
    rng = np.random.default_rng(0)
    have = {i: int(x) for i, x in enumerate(rng.poisson(scale, 1025)) if i and x}
    made = packing.plan(have)
    assert Counter({i: 0 for i in have}) + Counter() == Counter()
    got = Counter()
    for p, n in made:
        for i in p:
            got[i] += n
    assert got == have
    least = -(-sum(i * n for i, n in have.items()) // 1024)
    assert sum(n for _, n in made) <= (1.003 if scale == 50 else 1.0001) * least
    assert len(packing.ranges(made)) < 12 * 1024


def plain_best_fit(sizes, room):
    bins = []
    for i in sorted(sizes, reverse=True):
        k = min((k for k, free in enumerate(bins) if free >= i), key=lambda k: bins[k], default=None)
        if k is None:
            bins.append(room - i)
        else:
            bins[k] -= i
    return len(bins)


def test_never_worse_than_best_fit():
    rng = random.Random(6)
    for _ in range(120):
        room = rng.choice([10, 64, 200])
        sizes = [rng.choice([rng.randrange(1, room + 1), max(1, room // 3), max(1, room // 5)]) for _ in range(rng.randrange(1, 200))]
        have = np.zeros(room + 1, np.int64)
        for i in sizes:
            have[i] += 1
        own = packing.best_fit(have.copy())
        got = Counter()
        for p, n in own:
            assert sum(p) <= room and n > 0
            for i in p:
                got[i] += n
        assert got == Counter(sizes)
        want = plain_best_fit(sizes, room)
        assert sum(n for _, n in own) == want
        assert sum(n for _, n in packing.plan(Counter(sizes), room)) <= want
