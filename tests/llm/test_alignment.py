import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from scoreloom.llm import alignment, encoders

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return encoders.ByteLevel.from_file(JSON), encoders.Pieces.from_file(MODEL)


def tokens(text):
    """Lists (id, start, end) of A and B by plain Python, or two empty ones."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    if not _MADE:
        t = Tokenizer.from_file(JSON)
        t.encode_special_tokens = True
        names = {i: x for x, i in json.load(open(JSON))["model"]["vocab"].items()}
        _MADE.update(a=t, names=names, back=encoders.byte_of_char(), b=sentencepiece.SentencePieceProcessor(model_file=MODEL))
    if not text:
        return [], []
    data, out = (" " + text).encode(), []
    for ids, of in ((_MADE["a"].encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(_MADE["back"][c] for c in _MADE["names"][i])), (_MADE["b"].encode(text), piece)):
        at, own = 0, []
        for i in ids:
            own.append((i, at, at + len(of(i))))
            at = own[-1][2]
        if b"".join(map(of, ids)) != data:
            return [], []
        out.append(own)
    return out


def piece(i):
    p = _MADE["b"].id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()


_MADE: dict = {}


def brute(texts):
    """What digest gives, by rows; groups; links."""
    every, held = [], defaultdict(set)
    for k, text in enumerate(texts):
        a, b = tokens(text)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [(s, e, [i for i, x, _ in a if s <= x < e], [i for i, x, _ in b if s <= x < e]) for s, e in zip([0, *cuts], cuts)]
        links = [(max(s, u), min(e, v), i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
        for _, _, i, j in links:
            held[i, j].add(k)
        every.append((a, b, groups, links))
    best = Counter()
    for (i, _), docs in held.items():
        best[i] = max(best[i], len(docs))
    rows = []
    for a, b, groups, links in every:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for _, _, x, y in groups)
        counts = [(len(held[i, j]), best[i]) for _, _, i, j in links]
        rows.append((len(a), len(b), len(groups), len(links), sum(n == m for n, m in counts), sum(n for n, _ in counts), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return rows, [x[2] for x in every], [x[3] for x in every]


def rows_of(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    out = alignment.query(spark, sf)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    # Brute-force links are quadratic in a text, so the longest are left to the next test.
    few = [d for d in docs if len(d.text or "") < 1200]
    want, _, _ = brute([d.text for d in few])
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(docs)
    for d, w in zip(few, want):
        r = got[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (*w[:4], w[6])
    kept = spark.createDataFrame([(d.doc_id, d.text) for d in few], "doc_id long, text string")
    assert rows_of(alignment.digest(kept, encoders.ByteLevel.from_file(JSON), encoders.Pieces.from_file(MODEL))) == Counter((d.doc_id, *w) for d, w in zip(few, want))


EDGES = [None, "", " ", "a", "a", "  two  spaces ", "▁", "x▁y", "<|endoftext|> <s> </s> <0x41>", "日本語 и 漢字 \U0001f600‍", "\0", "tab\t\n\r\nnew", "Größe", "é" * 50, "a" * 3000, " " * 500, "1234567890" * 20, "don't DON'T"]


@pytest.mark.parametrize("chunk, links", [(4096, 2_000_000), (3, 40), (1, 1)])
def test_edges_with_small_blocks(spark, both, monkeypatch, chunk, links):
    """Blocks of events and of links of any size give the same; null ids, repeated rows, one id with two texts, clashing columns."""
    texts = EDGES + ["the cat sat on the mat " * 9, "the cat sat", "the cat sat"]
    ids = [None if k in (2, 9) else 7 if k in (3, 4, 12) else k for k in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, 2, b"") for i, t in zip(ids, texts)] + [(99, "the cat sat", 1, 2, b"")] * 3, "doc_id long, text string, h int, copies int, block binary").repartition(3)
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "LINKS", links)
    texts, ids = texts + ["the cat sat"] * 3, ids + [99] * 3
    want, groups, linked = brute(texts)
    assert rows_of(alignment.digest(docs, *both)) == Counter((i, *w) for i, w in zip(ids, want))
    out = alignment.align(docs, *both).collect()
    assert Counter((r.doc_id, r.start, r.end, tuple(r.a_ids), tuple(r.b_ids)) for r in out for _ in range(r.copies)) == Counter((i, s, e, tuple(x), tuple(y)) for i, own in zip(ids, groups) for s, e, x, y in own)
    out = alignment.align(docs, *both, what="links").collect()
    assert Counter((r.doc_id, r.start, r.end, r.a_id, r.b_id) for r in out for _ in range(r.copies)) == Counter((i, *x) for i, own in zip(ids, linked) for x in own)


def test_empty_table(spark, both):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.digest(docs, *both).collect() == [] and alignment.align(docs, *both).collect() == []


def test_machine_keeps_little(both):
    """A text of 400,000 characters, block by block: what the machine keeps stays below two blocks, and its groups are those of the whole."""
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdehinorst", k=rng.randrange(1, 9))) for _ in range(80_000))
    a, b = (v.worker() for v in both)
    ids = [np.array(a.encode(" " + text), np.uint32), np.array(b.encode(text), np.uint32)]
    whole = alignment.Sweep((a.sizes, b.sizes))
    whole.feed(0, ids[0])
    whole = whole.feed(1, ids[1])
    m, n, links, most = alignment.Sweep((a.sizes, b.sizes)), 0, 0, 0
    ends = [np.cumsum(v.sizes[x]) for v, x in zip((a, b), ids)]
    blocks = sorted((int(ends[s][k - 1]) if k else 0, s, k) for s in (0, 1) for k in range(0, len(ids[s]), 500))
    for _, s, k in blocks:
        if g := m.feed(s, ids[s][k : k + 500]):
            n, links = n + g.n, links + len(g.links()[0])
        most = max(most, *(len(x) for x in m.ids))
    assert (n, links) == (whole.n, len(whole.links()[0])) and most < 1100 and not len(m.ids[0]) and not len(m.ids[1])


def test_planes_round_trip():
    for kind, top in (("<u4", 2**32 - 1), ("<u8", 2**63)):
        x = np.array([0, 1, 255, 256, top, 7], kind)
        assert (alignment.expand(alignment.squeeze(x), kind) == x).all()
        assert not len(alignment.expand(alignment.squeeze(x[:0]), kind))


@pytest.mark.parametrize("merged", [500_000, 60])
def test_blocks_come_from_documents_not_tasks(spark, both, monkeypatch, merged):
    """Many tasks of few documents: their blocks are read as one, or as some of about so many pairs, and results stay."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices("the cat sat on a mat and Größe don't 12 ".split(), k=rng.randrange(9))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(alignment, "MERGED", merged)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        parts = alignment.cut(alignment._swept(alignment.sorted_events(docs, *both, "doc_id", "text"), *both))
        tasks, entries = parts.select("block").distinct().count(), parts.agg({"entries": "sum"}).first()[0]
        out = alignment._merged(parts)
        blocks = out.select("block").distinct().count()
        assert tasks > 20 and out.count() == parts.count()
        assert blocks == 1 if merged > entries else 1 < blocks <= entries // merged + 1 < tasks
        assert rows_of(alignment.digest(docs, *both)) == Counter((k, *w) for k, w in enumerate(brute(texts)[0]))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_exact_ids_are_those_of_the_whole_text(both):
    """``exactly`` gives the ids that a text's own encoding has, and none where the joined bytes are others."""
    rng, (a, b) = random.Random(6), (v.worker() for v in both)
    alphabet = [*map(chr, range(0x240)), *" \t\n\r\x85\xa0" * 30, *"aeinst019'" * 10, *["日", "▁", "　", "́", "\U0001f600", "<s>", "<|endoftext|>", "<0x41>"] * 4]
    for k in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(1, 40)))
        data = (" " + text).encode()
        for v, ids, own in ((a, a.exact.encode(" " + text, add_special_tokens=False).ids, " " + text), (b, b.model.encode(text), text)):
            got = v.exactly(own, data)
            assert (got is None) == (v.joined(ids) != data) and (got is None or got.tolist() == ids)
            assert v.exactly(own, data + b"x") is None
