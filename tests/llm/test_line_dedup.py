import random
import time

from pyspark.sql import functions as F

from scoreloom.llm import line_dedup as L


def lcs_ok(a, b, pairs):
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_patience():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randrange(25))]
        b = [rng.randrange(12) for _ in range(rng.randrange(25))]
        lcs_ok(a, b, L.patience(a, b))
    a = list(range(50))
    assert L.patience(a, a) == [(i, i) for i in a]
    assert L.patience(a, [99, *a[10:30], 98, *a[40:]]) == [(i, i - 9) for i in range(10, 30)] + [(i, i - 18) for i in range(40, 50)]
    assert L.patience([7] * 5, [7] * 3) == [(0, 0), (1, 1), (2, 2)]
    assert L.patience([1, 5, 5, 2], [5, 5, 9]) == [(1, 0), (2, 1)]


def all_pairs(docs, least=5):
    """Every pair of documents that share a run of lines of ``least`` words or more, aligned over all lines that two documents hold: the exact result of the deletion rule."""
    split = {d: [x for x in (t or "").split("\n") if x.split()] for d, t in docs if d is not None}
    holders, runs = {}, {}
    for d, ls in split.items():
        for i, x in enumerate(ls):
            holders.setdefault(x, set()).add(d)
            total = 0
            for j in range(i, len(ls)):
                total += len(ls[j].split())
                if total >= least:
                    runs.setdefault(tuple(ls[i : j + 1]), set()).add(d)
                    break
    pairs = {(a, b) for ds in runs.values() for b in ds for a in ds if a < b}
    side = {d: [(k, x) for k, x in enumerate(ls) if len(holders[x]) > 1] for d, ls in split.items()}
    gone = {}
    for a, b in pairs:
        sa, sb = side[a], side[b]
        hit = L.common_blocks([x for _, x in sa], [k for k, _ in sa], [x for _, x in sb], [k for k, _ in sb], [len(x.split()) for _, x in sb], least)
        gone.setdefault(b, set()).update(hit)
    return {d: sorted(x) for d, x in gone.items() if x}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    gone = all_pairs(docs.items())
    rows = {r.doc_id: r for r in L.query(spark, sf).collect()}
    assert rows.keys() == docs.keys() and len(gone) > 100
    for d, t in docs.items():
        lines = t.split("\n")
        filled = [k for k, x in enumerate(lines) if x.split()]
        drop = {filled[k] for k in gone.get(d, [])}
        want = "" if drop and len(drop) == len(filled) else "\n".join(x for k, x in enumerate(lines) if k not in drop)
        assert rows[d].text == want
        assert (rows[d].n_lines, rows[d].n_deleted, rows[d].words_deleted) == (len(filled), len(drop), sum(len(lines[k].split()) for k in drop))


def test_blocks_go_from_later_documents(spark):
    passage = [" ".join(f"p{i}w{j}" for j in range(20)) for i in range(4)]
    docs = [(d, "\n".join([f"own {d} line with words", *passage, f"end of {d} it is", ""])) for d in range(1, 40)]
    docs += [(100, None), (101, ""), (102, "Of.\nOf."), (103, "Of."), (104, docs[0][1]), (None, docs[0][1]), (105, "\n".join(passage[::-1])), (106, "unique words of this one here"), (106, "unique words of this one here")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("doc", F.lit(1)).withColumn("gone", F.lit("x")).repartition(3)
    out = L.dedup_lines(df)
    assert out.columns == [*df.columns, "__n_lines", "__n_gone", "__words_gone"]
    rows = [(r.doc_id, r.text) for r in out.collect()]
    got = dict(rows)
    assert len(rows) == len(docs)
    assert got[1] == docs[0][1] and got[None] == docs[0][1]
    assert all(got[d] == f"own {d} line with words\nend of {d} it is\n" for d in range(2, 40))
    assert got[100] is None and got[101] == got[104] == "" and got[102] == "Of.\nOf." and got[103] == "Of."
    assert len(got[105].split("\n")) == 3  # reversed: one line aligns
    clash = L.dedup_lines(df.withColumn("__doc", F.lit(1)).withColumn("__gone", F.lit(2)).withColumn("__n_gone", F.lit(3)))
    assert clash.columns == [*df.columns, "__doc", "__gone", "__n_lines", "__n_gone", "__words_gone"] and {r["__gone"] for r in clash.collect()} == {2}
    assert got[106] == "unique words of this one here"
    assert L.dedup_lines(df.limit(0)).count() == 0


def found(spark, docs):
    rows = L.duplicate_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    return {r.doc: list(r.gone) for r in rows}


def test_frequent_lines_are_tried_with_later_partners(spark):
    p, q = (" ".join(f"{x}{j}" for j in range(60)) for x in "pq")
    docs = [(1, f"{p}\n{q}")] + [(d, f"{q}\n{p}") for d in range(2, 11)]
    got = found(spark, docs)
    assert len(got[2]) == 1 and all(got[d] == [0, 1] for d in range(3, 11))
    # a block of which the earliest documents hold one line each
    block = ["a1 a2 a3", "b1 b2 b3"]
    docs = [(1, block[0]), (2, block[1])] + [(d, "\n".join([f"own {d}", *block])) for d in range(3, 11)]
    assert found(spark, docs) == {d: [1, 2] for d in range(4, 11)}


def test_frequent_lines_equal_all_pairs(spark):
    rng = random.Random(4)
    pool = [" ".join(f"w{i}x{j}" for j in range(rng.choice((3, 4, 6)))) for i in range(9)]
    docs = [(d, "\n".join(rng.choice(pool) if rng.random() < 0.9 else f"own {d}" for _ in range(rng.randrange(2, 12)))) for d in range(120)]
    want = all_pairs(docs)
    assert found(spark, docs) == want and len(want) > 50


def test_table_equals_all_pairs(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert found(spark, docs) == all_pairs(docs)


def test_short_lines_link(spark):
    verse = "\n".join(f"v{i} w{i}" if i % 2 else f"v{i}" for i in range(60))
    assert found(spark, [(1, f"one own\n{verse}"), (2, f"{verse}\nother end")]) == {2: list(range(60))}
    rng = random.Random(6)
    pool = [" ".join(f"w{i}x{j}" for j in range(rng.choice((1, 2, 3)))) for i in range(9)]
    docs = [(d, "\n".join(rng.choice(pool) if rng.random() < 0.9 else f"own {d}" for _ in range(rng.randrange(2, 12)))) for d in range(100)]
    assert found(spark, docs) == all_pairs(docs)


def test_six_documents_with_a_shared_block(spark):
    block = ["alpha beta gamma", "delta eps zeta"]
    docs = [(1, block[0]), (2, block[1])] + [(d, "\n".join(block)) for d in range(3, 9)]
    assert found(spark, docs) == all_pairs(docs) == {d: [0, 1] for d in range(4, 9)}


def test_time_of_repeated_lines():
    def took(n):
        a = [k % 2 for k in range(n)]
        began = time.perf_counter()
        L.patience([7, *a, 8], [9, *[0] * (n // 2), *[1] * (n // 2), 3])
        return time.perf_counter() - began

    took(1000)
    assert min(took(80_000) for _ in range(3)) < 2.6 * min(took(40_000) for _ in range(3))


def test_a_very_long_document(spark):
    many = [f"line {k} of a very long text" for k in range(60_000)]
    docs = [(1, "\n".join(many)), (2, "\n".join(["own first line of it", *many, "own last"])), (3, "x " * 300_000 + "\n" + many[7])]
    got = found(spark, docs)
    assert got == {2: list(range(1, 60_001)), 3: [1]}


def test_partners_of_one_document_in_groups(spark, monkeypatch):
    """A footer held by very many documents: groups of a few partners, of which each gets the earlier lines once, give the same."""
    footer = "this footer stands below every page of the site"
    docs = [(d, f"own words of page {d} stand here\n{footer}") for d in range(300)]
    want = {d: [1] for d in range(1, 300)}
    assert found(spark, docs) == want
    monkeypatch.setattr(L, "GROUP", 7)
    assert found(spark, docs) == want
    rng = random.Random(8)
    pool = [" ".join(f"w{i}x{j}" for j in range(6)) for i in range(7)]
    docs = [(d, "\n".join(rng.choice(pool) for _ in range(rng.randrange(2, 9)))) for d in range(60)]
    assert found(spark, docs) == all_pairs(docs)
