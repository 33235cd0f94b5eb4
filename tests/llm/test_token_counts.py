from collections import Counter

from pyspark.sql import functions as F

from scoreloom.llm import token_counts as T


def totals(df):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in df.collect()}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    want = {}
    for name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        e = T.Tokenizer.from_file(name, f"/opt/tokenizers/{name}.tiktoken").encoding()
        for r in docs:
            if r.doc_id not in toxic:
                n, t = want.get((r.source, r.lang, name), (0, 0))
                want[r.source, r.lang, name] = n + 1, t + len(e.encode_ordinary(r.text))
    assert totals(T.query(spark, sf)) == want


BYTES = {bytes([b]): b for b in range(256)} | {b"ab": 256}


def test_counts_of_edge_cases(spark):
    docs = spark.createDataFrame([(1, "abab", "s", "en"), (1, "abab", "s", "en"), (2, None, None, None), (None, "", "s", None), (3, "é" * 50_000, "s", "en")], "doc_id long, text string, source string, lang string").withColumn("tokens", F.lit(1)).withColumn("n", F.lit(2)).repartition(2)
    one, two = T.Tokenizer("bytes", {k: v for k, v in BYTES.items() if v < 256}), T.Tokenizer("pairs", BYTES)
    got = Counter((r.doc_id, r.source, r.lang, r.tokenizer, r.tokens, r.estimate) for r in T.count(docs, [one, two]).collect())
    assert got == Counter({(1, "s", "en", "bytes", 4, 1): 2, (1, "s", "en", "pairs", 2, 1): 2, (2, None, None, "bytes", 0, 0): 1, (2, None, None, "pairs", 0, 0): 1, (None, "s", None, "bytes", 0, 0): 1, (None, "s", None, "pairs", 0, 0): 1, (3, "s", "en", "bytes", 100_000, 25_000): 1, (3, "s", "en", "pairs", 100_000, 25_000): 1})
    assert T.count(docs.limit(0), [one]).count() == 0


def test_batches_count_once(spark, tmp_path):
    r = T.Rollup(spark, f"file://{tmp_path}/r")
    rows = lambda *x: spark.createDataFrame(list(x), "source string, lang string, tokenizer string, tokens long, old long")
    assert totals(r.totals()) == {} and not r.compact()
    first = rows(("a", "en", "t", 5, 3), ("a", "en", "t", 7, 7), (None, None, "t", None, 1))
    assert r.commit("1", T.inserts(first)) and not r.commit("1", T.inserts(first))
    assert totals(r.totals()) == {("a", "en", "t"): (2, 12), (None, None, "t"): (1, 0)}
    assert r.commit("2/../x", T.deletes(rows(("a", "en", "t", 5, 0)))) and r.committed("2/../x")
    assert r.commit("3", T.revisions(rows(("a", "en", "t", 9, 7)), "old"))
    want = {("a", "en", "t"): (1, 9), (None, None, "t"): (1, 0)}
    assert totals(r.totals()) == want
    assert r.compact() and totals(r.totals()) == want and not r.compact()
    assert not r.commit("3", T.inserts(first)) and totals(r.totals()) == want
    assert r.commit("4", T.inserts(rows().limit(0))) and totals(r.totals()) == want
    assert r.commit("5", T.deletes(rows(("a", "en", "t", 9, 0), (None, None, "t", 0, 0))))
    assert totals(r.totals()) == {}
    # what was written without a record, as by a lost driver, is never read
    r._write(T.inserts(first))
    assert totals(T.Rollup(spark, f"file://{tmp_path}/r").totals()) == {}


def test_changes_in_any_order_give_the_same(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", "t", i, 1) for i in range(6)], "source string, lang string, tokenizer string, tokens long, old long")
    batches = [("x", T.inserts(rows)), ("y", T.deletes(rows.where("tokens > 3"))), ("z", T.revisions(rows, "old"))]
    a, b = T.Rollup(spark, f"{tmp_path}/a"), T.Rollup(spark, f"{tmp_path}/b")
    for k, v in batches:
        a.commit(k, v)
    for k, v in batches[::-1]:
        b.commit(k, v)
        b.compact()
    assert totals(a.totals()) == totals(b.totals())


def test_long_whitespace_is_counted_exactly(spark):
    t = T.Tokenizer.from_file("byte_bpe_50k", "/opt/tokenizers/byte_bpe_50k.tiktoken")
    for text in ("a" + " " * 30_000 + "b", "a" + "\n\u3000" * 20_000 + "b c", " " * 25_000, "x\t" * 9 + " " * 21_000 + "\ny" + " " * 20_000):
        assert t.tokens(text) == len(t.encoding().encode_ordinary(text))
    docs = spark.createDataFrame([(1, "a" + " " * 2_000_000 + "b", "s", "en"), (2, "\x1c" * 30_000, "s", "en")], "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r.tokens for r in T.count(docs, [t]).collect()}
    assert got[1] > 10 and got[2] == len(t.encoding().encode_ordinary("\x1c" * 30_000))


def test_a_crash_between_writing_and_sealing_loses_no_batch(spark, tmp_path, monkeypatch):
    r = T.Rollup(spark, f"file://{tmp_path}/r")
    changes = spark.createDataFrame([("s", "en", "t", 1, 5)], "source string, lang string, tokenizer string, docs long, tokens long")
    whole = T.Rollup._create
    for dies_at in ("live", "seals"):

        def crash(self, place, what, dies_at=dies_at):
            if place.startswith(dies_at):
                raise RuntimeError("killed")
            return whole(self, place, what)

        monkeypatch.setattr(T.Rollup, "_create", crash)
        try:
            r.commit("one", changes)
        except RuntimeError:
            pass
        monkeypatch.undo()
        assert not r.committed("one") and totals(r.totals()) == {}
    assert r.commit("one", changes) and not r.commit("one", changes)
    assert totals(r.totals()) == {("s", "en", "t"): (1, 5)}


def test_compaction_keeps_records_short(spark, tmp_path):
    r = T.Rollup(spark, f"file://{tmp_path}/r")
    changes = spark.createDataFrame([("s", "en", "t", 1, 5)], "source string, lang string, tokenizer string, docs long, tokens long")
    for k in range(3):
        for j in range(2):
            assert r.commit(f"b{k}{j}", changes)
        assert r.compact()
        assert r._lines("live") == [] and len(r._lines("manifests")) <= 2
    assert not r.compact()
    assert not any(r.commit(f"b{k}{j}", changes) for k in range(3) for j in range(2))
    assert totals(r.totals()) == {("s", "en", "t"): (6, 30)}
