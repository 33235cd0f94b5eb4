from collections import Counter

import corpus_pipeline as P
import test_decontaminate
import test_line_dedup
import test_mixing
import test_near_dedup
import test_quality_rules

from scoreloom.llm import mixing
from scoreloom.llm import quality_rules as Q


def test_run_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs = {r.doc_id: r for r in table.collect()}
    kept = {r.doc_id for r in P.quality(spark, table, sf).select("doc_id").collect()}
    verdict = {r.doc_id: r.kept for r in Q.query(spark, sf).collect()}
    assert kept == {d for d, v in verdict.items() if v and not test_quality_rules.brute(docs[d].text)[5]}

    texts = {d: docs[d].text for d in kept}
    gone = test_line_dedup.all_pairs(texts.items())
    for d, numbers in gone.items():
        lines = texts[d].split("\n")
        filled = [k for k, x in enumerate(lines) if x.split()]
        drop = {filled[k] for k in numbers}
        texts[d] = None if len(drop) == len(filled) else "\n".join(x for k, x in enumerate(lines) if k not in drop)
    texts = {d: t for d, t in texts.items() if t is not None}

    texts = {r[0]: texts[r[0]] for r in test_near_dedup.brute(list(texts.items()), 5) if r[3]}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r[0]: texts[r[0]] for r in test_decontaminate.brute(list(texts.items()), items) if not r[5]}
    size = Counter()
    for d, t in texts.items():
        size[docs[d].source] += len(t)
    total = sum(mixing.SHARES.values()) + mixing.OTHERS
    want = Counter()
    for d, t in texts.items():
        s = docs[d].source
        n = test_mixing.draw(mixing.SHARES[s] / total * sum(size.values()) / size[s], d)
        if n:
            want[d, t, docs[d].lang, s] = n
    out = P.run(spark, sf)
    assert out.columns == [*table.columns, "copy", "order_key"]
    rows = out.collect()
    assert Counter((r.doc_id, r.text, r.lang, r.source) for r in rows) == want
    assert all(r.n_chars == len(r.text) for r in rows)
    assert 0.5 * len(docs) < len(texts) < len(docs)


def test_stages_keep_columns_of_other_tables(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([(1, None, "en", "src0", None), (2, "", None, None, 0), (3, "a b c d e f g h i j k l", "en", "src1", 23), (4, "a b c d e f g h i j k l", "en", "src1", 23)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit(1)).withColumn("n_words", F.lit("x"))
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        assert out.columns[: len(docs.columns)] == docs.columns and (k == 4 or out.columns == docs.columns)
        assert stage(spark, docs.limit(0), sf).count() == 0
        out.count()
    assert [r.doc_id for r in P.near(spark, P.lines(spark, P.quality(spark, docs, sf), sf), sf).collect()] == [3]
