"""A Thue-Morse word and its complement have equal polynomial hashes modulo 2**64; no operator may take one for the other."""

from scoreloom.llm import decontaminate, line_dedup, near_dedup, quality_rules

A = "".join("ab"[k.bit_count() % 2] for k in range(2048))
B = A.translate({97: "b", 98: "a"})


def test_repeats_within_a_text(spark):
    texts = [f"{A}\n{B}", f"{A}\n{A}", " ".join([A, "x", "y", "z", "w", B, "x", "y", "z", "w"]), " ".join([A, "x", "y", "z", "w"] * 2)]
    rows = {r.doc_id: r for r in quality_rules.with_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert [rows[i].n_dup_lines for i in range(2)] == [0, 1]
    assert [rows[i].n_repeat_words for i in (2, 3)] == [0, 10]


def test_near_duplicates(spark):
    docs = spark.createDataFrame([(1, A), (2, B), (3, f"{A} {B}"), (4, f"{B} {A}"), (5, A)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 2).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_benchmark_items(spark):
    docs = spark.createDataFrame([(1, A), (2, B)], "doc_id long, text string")
    items = spark.createDataFrame([("i", A)], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.overlap(docs, items).collect()} == {1: 1, 2: 0}


def test_common_lines(spark):
    docs = spark.createDataFrame([(1, f"{A} one two three four"), (2, f"{B} one two three four"), (3, f"own\n{A} one two three four")], "doc_id long, text string")
    assert {r.doc: list(r.gone) for r in line_dedup.duplicate_lines(docs).collect()} == {3: [1]}
