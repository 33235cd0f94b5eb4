import re

import pytest
from pyspark.sql import functions as F

from scoreloom.llm import license_scan as L

KNOWN = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by"}


def test_query_finds_planted_notices(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in L.query(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows.keys() == docs.keys()
    for i, t in docs.items():
        want = [f"{k}:{KNOWN[x]}" for k, x in enumerate(t.split("\n"), 1) if x in KNOWN]
        assert rows[i].findings == ",".join(want), (i, rows[i])
        assert rows[i].n_candidates >= sum(bool(re.search(L.CUES, x)) for x in t.split("\n"))
    assert all(any(x in t.split("\n") for t in docs.values()) for x in KNOWN)


@pytest.fixture(scope="module")
def classifier(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.explode(F.split("text", "\n")).alias("text"))
    return L.fit(lines)


UNSEEN = [
    ("mit", "licensed under the MIT license, see the file for details"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache", "This code is licensed under the Apache License, Version 2.0 and you may not use this file except in compliance"),
    ("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "subject to the terms of the Mozilla Public License"),
    ("cc-by", "is licensed under a Creative Commons Attribution 4.0 International License"),
    ("public-domain", "software released into the public domain"),
    ("proprietary", "Copyright 2020. All rights reserved."),
    ("unknown", "He had no licence to fish and the warden took his rod away"),
    ("unknown", "the copyright of photographs is a difficult matter in many courts"),
    ("unknown", "permission from your parents is needed for the school trip"),
    ("unknown", "the license plate of the car was dirty"),
    ("unknown", "warranty claims are handled by the shop"),
]


def test_unseen_paragraphs(spark, classifier):
    assert 0.5 <= classifier.least < 1
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(UNSEEN)], "doc_id int, text string")
    got = {r.doc_id: r.families or "unknown" for r in L.scan(docs, classifier).collect()}
    wrong = [(f, got[i], t) for i, (f, t) in enumerate(UNSEEN) if got[i] != f]
    assert not [x for x in wrong if x[0] == "unknown"] and len(wrong) <= 1, wrong


def test_every_template_has_a_cue_and_is_recognised(spark, classifier):
    assert all(re.search(L.CUES, t) for _, t in L.TEMPLATES)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(L.TEMPLATES)], "doc_id int, text string")
    got = {r.doc_id: r.families for r in L.scan(docs, classifier).collect()}
    assert sum(got[i] != f for i, (f, _) in enumerate(L.TEMPLATES)) <= 1


def test_edge_cases(spark, classifier):
    wrapped = "x\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles, to deal in the Software without restriction\n"
    docs = spark.createDataFrame([(1, None), (2, ""), (3, wrapped), (4, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."), (4, "nothing"), (4, "nothing"), (None, "Released under the MIT License."), (5, "word " * 30_000 + "\nReleased under the MIT License.")], "doc_id int, text string").withColumn("family", F.lit("x")).withColumn("found", F.lit(1)).repartition(2)
    rows = L.scan(docs, classifier).collect()
    assert sorted((str(r.doc_id), r.families) for r in rows) == sorted([("1", ""), ("2", ""), ("3", "mit"), ("4", "apache,mit"), ("4", ""), ("4", ""), ("None", "mit"), ("5", "mit")])
    assert L.scan(docs.limit(0), classifier).count() == 0
    assert L.scan(docs.limit(0)).count() == 0


def test_python_is_not_used(spark, classifier):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = L.scan(docs, classifier)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_forms(spark, classifier):
    forms = [("cc-by", "Licensed under CC BY-NC 4.0."), ("cc-by", "Licensed under CC BY-ND 4.0"), ("gpl", "Licensed under GPLv2."), ("cc-by", "Licensed under CC BY 4.0"), ("lgpl", "Licensed under LGPLv3."), ("public-domain", "Licensed under CC0 1.0.")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(forms)], "doc_id int, text string")
    got = {r.doc_id: r.families for r in L.scan(docs, classifier).collect()}
    assert [got[i] for i in range(len(forms))] == [f for f, _ in forms]


def test_notices_without_licence_words(spark, classifier):
    forms = [
        ("gpl", "Distributed under GPLv3 or later."),
        ("cc-by", "Available under CC BY-SA 4.0."),
        ("gpl", "This program is free software under the GNU GPL version 2."),
        ("cc-by", "This work is released under Creative Commons Attribution 4.0 International."),
        ("proprietary", "(c) 2020 Acme Inc. All rights reserved."),
        ("gpl", "prose stands here\nThis program is free software under the GNU\nGPL version 2."),
        ("", "This program is about the under side of the later version of life."),
        ("", "The rights of the people under the law."),
    ]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(forms)], "doc_id int, text string")
    rows = {r.doc_id: r for r in L.scan(docs, classifier).collect()}
    assert [rows[i].families for i in range(len(forms))] == [f for f, _ in forms]
    assert rows[5].findings.startswith("2:gpl")


def test_probabilities_are_calibrated(classifier):
    """On texts that the scoring model had not seen: what is said with p is right about p of the time, and what is named above the threshold nearly always."""
    n = sum(k for _, _, k in classifier.reliability)
    assert n > 500
    assert sum(abs(p - right) * k for p, right, k in classifier.reliability) / n <= 0.1
    assert 0.5 <= classifier.least <= 0.95


def test_very_long_texts(spark, classifier):
    notice = "Licensed under the Apache License, Version 2.0."
    docs = spark.createDataFrame([(1, "word of prose " * 100_000 + "\n" + notice), (2, "\n".join(["plain line here"] * 20_000 + [notice]))], "doc_id int, text string")
    rows = {r.doc_id: r for r in L.scan(docs, classifier).collect()}
    assert rows[1].findings == "2:apache" and rows[2].findings == "20001:apache"


def test_cost_is_linear_in_lines(spark, classifier):
    """8,000 and 16,000 lines, each text with one notice, at a ratio of at most 2.6; 100,000 lines within a minute."""
    import time

    notice = "Licensed under the Apache License, Version 2.0."

    def took(n):
        docs = spark.createDataFrame([(1, "\n".join(["plain line here"] * n + [notice]))], "doc_id int, text string")
        least = float("inf")
        for _ in range(3 if n < 50_000 else 1):
            began = time.perf_counter()
            rows = L.scan(docs, classifier).collect()
            least = min(least, time.perf_counter() - began)
            assert rows[0].findings == f"{n + 1}:apache"
        return least

    took(1000)
    assert took(16_000) <= 2.6 * took(8_000)
    assert took(100_000) < 60


def murmur(data, seed=42):
    """The 32-bit hash of a term, signed."""
    h, mask = seed, 2**32 - 1
    rot = lambda x, r: (x << r | x >> 32 - r) & mask
    for k in range(0, len(data) - len(data) % 4, 4):
        h = (rot(h ^ rot(int.from_bytes(data[k : k + 4], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask, 13) * 5 + 0xE6546B64) & mask
    if tail := data[len(data) - len(data) % 4 :]:
        h ^= rot(int.from_bytes(tail, "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & mask
    h ^= h >> 16
    return h - 2**32 if h >= 2**31 else h


def brute_findings(classifier, weights, intercepts, text, confirm=0.5):
    """(n_candidates, findings) of one text in plain Python, from the fitted coefficients."""
    import math

    names = [*L.FAMILIES, L.UNKNOWN]
    word = lambda t: re.findall(r"[^\W_]+", t.lower())
    pairs = lambda w: {f"{a} {b}" for a, b in zip(w, w[1:])}
    templates = {f: [pairs(word(t)) for g, t in L.TEMPLATES if g == f] for f in L.FAMILIES}
    lines, judged, own = (text or "").split("\n"), [], 0
    if not re.search(L.CUES, text or ""):
        return 0, ""
    for k, x in enumerate(lines):
        first = re.match(r"[\W_]*[^\W_]+", " ".join(lines[k + 1 : k + 3]))
        own += bool(re.search(L.CUES, x))
        if not re.search(L.CUES, x) and not re.search(L.CUES, f"{x} {first[0] if first else ''}"):
            continue
        for more in range(3):
            tokens = word(" ".join(lines[k : k + 1 + more]))
            at = {murmur(t.encode()) % L._DIMENSIONS for t in {*tokens, *pairs(tokens)}}
            raw = [(sum(row[i] for i in at) + c) / classifier.temperature for row, c in zip(weights, intercepts)]
            e = [math.exp(v - max(raw)) for v in raw]
            p = max(e) / sum(e)
            guess = names[e.index(max(e))]
            common = max((len(pairs(tokens) & t) for t in templates.get(guess, [])), default=0)
            match = max((len(pairs(tokens) & t) / max(min(len(t), len(pairs(tokens))), 1) for t in templates.get(guess, [])), default=0.0)
            if guess != L.UNKNOWN and p >= classifier.least and match >= confirm:
                judged.append((k, k + more, guess, p, match, common))
    kept = [j for j in judged if not any(o[2] == j[2] and o[0] - j[0] in (1, 2) and o[1] <= j[1] and o[5] >= j[5] for o in judged)]
    best = {}
    for k, _, f, p, match, _ in kept:
        best[k] = max(best.get(k, (-1.0,)), (p, match, f))
    return own, ",".join(f"{k + 1}:{best[k][2]}" for k in sorted(best))


def test_findings_against_plain_python(spark, classifier):
    """All templates, notices over several lines and beside each other, prose, and a whole table."""
    rows = [t for _, t in L.TEMPLATES] + [t for _, t in UNSEEN] + ["\n".join([a, b]) for (_, a), (_, b) in zip(L.TEMPLATES, L.TEMPLATES[5:])]
    rows += ["\n".join(w[k : k + 5] and " ".join(w[k : k + 5]) for k in range(0, len(w), 5)) for w in (t.split() for _, t in L.TEMPLATES)] + [None, "", "\n\nReleased under the\n\nMIT License.\n"]
    table = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += table
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    got = {r.doc_id: (r.n_candidates, r.findings) for r in L.scan(docs, classifier).collect()}
    weights, intercepts = classifier.model.coefficientMatrix.toArray().tolist(), classifier.model.interceptVector.toArray().tolist()
    wrong = [(i, got[i], want) for i, t in enumerate(rows) if (want := brute_findings(classifier, weights, intercepts, t)) != got[i]]
    assert not wrong, wrong[:3]
    assert sum(bool(f) for _, f in got.values()) > 60
