"""Licence scans with a trained paragraph classifier, in DataFrame functions and JVM models only.

Lines in which a licence word or a bigram of a template begins are candidates; each is looked at by
itself and joined with the one and the two lines after it, as notices are often wrapped. A multinomial
logistic regression over hashed word unigrams and bigrams gives each a family or "unknown". It is
trained on the template texts below, thinned in many ways, against general sentences about licences and
lines of the corpus, some of which have cues. Probabilities are calibrated by cross-fitting: each fold
of templates, sentences and lines is scored by a model that has seen none of its texts; the temperature
that makes these scores most likely is kept, and the threshold below which a family is unknown is the
least at which nineteen in twenty of the named and confirmed readings were notices. A family is reported only if a
template of it shares enough word bigrams with the paragraph.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cut import cut

UNKNOWN = "unknown"
#: Fixed texts: notices and opening paragraphs of public licences, by family.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied, including the warranties of merchantability, fitness for a particular purpose and noninfringement."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "You can redistribute this library and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "Licensed under the Mozilla Public License, version 2.0."),
    ("mpl", "SPDX-License-Identifier: MPL-2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Except where otherwise noted, content is available under the Creative Commons Attribution-ShareAlike License, CC BY-SA."),
    ("cc-by", "SPDX-License-Identifier: CC-BY-4.0"),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("public-domain", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under Creative Commons Zero, CC0."),
    ("proprietary", "Copyright the authors. All rights reserved."),
    ("proprietary", "This document is confidential and proprietary; no part may be reproduced without prior written permission of the copyright holder."),
    # short forms
    ("mit", "Distributed under MIT."),
    ("mit", "MIT License"),
    ("apache", "Distributed under Apache 2.0."),
    ("apache", "Apache License 2.0"),
    ("gpl", "Licensed under GPLv2."),
    ("gpl", "Released under GPLv2 or later."),
    ("gpl", "Licensed under GPLv3."),
    ("gpl", "Released under GPLv3 or later."),
    ("gpl", "This program is free software under the GNU GPL, version 3 or later."),
    ("gpl", "Licensed under the GNU GPL version 2."),
    ("gpl", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl", "Licensed under LGPLv2.1."),
    ("lgpl", "Released under LGPLv3 or later."),
    ("lgpl", "Licensed under the GNU LGPL version 3."),
    ("bsd", "Released under the BSD 2-Clause License."),
    ("bsd", "Licensed under BSD-3-Clause."),
    ("mpl", "Licensed under MPL 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "Licensed under CC BY-ND 4.0."),
    ("cc-by", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by", "Released under Creative Commons Attribution 4.0 International."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("public-domain", "Released under CC0 1.0."),
    ("public-domain", "Dedicated to the public domain under CC0."),
    ("proprietary", "(c) All rights reserved."),
    ("proprietary", "(c) 2020 The Company Inc. All rights reserved."),
]
#: Fixed texts: sentences with licence words that name no licence.
GENERAL = [
    "She lost her driving licence and had to apply for a new license at the office.",
    "The license of the restaurant was renewed by the city last year.",
    "A software license is a legal instrument that governs the use or redistribution of software.",
    "The word copyright means the right to copy a work.",
    "Please read the license agreement before you install the program.",
    "The warranty of the machine covers parts for two years.",
    "Which license should I choose for my project?",
    "They asked for permission to use the hall and it was granted.",
    "Fishing without a license is not permitted in this river.",
    "The company licensed its technology to several manufacturers.",
    "Copyright law differs from country to country.",
    "Poetic license allowed the author to change the dates.",
    "Free software and open source are not the same thing.",
    "The software is sold to schools at a lower price.",
    "This program is shown on Sunday at the end of the day.",
    "You should have received a copy of the letter along with this parcel.",
    "To the extent possible the work is done by hand.",
    "They worked under the terms of the new contract.",
    "The creative commons of the village is open to any person.",
    "The general public may visit the source of the river.",
    "In 2020 or later the third version of the list was published by the foundation.",
    "All rights reserved.",
    "All rights of the workers were reserved for a later meeting.",
]
FAMILIES = sorted({f for f, _ in TEMPLATES})
_TEMPERATURES = (0.3, 0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0)
#: Bigrams of these alone name no licence.
_COMMON = frozenset("a all along an and any are as at be by can either following for have i in is it its no not of on or other otherwise shall should that the this to was where with you your".split())


def _cues() -> str:
    """Licence words, and every bigram of the templates but those of common words alone, as one pattern by first letters and first words.

    A reading without a bigram of a template can't be confirmed, so lines without a cue lose nothing but readings that share common bigrams only.
    """
    tree: dict[str, dict[str, set[str]]] = {}
    for _, text in TEMPLATES:
        own = re.findall(r"[^\W_]+", text.lower())
        for x, y in zip(own, own[1:]):
            if not (x in _COMMON and y in _COMMON):
                tree.setdefault(x[0], {}).setdefault(x[1:], set()).add(y)
    by_word = lambda rest: "|".join(rf"{x}[\W_]+(?:{'|'.join(sorted(ys))})" for x, ys in sorted(rest.items()))
    pairs = "|".join(f"{c}(?:{by_word(rest)})" for c, rest in sorted(tree.items()))
    return rf"(?i)licen[cs]e|copyright|redistribut|spdx|warrant|permission|public domain|permitted|(?<![a-z0-9])(?:{pairs})(?![a-z0-9])"


#: Cues; every template has one, which a test holds.
CUES = _cues()
_DIMENSIONS = 1 << 14
FOLDS = 3


def _names() -> Column:
    return F.array(*map(F.lit, [*FAMILIES, UNKNOWN]))


def _pairs_of(text: str) -> list[tuple[str, str]]:
    own = re.findall(r"[^\W_]+", text.lower())
    return list(zip(own, own[1:]))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bigrams(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 1, F.transform(F.sequence(F.lit(0), F.size(tokens) - 2), lambda i: F.concat_ws(" ", F.get(tokens, i), F.get(tokens, i + 1)))).otherwise(F.array().cast("array<string>"))


def _table(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(family, text, fold): the texts of each family in turn."""
    seen: dict[str, int] = {}
    dealt = [(f, t, seen.__setitem__(f, seen.get(f, -1) + 1) or seen[f] % FOLDS) for f, t in rows]
    return spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(a).alias("family"), F.lit(b).alias("text"), F.lit(k).alias("fold")) for a, b, k in dealt))).alias("x")).select("x.*")


def _hashed(rows: DataFrame) -> DataFrame:
    terms = rows.withColumn("__terms", F.array_distinct(F.concat("tokens", bigrams(F.col("tokens")))))
    return HashingTF(inputCol="__terms", outputCol="features", numFeatures=_DIMENSIONS, binary=True).transform(terms).drop("__terms")


def _thinned(rows: DataFrame, copies: int, seed: int) -> DataFrame:
    """Each text whole and in further copies, each less a hashed seventh of its words and now and then a half."""
    n = F.explode(F.sequence(F.lit(0), F.lit(copies))).alias("n")
    rows = rows.select("family", "text", "fold", words(F.col("text")).alias("w"), n)
    chance = F.pmod(F.xxhash64("text", "n", F.lit(seed)), F.lit(4))
    half = F.ceil(F.size("w") / 2).cast("int")
    part = F.when((F.col("n") > 0) & (chance == 0) & (F.size("w") > 12), F.slice("w", 1, half)).when((F.col("n") > 0) & (chance == 1) & (F.size("w") > 12), F.slice("w", half, F.size("w"))).otherwise(F.col("w"))
    kept = F.filter(part, lambda x, i: (F.col("n") == 0) | (F.pmod(F.xxhash64(x, i, F.col("n"), F.lit(seed)), F.lit(7)) > 0))
    return rows.select("family", "text", "fold", "n", kept.alias("tokens"))


@dataclass
class Classifier:
    model: LogisticRegressionModel
    temperature: float = 1.0
    least: float = 0.5
    """Calibrated: a family less likely than this is unknown."""
    reliability: list[tuple[float, float, int]] = field(default_factory=list)
    """Of readings that the scoring model had not seen, by tenths: mean probability, share that was right, number."""


def fit(lines: DataFrame, most_lines: int = 400, copies: int = 12, seed: int = 5, confirm: float = 0.5, most_words: int = 60) -> Classifier:
    """Train on the fixed texts and at most ``most_lines`` of ``lines`` (text), and half as many with a cue that no template comes near, taken by hash, as further unknowns.

    Of a line among these unknowns the first ``most_words`` words are learned from: about the length of the longest template, so that length doesn't tell them apart. What is classified is never cut.
    """
    spark = lines.sparkSession
    texts = lines.select("text").distinct()
    order = (F.xxhash64("text"), "text")
    # no line of a common bigram with a template is called unknown
    own = F.array_distinct(bigrams(F.col("tokens")))
    known = F.array(*map(F.lit, sorted({f"{x} {y}" for _, t in TEMPLATES for x, y in _pairs_of(t)})))
    unlike = lambda df: df.select("text", F.slice(words(F.col("text")), 1, most_words).alias("tokens")).where(5 * F.size(F.array_intersect(own, known)) <= F.size(own))
    plain = texts.where(~F.col("text").rlike(CUES)).orderBy(*order).limit(most_lines)
    cued = texts.where(F.col("text").rlike(CUES)).orderBy(*order).limit(most_lines // 2)
    corpus = unlike(plain).union(unlike(cued)).select(F.lit(UNKNOWN).alias("family"), "text", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), F.lit(0).alias("n"), "tokens")
    rows = _thinned(_table(spark, TEMPLATES + [(UNKNOWN, t) for t in GENERAL]), copies, seed).union(corpus)
    label = F.array_position(_names(), F.col("family")).cast("double") - 1
    rows = cut(_hashed(rows.withColumn("label", label)).select("family", "fold", "label", "tokens", "features").repartition(1))
    learn = LogisticRegression(maxIter=60, regParam=0.002, family="multinomial")
    unseen = reduce(DataFrame.union, (learn.fit(rows.where(F.col("fold") != k)).transform(rows.where(F.col("fold") == k)).select("family", "label", "tokens", "rawPrediction") for k in range(FOLDS)))
    unseen = cut(unseen)
    right = lambda t: F.get(_softmax(t), F.col("label").cast("int"))
    losses = unseen.agg(*(F.avg(-F.log(F.greatest(right(t), F.lit(1e-12)))).alias(str(k)) for k, t in enumerate(_TEMPERATURES))).first()
    temperature = _TEMPERATURES[min(range(len(losses)), key=lambda k: losses[k] if losses[k] is not None else 0.0)]
    best = cut(_matched(_best(unseen, temperature)).select("p", (F.col("guess") == F.col("family")).cast("int").alias("right"), (F.col("family") != UNKNOWN).cast("int").alias("notice"), ((F.col("guess") != UNKNOWN) & (F.col("match") >= confirm)).alias("reported")))
    tenths = best.groupBy(F.floor(F.col("p") * 10).alias("t")).agg(F.avg("p").alias("p"), F.avg("right").alias("right"), F.count("*").alias("n")).orderBy("t").collect()
    limits = [0.5 + 0.05 * k for k in range(10)]
    shares = best.where("reported").agg(*(F.avg(F.when(F.col("p") >= t, F.col("notice"))).alias(str(k)) for k, t in enumerate(limits))).first()
    least = next((t for t, share in zip(limits, shares) if share is not None and share >= 0.95), limits[-1])
    return Classifier(learn.fit(rows), temperature, least, [(r.p, r.right, r.n) for r in tenths])


def _softmax(temperature: float) -> Column:
    raw = F.transform(vector_to_array("rawPrediction"), lambda x: x / F.lit(temperature))
    e = F.transform(raw, lambda x: F.exp(x - F.array_max(raw)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _best(scored: DataFrame, temperature: float) -> DataFrame:
    scored = scored.withColumn("probability", _softmax(temperature))
    top = F.array_max("probability")
    return scored.withColumn("p", top).withColumn("guess", F.element_at(_names(), F.array_position("probability", top).cast("int")))


def classify(paragraphs: DataFrame, classifier: Classifier, confirm: float = 0.5) -> DataFrame:
    """``paragraphs`` (tokens and more) with family ("unknown" if unsure or unconfirmed), p match (the best template's share of common bigrams) and common (the most common bigrams with one)."""
    scored = _matched(_best(classifier.model.transform(_hashed(paragraphs)), classifier.temperature).drop("features", "rawPrediction", "probability", "prediction"))
    sure = (F.col("p") >= classifier.least) & (F.col("match") >= confirm)
    return scored.withColumn("family", F.when(sure, F.col("guess")).otherwise(UNKNOWN)).drop("guess")


def _matched(scored: DataFrame) -> DataFrame:
    """Adds match and common, of the templates of the guessed family."""
    templates = _table(scored.sparkSession, TEMPLATES).groupBy("family").agg(F.collect_list(F.array_distinct(bigrams(words(F.col("text"))))).alias("__templates"))
    scored = scored.join(F.broadcast(templates.withColumnRenamed("family", "guess")), "guess", "left")
    own = F.array_distinct(bigrams(F.col("tokens")))
    match = F.array_max(F.transform("__templates", lambda t: F.size(F.array_intersect(own, t)) / F.greatest(F.least(F.size(t), F.size(own)), F.lit(1))))
    common = F.array_max(F.transform("__templates", lambda t: F.size(F.array_intersect(own, t))))
    return scored.withColumn("match", F.coalesce(match, F.lit(0.0))).withColumn("common", F.coalesce(common, F.lit(0))).drop("__templates")


def scan(docs: DataFrame, classifier: Classifier | None = None, confirm: float = 0.5, doc_id: str = "doc_id", text: str = "text", train_docs: int = 200) -> DataFrame:
    """doc_id, n_candidates (lines with a cue), n_licences (those given a family), families (sorted, comma-joined), findings (line:family, lines counted from 1, comma-joined) of every row.

    A line takes the surest of its three readings: alone, with the next line, with the next two. Null texts have no line. Rows are told apart by hashes of id and text, so repeated rows get equal results and rows of one id their own; of readings that are equally sure the greatest family by name counts. Only candidate lines are classified; a text costs time in proportion to its words and lines. Without a classifier, one is trained here, with lines of ``train_docs`` documents as unknowns.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    if classifier is None:
        # lines of the documents of the least hashed ids: the bound on what training sees
        some = base.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
        classifier = fit(some.select(F.explode(F.split("t", "\n")).alias("text")).where("length(text) > 20"))
    lines = F.split(F.col("t"), "\n")
    # Each line with the next two and its number, paired once for a text and not line by line.
    n = F.size(lines)
    rows = F.arrays_zip(lines, F.slice(lines, F.lit(2), n), F.slice(lines, F.lit(3), n), F.sequence(F.lit(1), n))
    # a cue may end in the line after the one it begins in
    more = lambda x: F.regexp_extract(F.concat_ws(" ", x["1"], x["2"]), r"^[^\p{L}\p{N}]*[\p{L}\p{N}]+", 0)
    found = F.filter(rows, lambda x: x["0"].rlike(CUES) | F.concat_ws(" ", x["0"], more(x)).rlike(CUES))
    found = F.transform(found, lambda x: F.struct(x["3"].alias("line"), x["0"].rlike(CUES).alias("own"), x["0"].alias("text"), F.concat_ws(" ", x["0"], x["1"]).alias("two"), F.concat_ws(" ", x["0"], x["1"], x["2"]).alias("wide")))
    none = F.array().cast("array<struct<line:int,own:boolean,text:string,two:string,wide:string>>")
    found = cut(base.select("doc_id", F.xxhash64("doc_id", "t").alias("h1"), F.hash("t", "doc_id").alias("h2"), F.when(F.col("t").rlike(CUES), found).otherwise(none).alias("found")))
    each = found.where(F.size("found") > 0).dropDuplicates(["h1", "h2"]).select("h1", "h2", F.explode("found").alias("x"))
    each = each.select("h1", "h2", "x.line", F.posexplode(F.array("x.text", "x.two", "x.wide")).alias("more", "reading")).withColumn("last", F.col("line") + F.col("more"))
    judged = classify(each.withColumn("tokens", words(F.col("reading"))), classifier, confirm).where(F.col("family") != UNKNOWN)
    judged = cut(judged.select("h1", "h2", "line", "last", "family", "p", "match", "common"))
    # a notice that begins in a later line of the reading is that line's own
    later = judged.select("h1", "h2", "family", F.explode(F.array(F.col("line") - 1, F.col("line") - 2)).alias("line"), F.col("last").alias("l2"), F.col("common").alias("c2"))
    whole = judged.join(later, ["h1", "h2", "family", "line"]).where("l2 <= last AND c2 >= common").select("h1", "h2", "family", "line", "last").distinct()
    judged = judged.join(whole, ["h1", "h2", "family", "line", "last"], "left_anti")
    by_line = judged.groupBy("h1", "h2", "line").agg(F.max_by("family", F.struct("p", "match", "family")).alias("family"))
    by_row = by_line.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("line", "family"))).alias("hits"))
    out = found.join(by_row, ["h1", "h2"], "left")
    hits = F.coalesce("hits", F.array().cast("array<struct<line:int,family:string>>"))
    return out.select(
        "doc_id",
        F.size(F.filter("found", lambda x: x["own"])).cast("long").alias("n_candidates"),
        F.size(hits).cast("long").alias("n_licences"),
        F.array_join(F.sort_array(F.array_distinct(F.transform(hits, lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform(hits, lambda x: F.concat_ws(":", x["line"].cast("string"), x["family"])), ",").alias("findings"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
