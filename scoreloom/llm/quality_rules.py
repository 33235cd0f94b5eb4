"""Quality rules as learned decision lists.

Statistics of every text are computed in one narrow pass. A list of rules, each a conjunction of
thresholds on these statistics, is learned on the driver from a bounded sample of labelled rows by
sequential covering: a rule is grown on two thirds of the uncovered sample by information gain,
pruned on the rest, and kept while its precision there holds. The list is emitted as one ordered
Spark conditional expression, so the verdicts are plain column arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .cut import added_prefix

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_letters", "n_upper", "n_bangs", "n_digits", "n_bars", "n_same_next", "n_lines")
RATIOS = {
    "symbols_a_word": ("n_symbols", "n_words"),
    "bars_a_word": ("n_bars", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "bangs_a_word": ("n_bangs", "n_words"),
    "digits_a_char": ("n_digits", "word_chars"),
    "word_length": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "same_next_share": ("n_same_next", "n_words"),
}
FEATURES = ("n_words", *RATIOS)
_SYMBOLS = K.byte_set(*((ord(c), ord(c)) for c in "#*$%&|<>"))
_CLASSES = {"n_symbols": _SYMBOLS, "n_letters": K.byte_set((65, 90), (97, 122)), "n_upper": K.byte_set((65, 90)), "n_bangs": K.byte_set((33, 33)), "n_digits": K.byte_set((48, 57)), "n_bars": K.byte_set((124, 124))}
REPEAT = 5


def repeated(hashes: np.ndarray, first: np.ndarray, later_only: bool = False) -> np.ndarray:
    """Mask of the values that occur more than once within their text (``later_only``: an earlier time)."""
    out = np.zeros(len(hashes), bool)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a > 1:
            part = hashes[a:b]
            order = np.argsort(part, kind="stable")
            same = part[order[1:]] == part[order[:-1]]
            if same.any():
                out[a + order[1:][same]] = True
                if not later_only:
                    out[a + order[:-1][same]] = True
    return out


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, first = K.spans(data, offsets, K.NOT_SPACE)
    words = K.hashes(data, starts, ends)
    out = {"n_words": np.diff(first)}
    out["word_chars"] = K.count_in(K.NOT_SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    for name, members in _CLASSES.items():
        out[name] = K.count_in(members[data], offsets)
    owner = K.owners(first)
    grams, inside = K.ngrams(words, REPEAT), K.whole(first, REPEAT, owner)
    # windows of each text are its first n-4 places
    own = np.concatenate([[0], np.cumsum(np.maximum(np.diff(first) - REPEAT + 1, 0))])
    places = np.flatnonzero(inside)
    twice = places[repeated(grams[places], own)]
    marks = np.zeros(len(words) + 1, np.int64)
    marks[twice] += 1
    np.add.at(marks, twice + REPEAT, -1)
    out["n_repeat_words"] = K.per_text(np.cumsum(marks)[:-1] > 0, first)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    out["n_same_next"] = K.per_text(same, first)
    a, b, line = K.lines(data, offsets)
    filled = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    kept = np.flatnonzero(filled)
    own = np.searchsorted(kept, line)
    out["n_dup_lines"] = np.diff(np.concatenate([[0], np.cumsum(repeated(K.hashes(data, a[kept], b[kept]), own, True))])[own])
    out["n_lines"] = np.diff(own)
    return out


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the counts of its texts as further columns; a null text has none of anything.

    A window is five consecutive words of a text. Empty lines, and lines without a word, never count as repeated. Columns that are there already under these names are replaced. A very long text takes time and memory about linear in its length, some 40 bytes a word.
    """
    names = [prefix + c for c in (*COUNTS, *MORE)]
    docs = docs.drop(*names)
    at, columns = docs.columns.index(text), docs.columns
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{n}` bigint" for n in names])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.slices(batch, at):
                found = text_counts(data, offsets)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[c].astype(np.int64)) for c in (*COUNTS, *MORE))], names=[*columns, *names])

    return docs.mapInArrow(count, fields)


def ratio(feature: str, prefix: str = "") -> Column:
    if feature not in RATIOS:
        return F.col(prefix + feature).cast("double")
    a, b = RATIOS[feature]
    return F.col(prefix + a).cast("double") / F.greatest(F.col(prefix + b), F.lit(1)).cast("double")


@dataclass(frozen=True)
class Rule:
    """Texts that fulfil all conditions (feature, above, threshold) are rejected: feature > threshold if above, else <=."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for name, above, limit in self.conditions:
            out = out & (ratio(name, prefix) > F.lit(limit) if above else ratio(name, prefix) <= F.lit(limit))
        return out

    def mask(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, limit in self.conditions:
            v = x[:, FEATURES.index(name)]
            out &= v > limit if above else v <= limit
        return out


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """Ordered conditional expression: false for the first rule that fits, true where none does."""
    out = None
    for rule in rules:
        out = F.when(rule.column(prefix), F.lit(False)) if out is None else out.when(rule.column(prefix), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn_rules(x: np.ndarray, bad: np.ndarray, min_precision: float = 0.9, min_cover: int = 5, most_rules: int = 12, most_conditions: int = 3, seed: int = 7) -> list[Rule]:
    """Sequential covering. x: a row per text, a column per FEATURES; bad: what to cover.

    Empty input, or input of one class, gives no rule.
    """
    rules: list[Rule] = []
    if not len(x) or not bad.any() or bad.all():
        return rules
    grow = np.random.default_rng(seed).random(len(x)) < 2 / 3
    left = np.ones(len(x), bool)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])) for j in range(x.shape[1])]
    # midpoints between neighbouring distinct cuts keep a threshold off the values themselves
    cuts = [np.concatenate([(c[1:] + c[:-1]) / 2, c[-1:]]) if len(c) > 1 else c for c in cuts]

    def quality(mask: np.ndarray, part: np.ndarray) -> tuple[float, int, int]:
        p, n = int((mask & part & bad).sum()), int((mask & part & ~bad).sum())
        return (p + 1) / (p + n + 2), p, n

    while len(rules) < most_rules:
        g = left & grow
        conditions: list[tuple[str, bool, float]] = []
        mask = np.ones(len(x), bool)
        for _ in range(most_conditions):
            p0, n0 = (mask & g & bad).sum(), (mask & g & ~bad).sum()
            if not n0 or not p0:
                break
            base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
            for j, name in enumerate(FEATURES):
                v, y = x[mask & g, j], bad[mask & g]
                for limit in cuts[j]:
                    above = v > limit
                    for side, m in ((True, above), (False, ~above)):
                        p = int((m & y).sum())
                        if p >= min_cover:
                            gain = p * (np.log2(p / m.sum()) - base)
                            if gain > best[0] + 1e-9:
                                best = (gain, (name, side, float(limit)))
            if best[1] is None:
                break
            conditions.append(best[1])
            mask = Rule(tuple(conditions)).mask(x)
        if not conditions:
            break
        # drop final conditions while that doesn't lower the value on the pruning part
        part = left & ~grow
        while len(conditions) > 1 and quality(Rule(tuple(conditions[:-1])).mask(x), part)[0] >= quality(Rule(tuple(conditions)).mask(x), part)[0]:
            conditions.pop()
        rule = Rule(tuple(conditions))
        value, p, n = quality(rule.mask(x), part)
        whole_value, whole_p, _ = quality(rule.mask(x), left)
        if p + n == 0 or value < min_precision - 0.1 or whole_value < min_precision or whole_p < min_cover:
            break
        rules.append(rule)
        left &= ~rule.mask(x)
    return rules


def sample_of(labels: DataFrame, docs: DataFrame, label: str, most: int, doc_id: str = "doc_id", text: str = "text", where: Column | None = None) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled rows, taken by a hash of the id, so alike on every run. Ids with contrary labels, and null labels, are left out."""
    picked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if where is not None:
        picked = picked.where(where)
    picked = picked.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("__other")).where("label = __other").drop("__other")
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return texts.join(F.broadcast(picked), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_labelled: int = 8_000, doc_id: str = "doc_id", text: str = "text", **options) -> list[Rule]:
    """Learn the list from at most ``most_labelled`` labelled rows, of those the ones that pass the base rules; label 0 is what it rejects."""
    counted = with_counts(sample_of(labels, docs, label, most_labelled, doc_id, text)).drop("text").where(~base_failed())
    rows = counted.select("doc_id", F.col("label").cast("int").alias("label"), *(ratio(f).alias(f"f_{f}") for f in FEATURES)).toPandas().sort_values(["doc_id", *(f"f_{f}" for f in FEATURES)])
    return learn_rules(rows[[f"f_{f}" for f in FEATURES]].to_numpy(float), rows["label"].to_numpy() == 0, **options)


def base_failed(prefix: str = "") -> Column:
    words, again = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (words < 10) | (100 * again > 20 * words)


def judge(docs: DataFrame, rules: list[Rule], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row; null and empty texts fail for want of words."""
    out = with_counts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text")
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def filter_docs(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only."""
    prefix = added_prefix(docs)
    return with_counts(docs, text, prefix).where(~base_failed(prefix) & verdict(rules, prefix)).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, fit(docs, labels)).select("doc_id", *COUNTS, "base_failed", "kept", *MORE)
