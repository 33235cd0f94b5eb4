"""Benchmark decontamination by winnowing.

Both sides are cut into words; of each window of ``guarantee - k + 1`` consecutive k-gram hashes the
least is kept. Two texts that share ``guarantee`` words in a row share a kept hash, so joining the
kept hashes finds every such span; a hit is then extended to full windows and only whole windows
count. Items shorter than the window are one window of their own length and are looked up by the
hash of that length.

The benchmark is the query set. It is read on the driver in blocks of at most ``block_words`` words,
and each block's fingerprint index (about 40 bytes a word) is broadcast; further blocks are further
narrow steps over the same partitions. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .cut import added_prefix

WINDOW, GRAM = 13, 7
_BITS = 20
_ON = K.byte_set((1, 1))


def kept_hashes(grams: np.ndarray, in_window: np.ndarray, width: int) -> np.ndarray:
    """Mask of the k-gram places that are the least of some window of ``width`` places. in_window: windows (by first place) that lie in one text."""
    m = len(in_window)
    chosen = np.zeros(len(grams), bool)
    if m <= 0:
        return chosen
    least = grams[:m].copy()
    for j in range(1, width):
        np.minimum(least, grams[j : j + m], out=least)
    least[~in_window] = 0
    reach = np.zeros(len(grams), K.U)
    for j in range(width):
        np.maximum(reach[j : j + m], least, out=reach[j : j + m])
    return (reach == grams) & (reach > 0)


class Index:
    """Fingerprints of some benchmark items: kept k-gram hashes with their places, and hashes of short items."""

    def __init__(self, ids: list, texts: list, window: int = WINDOW, gram: int = GRAM):
        self.ids, self.window, self.gram = [str(x) for x in ids], window, gram
        joined = pa.array(texts, pa.string()).fill_null("")
        parts, counts = [], []
        for _, data, offsets in K.slices(pa.record_batch([joined], ["t"]), 0):
            starts, ends, first = K.spans(data, offsets, K.ALNUM)
            parts.append(K.hashes(data, starts, ends, fold=True))
            counts.append(np.diff(first))
        words = np.concatenate(parts) if parts else np.zeros(0, K.U)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])
        owner = K.owners(first)
        self.full = K.ngrams(words, window)
        grams = K.ngrams(words, gram)
        width = window - gram + 1
        chosen = np.flatnonzero(kept_hashes(grams, K.whole(first, window, owner), width))
        order = np.argsort(grams[chosen], kind="stable")
        self.places = chosen[order]
        self.hashes = grams[self.places]
        self.owner = owner
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({int(c) for c in counts if 0 < c < window}):
            items = np.flatnonzero(counts == n)
            hashes = K.ngrams(words, n)[first[items]]
            order = np.argsort(hashes, kind="stable")
            self.short[n] = hashes[order], items[order]
        self.maybe = self._filter(self.hashes)
        self.maybe_short = {n: self._filter(h) for n, (h, _) in self.short.items()}

    @staticmethod
    def _filter(hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << _BITS, bool)
        out[(hashes >> K.U(64 - _BITS)).astype(np.int64)] = True
        return out

    @staticmethod
    def _join(hashes: np.ndarray, places: np.ndarray, maybe: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (place, index of key) with equal hashes; keys are sorted."""
        places = places[maybe[(hashes[places] >> K.U(64 - _BITS)).astype(np.int64)]]
        a = np.searchsorted(keys, hashes[places], "left")
        n = np.searchsorted(keys, hashes[places], "right") - a
        at = np.repeat(places, n)
        within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return at, np.repeat(a, n) + within

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurring windows of a block of texts: first word, length, item number."""
        owner = K.owners(first)
        found = []
        if len(self.hashes) and len(words) >= self.window:
            grams, width = K.ngrams(words, self.gram), self.window - self.gram + 1
            inside = K.whole(first, self.window, owner)
            at, key = self._join(grams, np.flatnonzero(kept_hashes(grams, inside, width)), self.maybe, self.hashes)
            if len(at):
                full, there = K.ngrams(words, self.window), self.places[key]
                for back in range(width):
                    s, q = at - back, there - back
                    ok = (s >= 0) & (q >= 0) & (s < len(full)) & (q < len(self.full))
                    s, q = s[ok], q[ok]
                    ok = inside[s] & (self.owner[q] == self.owner[np.minimum(q + self.window - 1, len(self.owner) - 1)]) & (full[s] == self.full[q])
                    found.append((s[ok], np.full(ok.sum(), self.window), self.owner[q[ok]]))
        for n, (hashes, items) in self.short.items():
            grams = K.ngrams(words, n)
            at, key = self._join(grams, np.flatnonzero(K.whole(first, n, owner)), self.maybe_short[n], hashes)
            found.append((at, np.full(len(at), n), items[key]))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found) if found else ([], [], [])))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[tuple[list, list]]:
    ids, texts, words = [], [], 0
    for row in benchmark.select(id_col, text_col).where(F.col(id_col).isNotNull()).toLocalIterator():
        n = len(row[1] or "") // 2 + 1
        if ids and words + n > block_words:
            yield ids, texts
            ids, texts, words = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        words += n
    yield ids, texts


def overlap(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, block_words: int = 4_000_000, keep: bool = False) -> DataFrame:
    """How much of each document occurs in the benchmark.

    One row per row of ``docs``: the id, n_words, n_hit (words inside any occurrence of an item
    window), n_items, items_sha256 (of the comma-joined, string-sorted item ids), item_ids, hit_spans
    ([first, end) word numbers, merged). With ``keep`` all columns of ``docs`` come too, and these
    get the prefix ``added_prefix(docs)``, two underscores or as many as no column begins with.

    A null or empty text has no words; an item without words or without id is ignored; repeated items
    and rows each count (an id once); an empty benchmark hits nothing.
    A very long text takes linear time and some 60 bytes a word; one benchmark item is never parted, so a
    block is as large as its largest item.
    """
    spark = docs.sparkSession
    p = added_prefix(docs) if keep else ""
    base = docs if keep else docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    at = base.columns.index(text if keep else "text")
    state = [("n_words", "bigint"), ("hit_spans", "array<int>"), ("item_ids", "array<string>")]
    columns = base.columns
    out = base
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    w = added_prefix(docs)
    own = ", ".join(f"`{w}{n}` {t}" for n, t in state)
    for i, (ids, texts) in enumerate(_blocks(benchmark, item_id, item_text, block_words)):
        index = spark.sparkContext.broadcast(Index(ids, texts, window, gram))

        def scan(batches: Iterator[pa.RecordBatch], index=index, first_block=i == 0) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for batch in batches:
                for part, data, offsets in K.slices(batch, at):
                    starts, ends, first = K.spans(data, offsets, K.ALNUM)
                    words = K.hashes(data, starts, ends, fold=True)
                    place, length, item = ix.hits(words, first)
                    spans: dict[int, list[int]] = {}
                    items: dict[int, set[str]] = {}
                    if len(place):
                        marks = np.zeros(len(words) + 1, np.int64)
                        np.add.at(marks, place, 1)
                        np.add.at(marks, place + length, -1)
                        inside = (np.cumsum(marks)[:-1] > 0).astype(np.uint8)
                        runs, over, own_runs = K.spans(inside, first, _ON)
                        for d, a, b in zip(K.owners(own_runs).tolist(), runs.tolist(), over.tolist()):
                            spans.setdefault(d, []).extend((a - int(first[d]), b - int(first[d])))
                        for d, j in set(zip((np.searchsorted(first, place, "right") - 1).tolist(), item.tolist())):
                            items.setdefault(d, set()).add(ix.ids[j])
                    n = part.num_rows
                    if not first_block:
                        for d, x in enumerate(part.column(len(columns) + 1).to_pylist()):
                            if x:
                                spans[d] = merged(spans.get(d, []) + x)
                        for d, x in enumerate(part.column(len(columns) + 2).to_pylist()):
                            if x:
                                items.setdefault(d, set()).update(x)
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(np.diff(first)), pa.array([spans.get(d, []) for d in range(n)], pa.list_(pa.int32())), pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string()))], names=[*columns, *(f"{w}{x}" for x, _ in state)])

        out = out.mapInArrow(scan, f"{fields}, {own}")
    spans = F.col(w + "hit_spans")
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size(spans) - 1), F.lit(0).cast("long"), lambda s, i: s + F.when(i % 2 == 1, F.get(spans, i)).otherwise(-F.get(spans, i)))
    out = out.withColumn(w + "n_hit", F.when(F.size(spans) > 0, n_hit).otherwise(F.lit(0).cast("long")))
    own = [
        F.col(w + "n_words").alias(f"{p}n_words"),
        F.col(w + "n_hit").alias(f"{p}n_hit"),
        F.size(w + "item_ids").cast("long").alias(f"{p}n_items"),
        F.sha2(F.array_join(w + "item_ids", ","), 256).alias(f"{p}items_sha256"),
        F.col(w + "item_ids").alias(f"{p}item_ids"),
        F.col(w + "hit_spans").alias(f"{p}hit_spans"),
        ((F.col(w + "n_hit") > 0) & (20 * F.col(w + "n_hit") >= F.col(w + "n_words"))).alias(f"{p}contaminated"),
    ]
    return out.select(*(F.col(f"`{c}`") for c in columns if keep or c == "doc_id"), *own)


def merged(flat: list[int]) -> list[int]:
    """Union of [first, end) spans given as a flat list."""
    out: list[int] = []
    for a, b in sorted(zip(flat[::2], flat[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated (a twentieth of their words or more inside benchmark windows)."""
    return overlap(docs, benchmark, doc_id, text, keep=True, **options).where(~F.col(added_prefix(docs) + "contaminated")).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return overlap(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("item_ids", "hit_spans")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
dg AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM di),
hit AS (SELECT doc_id, i, win.n AS n, item_id FROM dg JOIN win ON win.g = dg.g AND win.n = dg.n),
marked AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hit),
h AS (SELECT doc_id, count(*) AS n_hit FROM marked GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
