"""Line dedup by pairwise alignment.

Lines are hashed, and so are the shortest runs of consecutive lines that reach ``min_block_words``
words; a run that several documents hold links them, whatever its lines are. While a run is rare
(``rare`` documents or fewer) each of its documents is paired with every earlier one. Of a more
frequent run each document is paired with the earliest; if lines of the run are left then, with the
next earliest ones, four times as many a round, until the lines are gone or all earlier holders were
tried (of those that align alike, the earliest). So the result is that of all pairs that share a run,
though a run that very many share mostly gives one pair a document. A pair is aligned by patience
diff: lines that are unique in both documents anchor the longest increasing chain, gaps between
anchors are aligned again, and runs extend over equal neighbours. Aligned runs of ``min_block_words``
words or more in consecutive lines are deleted from the later document of the pair; the earlier keeps
them. Earlier is the lesser doc_id.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .cut import cut, unused


#: Partners of an earlier document that are aligned in one group.
GROUP = 256


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: j for j, x in zip(range(b0, b1), b[b0:b1]) if once_b[x] == 1}
        pairs = [(i, where[x]) for i, x in zip(range(a0, a1), a[a0:a1]) if once_a[x] == 1 and x in where]
        if not pairs:
            # repeated lines only: each line of a is matched with the next of b that is left
            places: dict[int, list[int]] = {}
            for j in range(b0, b1):
                places.setdefault(b[j], []).append(j)
            j = b0
            for i in range(a0, a1):
                if own := places.get(a[i]):
                    k = bisect_left(own, j)
                    if k < len(own):
                        out.append((i, own[k]))
                        j = own[k] + 1
            continue
        tails: list[int] = []
        ends: list[int] = []
        back = [-1] * len(pairs)
        for k, (_, j) in enumerate(pairs):
            p = bisect_left(tails, j)
            tails[p : p + 1] = [j]
            ends[p : p + 1] = [k]
            back[k] = ends[p - 1] if p else -1
        chain, k = [], ends[-1]
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        chain.reverse()
        out += chain
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        todo += [(i + 1, i2, j + 1, j2) for (i, j), (i2, j2) in zip(edges, edges[1:]) if i + 1 < i2 and j + 1 < j2]
    return sorted(out)


def common_blocks(a: list[int], a_at: list[int], b: list[int], b_at: list[int], words: list[int], least: int) -> list[int]:
    """Line numbers of b in aligned runs of ``least`` words or more. a, b: line hashes; a_at, b_at: their line numbers; words: of b's lines."""
    out: list[int] = []
    run: list[int] = []
    total, last = 0, None
    for i, j in [*patience(a, b), (-1, -1)]:
        if last is None or i < 0 or a_at[i] != last[0] + 1 or b_at[j] != last[1] + 1:
            if total >= least:
                out += run
            run, total = [], 0
            if i < 0:
                break
        run.append(b_at[j])
        total += words[j]
        last = a_at[i], b_at[j]
    return out


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, n_lines, hashes, words) of every row that has an id; lines without words count 0 words. Blank lines are left out of the numbering, so they don't part blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.slices(batch, 1):
                starts, ends, line = K.lines(data, offsets)
                words, _, _ = K.spans(data, offsets, K.NOT_SPACE)
                n = np.searchsorted(words, ends) - np.searchsorted(words, starts)
                filled = np.flatnonzero(n)
                own = np.searchsorted(filled, line).astype(np.int32)
                hashes = K.hashes(data, starts[filled], ends[filled])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(own, pa.array(hashes.view(np.int64))), pa.ListArray.from_arrays(own, pa.array(n[filled].astype(np.int32)))], names=["doc", "hashes", "words"])

    return docs.mapInArrow(run, f"doc {dict(docs.dtypes)['doc']}, hashes array<bigint>, words array<int>")


def runs_of(at: list[int], hashes: list[int], words: list[int], least: int) -> list[tuple[int, int, int]]:
    """(hash, first line, last line) of the shortest runs of consecutive lines that reach ``least`` words, from each line on and back from each line. Each line of a longer run is in one that lies within it."""
    found = set()
    for step in (1, -1):
        for i in range(len(at)):
            j, total = i, words[i]
            while total < least and 0 <= j + step < len(at) and at[j + step] == at[j] + step:
                j += step
                total += words[j]
            if total >= least:
                found.add((min(i, j), max(i, j)))
    return [(_hash(hashes[i : j + 1]), at[i], at[j]) for i, j in sorted(found)]


def _hash(values: list[int]) -> int:
    return int.from_bytes(blake2b(b"".join(x.to_bytes(8, "little", signed=True) for x in values), digest_size=8).digest(), "little", signed=True)


def _runs(seqs: DataFrame, kind: str, least: int) -> DataFrame:
    """(doc, like, run, lo, hi) for each run of ``runs_of``. Documents of one ``like`` have the same lines and the same gaps, so they align alike with any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, at, hashes, words in zip(*(c.to_pylist() for c in batch.columns)):
                like = _hash([x for k, h in enumerate(hashes) for x in (h, int(k > 0 and at[k] == at[k - 1] + 1))])
                rows += [(doc, like, h, lo, hi) for h, lo, hi in runs_of(at, hashes, words, least)]
            if rows:
                doc, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(doc, batch.column(0).type), *(pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.int64(), pa.int32(), pa.int32())))], names=["doc", "like", "run", "lo", "hi"])

    flat = seqs.select("doc", "s.at", "s.hash", "s.words")
    return flat.mapInArrow(run, f"doc {kind}, like bigint, run bigint, lo int, hi int")


def _least(rows: DataFrame, count: int, parts: int = 64) -> DataFrame:
    """The ``count`` least a of each run (run, a). A run that very many hold is first thinned in parts by hash, so that it is not one task."""
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("a")) <= count
    rows = rows.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(parts)))
    thin = rows.withColumn("one", first("run", "part")).where("one")
    return thin.withColumn("one", first("run")).where("one").select("run", "a")


def duplicate_lines(docs: DataFrame, min_block_words: int = 5, rare: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, gone): for each document that loses lines, the sorted numbers of these among its filled lines."""
    base = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL")
    kind = dict(base.dtypes)["doc"]
    lines = cut(_lines(base).select("doc", F.posexplode(F.arrays_zip("hashes", "words")).alias("at", "x")).select("doc", "at", F.col("x.hashes").alias("hash"), F.col("x.words").alias("words")))
    by_line = lines.select("doc", "hash").distinct()
    # written, so that the join reads plain exchanges, of which AQE can split a very frequent line
    held = cut(by_line.groupBy("hash").agg(F.count("*").alias("held")).where("held > 1"))
    # each document as the lines that others hold too: only they can align
    seqs = cut(lines.join(held, "hash").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("at", "hash", "words"))).alias("s")))
    runs = cut(_runs(seqs, kind, min_block_words))
    held = cut(runs.select("doc", "run").distinct().groupBy("run").agg(F.count("*").alias("held"), F.min("doc").alias("first")).where("held > 1"))
    runs = cut(runs.join(held, "run"))
    often = runs.where(F.col("held") > rare).where("doc > first").select(F.col("first").alias("a"), F.col("doc").alias("b"))
    few = runs.where(F.col("held") <= rare).groupBy("run").agg(F.collect_set("doc").alias("docs"))
    few = few.select(F.explode("docs").alias("b"), "docs").select("b", F.explode("docs").alias("a")).where("a < b").select("a", "b")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams groups: first the lines of the earlier document, then those of its partners."""
        group = lines_of = None
        for batch in batches:
            docs, out = [], []
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
            for k, (earlier, part, later) in enumerate(keys):
                at, hashes, words = (batch.column(c)[k].as_py() for c in (3, 4, 5))
                if later is None:
                    group, lines_of = (earlier, part), (hashes, at)
                elif group == (earlier, part):
                    docs.append(k)
                    out.append(common_blocks(*lines_of, hashes, at, words, min_block_words))
            if docs:
                yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(docs)), pa.array(out, pa.list_(pa.int32()))], names=["doc", "gone"])

    def aligned(pairs: DataFrame) -> DataFrame:
        """(doc, at): lines that pairs (a, b) take from b. An earlier document's lines go once to each group of ``GROUP`` partners or so, however many it has."""
        pairs = cut(pairs.distinct())
        # written, so that AQE can split the pairs of a document with very many partners in the join
        parts = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(float(GROUP))).cast("int").alias("parts")))
        dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
        own = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(seqs, F.col("a") == F.col("doc")).select("a", "part", F.lit(None).cast(kind).alias("b"), "s")
        both = own.unionByName(dealt.join(seqs, F.col("b") == F.col("doc")).select("a", "part", "b", "s"))
        both = both.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        return both.select("a", "part", "b", "s.at", "s.hash", "s.words").mapInArrow(align, f"doc {kind}, gone array<int>").select("doc", F.explode("gone").alias("at"))

    def by_doc(gone: DataFrame) -> DataFrame:
        return gone.distinct().groupBy("doc").agg(F.sort_array(F.collect_list("at")).alias("gone"))

    def still(rows: DataFrame) -> DataFrame:
        """Those runs of which a line is left."""
        whole = F.size(F.array_except(F.sequence("lo", "hi"), F.coalesce("gone", F.array().cast("array<int>")))) == 0
        return rows.join(gone, "doc", "left").where(~whole).select("doc", "run", "lo", "hi")

    gone = cut(by_doc(aligned(often.union(few))))
    todo = cut(still(runs.where(F.col("held") > rare).where("doc > first")))
    if todo.isEmpty():
        return gone
    # holders that align alike are one, the earliest; the first of all is done
    held = runs.join(todo.select("run").distinct(), "run", "left_semi").groupBy("run", "like").agg(F.min("doc").alias("a"))
    held = cut(held.select("run", "a"))
    tried, count = held.groupBy("run").agg(F.min("a").alias("tried")), rare
    while True:
        ahead = held.join(tried, "run").where("a > tried").select("run", "a")
        todo = cut(todo.join(ahead.groupBy("run").agg(F.min("a").alias("next")), "run").where("next < doc").drop("next"))
        if todo.isEmpty():
            return gone
        some = cut(_least(ahead.join(todo.select("run").distinct(), "run", "left_semi"), count))
        pairs = todo.select("doc", "run").distinct().join(some, "run").where("a < doc").select("a", F.col("doc").alias("b"))
        gone = cut(by_doc(gone.select("doc", F.explode("gone").alias("at")).union(aligned(pairs))))
        todo, tried, count = still(todo), some.groupBy("run").agg(F.max("a").alias("tried")), 4 * count


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: str = "__", **options) -> DataFrame:
    """``docs`` with the text of each document less its aligned common blocks, and the columns n_lines (filled lines), n_gone and words_gone, with ``prefix``.

    Rows of a null text or a null id stay as they are. Rows that repeat an id are one document to the search; their lines go from each of them by number, so rows of equal text stay equal. Blank lines stay unless the text loses all its filled lines, which makes it empty. Columns of docs that have the added names are replaced. A text is held with a number for each of its lines; aligning takes time about linear in the lines, unless their repeats nest deeply.
    """
    added = [prefix + c for c in ("n_lines", "n_gone", "words_gone")]
    docs = docs.drop(*added)
    own, lost = unused(docs, "__doc", "__gone")
    gone = duplicate_lines(docs, doc_id=doc_id, text=text, **options).withColumnsRenamed({"doc": own, "gone": lost})
    kept = docs.join(gone, docs[doc_id] == gone[own], "left").drop(own)
    columns = docs.columns
    at, last = columns.index(text), len(columns)
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{c}` bigint" for c in added])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.slices(batch, at):
                starts, ends, line = K.lines(data, offsets)
                words, _, _ = K.spans(data, offsets, K.NOT_SPACE)
                n = np.searchsorted(words, ends) - np.searchsorted(words, starts)
                lists = part.column(last).to_pylist()
                texts = part.column(at)
                texts = texts.to_pylist() if any(lists) else texts
                filled, lost, lost_words = [], [], []
                for d, (p, q) in enumerate(zip(line[:-1].tolist(), line[1:].tolist())):
                    own = np.flatnonzero(n[p:q])
                    filled.append(len(own))
                    out = [x for x in lists[d] or () if x < len(own)]
                    lost.append(len(out))
                    lost_words.append(int(n[p:q][own[out]].sum()) if out else 0)
                    if out:
                        drop = set(own[out].tolist())
                        texts[d] = "" if len(drop) == len(own) else "\n".join(x for k, x in enumerate(texts[d].split("\n")) if k not in drop)
                own = [*part.columns[:at], texts if isinstance(texts, pa.Array) else pa.array(texts, part.column(at).type), *part.columns[at + 1 : last]]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, pa.int64()) for x in (filled, lost, lost_words))], names=[*columns, *added])

    return kept.mapInArrow(rewrite, fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_deleted, words_deleted and the text that is left of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_gone").alias("n_deleted"), F.col("__words_gone").alias("words_deleted"), "text")
