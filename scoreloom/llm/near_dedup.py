"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Every text's distinct shingle hashes give its set size, a 128-bit hash of the set and a signature
   of ``SKETCH`` minima, of which all are kept by their low byte and the first ``COORDS`` whole.
   Texts with equal sets are one class and go on as one representative.
2. A representative is posted under each (coordinate, value) pair. Pairs of similarity ``percent``
   share ``MATCHES`` coordinates or more, but for a chance of about 2e-7 at 0.8 exactly. So, by the
   prefix principle, they share one of the ``m - MATCHES + 1`` rarest of the m postings that a
   representative shares with anybody: only these lists are merged, those of more frequent values are
   skipped, and a representative with fewer than ``MATCHES`` shared postings has no partner at all.
3. The members of a list meet in a task, which counts the coordinates on which they collide, all
   ``SKETCH`` of them. Members of ``SKETCH_MATCHES`` collisions or more are candidates (a pair of 0.8
   fails this with a chance of about 3e-7). What a task puts out are links that span its candidates,
   less than one a member, never all pairs.
4. Candidates that are connected so form groups, mostly small. Each text is sent once to the task of
   its group, where full sets are compared and links that span the true near duplicates come out.
5. Components come from distributed star contraction.

Lists and groups above a block's size are dealt out in two rounds (``_connected``), so that no task
holds more than two blocks and no group is one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .cut import cut, release

COORDS, MATCHES = 32, 13
SKETCH, SKETCH_MATCHES = 64, 34
#: Members of a block of a list, and shingles of a block of a group.
LIST_BLOCK, SET_BLOCK = 1024, 1 << 18
#: Bytes of ids up to which they are broadcast to where their texts are.
BROADCAST_BYTES = 8 << 20
HUBS = 3
_A = K.mix(np.arange(101, 101 + SKETCH, dtype=K.U)) | K.U(1)
_B = K.mix(np.arange(501, 501 + SKETCH, dtype=K.U))
_SALT = K.U(0xA0761D6478BD642F)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and each text's first. A text of fewer than n words has one shingle of them all; one without words has none."""
    starts, ends, first = K.spans(data, offsets, K.NOT_SPACE)
    words = K.hashes(data, starts, ends, fold=True)
    counts = np.diff(first)
    grams = K.ngrams(words, n)
    places = np.flatnonzero(K.whole(first, n))
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    own = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(own[-1], K.U)
    out[np.repeat(counts >= n, sizes)] = grams[places]
    for m in range(1, n):
        short = np.flatnonzero(counts == m)
        if len(short):
            out[own[short]] = K.ngrams(words, m)[first[short]]
    for a, b in zip(own[:-1].tolist(), own[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[own[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return out[fresh], kept[own]


def _signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, c1, c2, sig, sketch) of every row; those of a text without words mean nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.slices(batch, 1):
                sets, first = shingle_sets(data, offsets, n)
                size = np.diff(first)
                some = size > 0
                c1, c2 = (np.concatenate([np.zeros(1, K.U), np.cumsum(h, dtype=K.U)]) for h in (K.mix(sets), K.mix(sets ^ _SALT)))
                sig = np.zeros((part.num_rows, SKETCH), np.uint32)
                if len(sets):
                    heads = first[:-1][some]
                    for j in range(SKETCH):
                        sig[some, j] = np.minimum.reduceat((((sets ^ _B[j]) * _A[j]) >> K.U(32)).astype(np.uint32), heads)
                low = np.ascontiguousarray(sig.astype(np.uint8)).view(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).reshape(-1))) for x in (sig[:, :COORDS].view(np.int32), low)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int64)), pa.array((c1[first[1:]] - c1[first[:-1]]).view(np.int64)), pa.array((c2[first[1:]] - c2[first[:-1]]).view(np.int64)), *lists], names=["doc_id", "n_shingles", "c1", "c2", "sig", "sketch"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles bigint, c1 bigint, c2 bigint, sig array<int>, sketch array<bigint>")


def _spanning(labels: np.ndarray, second: np.ndarray, size: np.ndarray, percent: int, hits: Callable) -> list[tuple[int, int]]:
    """Links (i, j) that connect what ``hits`` links, between members of different labels. second: marks the second block; where there are two, only pairs across them are tried."""
    labels, out = labels.copy(), []
    two = bool(second.any())
    for i in np.flatnonzero(~second).tolist():
        low = 0 if two else i + 1
        there = labels[low:] != labels[i]
        if two:
            there &= second
        if not there.any():
            continue
        there &= _near(size[low:], size[i], percent)
        at = np.flatnonzero(there) + low
        if len(at) and len(at := at[hits(i, at)]):
            joined, one = np.unique(labels[at], return_index=True)
            out += [(i, j) for j in at[one].tolist()]
            labels[np.isin(labels, joined)] = labels[i]
    return out


def _near(a, b, percent: int):
    return np.minimum(a, b) * 100 >= np.maximum(a, b) * percent


def _tasks(batches: Iterator[pa.RecordBatch], weight: int | None, most: int) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by task (the first column), in batches that hold whole tasks; a batch ends once its rows, or the sum of their column ``weight``, reach ``most``."""
    held: list[pa.RecordBatch] = []
    full = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        before = held[-1].column(0)[-1].as_py() if held else None
        held.append(batch)
        full += batch.num_rows if weight is None else int(batch.column(weight).to_numpy().sum())
        if full < most:
            continue
        task = batch.column(0).to_numpy()
        k = int(np.searchsorted(task, task[-1]))
        if k or before not in (None, task[-1]):
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, k)]).combine_chunks().to_batches()[0]
            held, full = [batch.slice(k)], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _within(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where tasks begin (and the last ends), marks of second blocks, and a number for each root."""
    task = part.column(0).to_numpy()
    edges = np.concatenate([[0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)]])
    return edges, part.column(1).to_numpy(zero_copy_only=False), part.column(3).dictionary_encode().indices.to_numpy()


def _pairs(part: pa.RecordBatch, a: list | np.ndarray, b: list | np.ndarray) -> pa.RecordBatch:
    rep = part.column(2)
    return pa.RecordBatch.from_arrays([rep.take(pa.array(a, pa.int64())), rep.take(pa.array(b, pa.int64()))], names=["a", "b"])


def _collisions(rows: DataFrame, kind: str, percent: int) -> DataFrame:
    """Links (a, b) that span the candidates of each task. rows: task, second, rep, root, n, sketch; sorted by task in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _tasks(batches, None, 8192):
            edges, second, labels = _within(part)
            size = part.column(4).to_numpy()
            coords = part.column(5).flatten().to_numpy().view(np.uint8).reshape(-1, SKETCH)
            # every member against the first of its task, for all tasks at once; that is enough for most
            head = np.repeat(edges[:-1], np.diff(edges))
            halves = np.logical_or.reduceat(second, edges[:-1])[np.repeat(np.arange(len(edges) - 1), np.diff(edges))]
            at = np.flatnonzero((labels != labels[head]) & ~halves & _near(size, size[head], percent))
            at = at[(coords[at] == coords[head[at]]).sum(1) >= SKETCH_MATCHES]
            links_a, links_b = head[at].tolist(), at.tolist()
            labels = labels.copy()
            labels[at] = labels[head[at]]
            open_ = np.logical_or.reduceat((labels != labels[head]) | halves, edges[:-1])
            for k in np.flatnonzero(open_).tolist():
                p, q = int(edges[k]), int(edges[k + 1])
                own = coords[p:q]
                for i, j in _spanning(labels[p:q], second[p:q], size[p:q], percent, lambda i, at, own=own: (own[at] == own[i]).sum(1) >= SKETCH_MATCHES):
                    links_a.append(p + i)
                    links_b.append(p + j)
            yield _pairs(part, links_a, links_b)

    return rows.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _overlaps(sets: np.ndarray, first: np.ndarray, percent: int) -> Callable:
    """hits(i, at) for ``_spanning``: whether full sets are similar enough."""
    ids = np.unique(sets, return_inverse=True)[1]
    marks = np.zeros(len(sets) + 1, bool)
    size = np.diff(first)

    def hits(i: int, at: np.ndarray) -> np.ndarray:
        own = ids[first[i] : first[i + 1]]
        marks[own] = True
        n = size[at]
        ends = np.cumsum(n)
        places = np.arange(ends[-1]) + np.repeat(first[at] - (ends - n), n)
        common = np.add.reduceat(marks[ids[places]], ends - n, dtype=np.int64)
        marks[own] = False
        return 100 * common >= percent * (n + size[i] - common)

    return hits


def _full_sets(rows: DataFrame, kind: str, n: int, percent: int) -> DataFrame:
    """Links (a, b) that span the near duplicates of each task. rows: task, second, rep, root, w, text; sorted by task in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _tasks(batches, 4, SET_BLOCK):
            edges, second, labels = _within(part)
            found = [shingle_sets(data, offsets, n) for _, data, offsets in K.slices(part, 5)]
            sets = np.concatenate([x for x, _ in found])
            first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in found]))])
            size = np.diff(first)
            links: list[tuple[int, int]] = []
            for p, q in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if q - p > 1:
                    hits = _overlaps(sets[first[p] : first[q]], first[p : q + 1] - first[p], percent)
                    links += [(p + i, p + j) for i, j in _spanning(labels[p:q], second[p:q], size[p:q], percent, hits)]
            yield _pairs(part, *(zip(*links) if links else ([], [])))

    return rows.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _connected(members: DataFrame, block: int, run: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that connect what ``run`` links in each group, and the components (id, root) that they make. members: g, rep, w.

    A group of a weight up to ``block`` is one task. A larger one is dealt by a hash of rep to blocks, and to each block come HUBS members of the group, the same for all; of the components that this leaves, the largest isn't compared with itself any more, but all others' members with every member of other components, block by block. So a group that the hubs hold together costs its size, and only members outside its largest component cost a pass over it a block.

    ``run`` gets (task, second, rep, root, w) and returns links; second marks the rows of a task's second block.
    """
    c = F.col
    sized = members.groupBy("g").agg(F.count("*").alias("held"), F.ceil(F.sum("w") / block).cast("int").alias("k")).where("held > 1").select("g", "k")
    placed = cut(members.join(sized, "g"))
    row = ("second", "rep", "root", "w")
    at = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    first = placed.select(F.when(c("k") > 1, F.xxhash64("g", at(c("k")))).otherwise(F.xxhash64("g")).alias("task"), F.lit(False).alias("second"), "rep", c("rep").alias("root"), "w")
    large = placed.where("k > 1")
    if some := not large.isEmpty():
        hubs = large.groupBy("g", "k").agg(*(F.min_by(F.struct("rep", "w"), F.struct(F.xxhash64("rep", F.lit(salt)), "rep")).alias(f"h{salt}") for salt in range(HUBS)))
        every = F.array_distinct(F.array(*(f"h{salt}" for salt in range(HUBS))))
        hubs = hubs.select("g", F.explode(F.sequence(F.lit(0), c("k") - 1)).alias("i"), every.alias("h")).select("g", "i", F.explode("h").alias("h"))
        first = first.union(hubs.select(F.xxhash64("g", "i"), F.lit(False), "h.rep", "h.rep", "h.w"))
    links = cut(run(first))
    release(members.sparkSession)
    roots = components(links)
    if not some:
        return links, roots
    named = cut(large.join(roots, c("rep") == c("id"), "left").select("g", "rep", F.coalesce("root", "rep").alias("root"), "w"))
    parts = named.groupBy("g", "root").agg(F.sum("w").alias("w")).groupBy("g").agg(F.max_by("root", F.struct("w", "root")).alias("main"), F.max("w").alias("most"), F.sum("w").alias("total"), F.count("*").alias("parts"))
    parts = parts.where("parts > 1").select("g", "main", F.ceil((c("total") - c("most")) / block).cast("int").alias("others"), F.ceil(c("most") / block).cast("int").alias("mains"))
    named = named.join(parts, "g").withColumn("i", F.when(c("root") == c("main"), c("others") + at(c("mains"))).otherwise(at(c("others"))))
    named = named.withColumn("j", F.explode(F.sequence(F.lit(0), F.when(c("root") == c("main"), c("others") - 1).otherwise(c("others") + c("mains") - 1))))
    second = named.select(F.xxhash64("g", F.least("i", "j"), F.greatest("i", "j")).alias("task"), (c("i") > c("j")).alias("second"), "rep", "root", "w")
    more = cut(run(second.select("task", *row)))
    if more.isEmpty():
        return links, roots
    links = links.union(more)
    return links, components(links)


def _dealt(rows: DataFrame) -> DataFrame:
    # by rep within a task, so that the tasks of many lists link the same members to the same first one
    return rows.repartition("task").sortWithinPartitions("task", "rep")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", list_block: int = LIST_BLOCK, set_block: int = SET_BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Documents are linked where 100 * intersection >= percent * union of their sets of word shingles; component_id is the least doc_id that can be reached by links. Null and empty texts have no shingle and are linked with nothing. Rows that share a doc_id count as one document with the links of all of them; rows without doc_id are linked with nothing, are kept, and have no component_id. A very long text costs memory for its hashes, some 20 bytes a word. The result does not depend on the sizes of blocks.
    """
    c = F.col
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(base.dtypes)["doc_id"]
    signed = cut(_signatures(base, shingle))
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = cut(full.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig"), F.min("sketch").alias("sketch")))
    posts = reps.select("rep", F.posexplode("sig").alias("at", "value")).select(F.xxhash64("at", "value").alias("key"), "rep")
    counts = posts.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    own = posts.join(counts, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("held", "key"))).alias("own"))
    lists = own.where(F.size("own") >= MATCHES).select("rep", F.explode(F.slice("own", 1, F.size("own") - MATCHES + 1)).alias("x")).select(c("x.key").alias("g"), "rep")
    lists = cut(lists)
    sketches = reps.select("rep", "n", "sketch")
    _, candidates = _connected(lists.withColumn("w", F.lit(1)), list_block, lambda rows: _collisions(_dealt(rows.join(sketches, "rep").select("task", "second", "rep", "root", "n", "sketch")), kind, percent))
    groups = candidates.join(reps.groupBy("rep").agg(F.sum("n").alias("w")), c("id") == c("rep")).select("rep", "root", "w")
    release(docs.sparkSession)
    links, roots = _connected(_thin(cut(groups), lists, set_block), set_block, lambda rows: _full_sets(_dealt(_with_texts(rows, base)), kind, shingle, percent))

    # rows of one id with different sets count as one document
    again = full.select("doc_id", "c1", "c2").distinct()
    again = again.join(again.groupBy("doc_id").agg(F.count("*").alias("held")).where("held > 1"), "doc_id")
    again = again.join(reps.select("c1", "c2", "rep"), ["c1", "c2"]).select(c("doc_id").alias("a"), c("rep").alias("b"))
    again = cut(again)
    if not again.isEmpty():
        roots = components(links.union(again))
    named = full.select("doc_id", "c1", "c2").join(reps.select("c1", "c2", "rep"), ["c1", "c2"]).join(roots, c("rep") == c("id"), "left").select("doc_id", F.coalesce("root", "rep").alias("root"))
    named = named.groupBy("doc_id").agg(F.min("root").alias("root"))
    out = signed.join(named, "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(c("doc_id") == component, F.lit(True)).alias("kept"))


def _thin(groups: DataFrame, lists: DataFrame, block: int) -> DataFrame:
    """(g, rep, w) of groups (rep, root, w). A group of several blocks whose lists have fewer pairs of members than the group is dealt out by these lists: chains of pairs may have made it large."""
    whole = groups.select(F.xxhash64("root").alias("g"), "rep", "w")
    wide = cut(groups.groupBy("root").agg(F.sum("w").alias("w"), F.count("*").alias("held")).where(F.col("w") > block).select("root", "held"))
    if not (n := wide.count()):
        return whole
    # each wide group holds more than a block of shingles, so there are few of them
    few = F.broadcast if 64 * n <= BROADCAST_BYTES else lambda x: x
    inner = lists.join(groups.join(few(wide), "root"), "rep").select("root", "g", "rep", "w", "held")
    pairs = inner.groupBy("root", "g", "held").agg(F.count("*").alias("n")).groupBy("root", "held").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
    thin = few(cut(pairs.where(F.col("pairs") < F.col("held").cast("double") * F.col("held")).select("root")))
    whole = groups.join(thin, "root", "left_anti").select(F.xxhash64("root").alias("g"), "rep", "w")
    return whole.union(inner.join(thin, "root").select(F.xxhash64("root", "g"), "rep", "w"))


def _with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(task, second, rep, root, w, text). Rows of BROADCAST_BYTES or less, measured first, are sent to where the texts are; more are joined by shuffling."""
    rows = cut(rows)
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length(F.col("rep").cast("string")) + F.length(F.col("root").cast("string"))), F.lit(0))).first()
    held = texts.select(F.col("doc_id").alias("rep"), "text")
    return held.join(F.broadcast(rows) if 40 * n + chars <= BROADCAST_BYTES else rows, "rep").select("task", "second", "rep", "root", "w", "text")


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those whose component holds a lesser id."""
    gone = near_duplicates(docs, shingle, percent, doc_id, text).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[doc_id] == gone["__gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 1), ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS id, b AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT id, min(other) AS root FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(root, d.doc_id)) AS component_id, d.doc_id <= coalesce(root, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.id = d.doc_id
"""
