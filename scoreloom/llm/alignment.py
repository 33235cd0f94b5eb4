"""Alignment of two tokenizers' tokens over the same bytes, by a sweep over the ends of their tokens.

1. Each tokenizer's pass turns a text into end events: blocks of up to ``CHUNK`` consecutive tokens with
   the byte offset of the first (a token's end follows from its id, as a vocabulary says how long each
   of its tokens is). The events of A and B are united, dealt out by document and sorted by offset.
2. A machine reads them as a stream. Where a token of A and one of B end together, the tokens since the
   last such place are a group, and their overlaps are links. It keeps what lies behind the last common
   end, sums and a running hash, whatever the length of a text.
3. How many documents hold a linked pair of ids needs the whole corpus, but links don't travel by pair.
   A block of documents of a task (with about ``LINKS`` pairs at most, each document's own counted) is written with its links, and beside
   it the block's distinct pairs and their numbers of documents. Consecutive small blocks are read as one of about
   ``MERGED`` pairs, so that documents, and not tasks, say how many there are. Sums by pair go back to the blocks
   that hold the pair, one row a block and pair, and each block reads its own sums as a dictionary. A pair that all
   documents have is so one row a block, never a row a document.

A row is a document of its own: repeated rows with one id and text are swept once and count and come
out as often as they are there. Rows with one id and different texts are different documents. A null id is
an id like any other. Only the id and the text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .cut import cut, release, remove, shared_folder
from .encoders import ByteLevel, Pieces, Vocabulary

CHUNK = 4096
LINKS = 2_000_000
MERGED = 500_000


def squeeze(x: np.ndarray) -> bytes:
    """Non-negative numbers below 2**32 or 2**64 (the item size says which), compressed by planes of bytes."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def expand(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def events(docs: DataFrame, side: int, vocabulary: Vocabulary, spaced: bool) -> DataFrame:
    """doc_id, h, side, start and ids: blocks of tokens of every text, one without ids for a text without tokens.

    The text is read with a space before it; ``spaced`` says that the tokenizer adds that itself. If the
    joined bytes of its tokens are others, the block's ids are null. ``docs`` has doc_id, h and text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value.worker()
        for batch in batches:
            for part, _, _ in K.slices(batch, 2, 4 * K.BLOCK):
                where, starts, blocks = [], [], []
                for k, text in enumerate(part.column(2).to_pylist()):
                    data = " " + text if text else ""
                    ids = v.exactly(text if spaced else data, data.encode()) if data else np.zeros(0, "<u4")
                    if ids is None:
                        where.append(k), starts.append(0), blocks.append(None)
                        continue
                    ends = np.cumsum(v.sizes[ids])
                    for a in range(0, max(1, len(ids)), CHUNK):
                        where.append(k), starts.append(int(ends[a - 1]) if a else 0), blocks.append(squeeze(ids[a : a + CHUNK]))
                where = pa.array(where, pa.int64())
                columns = [part.column(0).take(where), part.column(1).take(where), pa.array(np.full(len(where), side, np.int32)), pa.array(starts, pa.int64()), pa.array(blocks, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "side", "start", "ids"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, h bigint, side int, start bigint, ids binary")


class Groups:
    """Complete groups: ids and ends (in bytes) of A and B, and the number of each token's group among them."""

    def __init__(self, at: int, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, hit: np.ndarray, place: np.ndarray):
        self.a, self.b, self.a_ends, self.b_ends = a, b, a_ends, b_ends
        self.a_starts = np.concatenate([[at], a_ends[:-1]])
        self.b_starts = np.concatenate([[at], b_ends[:-1]])
        b_hit = np.zeros(len(b), np.int64)
        b_hit[place[hit]] = 1
        self.n = int(hit.sum())
        self.a_group = np.cumsum(hit) - hit
        self.b_group = np.cumsum(b_hit) - b_hit

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in a and in b of all pairs of tokens whose bytes overlap, in the order of a."""
        first = np.searchsorted(self.b_ends, self.a_starts, "right")
        n = np.searchsorted(self.b_starts, self.a_ends, "left") - first
        own = np.repeat(np.arange(len(self.a)), n)
        return own, np.arange(len(own)) + np.repeat(first - (np.cumsum(n) - n), n)


class Sweep:
    """The machine: takes blocks of events by offset, gives complete groups, and keeps what lies behind the last common end."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray]):
        self.sizes = sizes
        self.ids = [np.zeros(0, np.uint32)] * 2
        self.ends = [np.zeros(0, np.int64)] * 2
        self.at, self.to = 0, [0, 0]

    def feed(self, side: int, ids: np.ndarray) -> Groups | None:
        if not len(ids):
            return None
        ends = self.to[side] + np.cumsum(self.sizes[side][ids])
        self.to[side] = int(ends[-1])
        self.ids[side] = np.concatenate([self.ids[side], ids])
        self.ends[side] = np.concatenate([self.ends[side], ends])
        (a, b), (a_ends, b_ends) = self.ids, self.ends
        if not len(a) or not len(b):
            return None
        place = np.minimum(np.searchsorted(b_ends, a_ends), len(b) - 1)
        hit = b_ends[place] == a_ends
        if not hit.any():
            return None
        i = len(hit) - int(np.argmax(hit[::-1]))
        j = int(place[i - 1]) + 1
        self.ids, self.ends = [a[i:], b[j:]], [a_ends[i:], b_ends[j:]]
        at, self.at = self.at, int(a_ends[i - 1])
        return Groups(at, a[:i], a_ends[:i], b[:j], b_ends[:j], hit[:i], place[:i])


def documents(batches: Iterator[pa.RecordBatch], sizes: tuple[np.ndarray, np.ndarray], opened: Callable, group: Callable, closed: Callable, between: Callable) -> Iterator:
    """Runs the machine over sorted events: ``opened(key)`` makes what ``group(own, groups, copies)`` and ``closed(own, key, copies, whole)`` get; these and ``between()``, called after each batch, give lists of what is put out."""
    key = own = machine = last = None
    copies, whole, started = 0, True, False
    for batch in batches:
        ids, h, side, start, blocks = (batch.column(i).to_pylist() for i in range(5))
        for k in range(len(ids)):
            if not started or (ids[k], h[k]) != key:
                if started:
                    yield from closed(own, key, copies, whole)
                key, machine, copies, whole, last, started = (ids[k], h[k]), Sweep(sizes), 0, True, None, True
                own = opened(key)
            here = (start[k], side[k])
            if start[k] == 0 and side[k] == 0:
                copies += 1
            if here == last:
                continue
            last = here
            whole = whole and blocks[k] is not None
            if whole and (g := machine.feed(side[k], expand(blocks[k], "<u4"))):
                yield from group(own, g, copies)
        yield from between()
    if started:
        yield from closed(own, key, copies, whole)
    yield from between(True)


def sorted_events(docs: DataFrame, a: Vocabulary, b: Vocabulary, doc_id: str, text: str) -> DataFrame:
    """The events of both tokenizers, each document's in one task and sorted by offset. b adds the space before a text itself."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    both = events(own, 0, a, False).unionByName(events(own, 1, b, True))
    return both.repartition("doc_id", "h").sortWithinPartitions("doc_id", "h", "start", "side")


def _sizes(a: Vocabulary, b: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    return a.worker().sizes, b.worker().sizes


def align(docs: DataFrame, a: Vocabulary, b: Vocabulary, what: str = "groups", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups (doc_id, copies, start, end, a_ids, b_ids) or links (doc_id, copies, start, end, a_id, b_id) of every document.

    start and end are offsets in the bytes of the text with a space before it: of the group, or of the bytes that the linked tokens
    share. ``copies`` says how many rows have this id and text. A null or empty text, and one whose tokens of A or B don't give its bytes, has neither.
    """
    sorted_ = sorted_events(docs, a, b, doc_id, text)
    kind = sorted_.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((a, b))

    def lists(ids: np.ndarray, groups: np.ndarray, n: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(groups, np.arange(n + 1)).astype(np.int32)), pa.array(ids.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(own, g, copies):
            key = own
            if what == "groups":
                ends = g.a_ends[np.flatnonzero(np.diff(g.a_group, append=g.n))]
                columns = [np.concatenate([g.a_starts[:1], ends[:-1]]), ends, lists(g.a, g.a_group, g.n), lists(g.b, g.b_group, g.n)]
            else:
                i, j = g.links()
                columns = [np.maximum(g.a_starts[i], g.b_starts[j]), np.minimum(g.a_ends[i], g.b_ends[j]), g.a[i].astype(np.int32), g.b[j].astype(np.int32)]
            n = len(columns[0])
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n, types[0]), pa.array(np.full(n, copies, np.int32)), *(x if isinstance(x, pa.Array) else pa.array(x) for x in columns)], names=names)

        def first(it):
            for batch in it:
                types[:] = [batch.schema.field(0).type]
                yield batch

        types: list = []
        yield from documents(first(batches), _sizes(*shared.value), lambda key: key, group, lambda *_: (), lambda *_: ())

    ids = ("a_ids", "b_ids", "array<int>") if what == "groups" else ("a_id", "b_id", "int")
    names = ["doc_id", "copies", "start", "end", *ids[:2]]
    return sorted_.mapInArrow(run, f"doc_id {kind}, copies int, start bigint, end bigint, {ids[0]} {ids[2]}, {ids[1]} {ids[2]}")


class _Digest:
    """Sums of one document, its hash, and its pairs that aren't put out yet."""

    def __init__(self):
        self.n_a = self.n_b = self.n_groups = self.n_links = self.waiting = 0
        self.sha, self.pairs, self.seen = None, [], None


def _swept(sorted_: DataFrame, a: Vocabulary, b: Vocabulary) -> DataFrame:
    """Rows of two kinds: documents (or a part of a long one, without sums but for the last) with their distinct pairs and how often each is linked, and blocks with the numbers of documents of their pairs (``pair``, ``pair_docs``)."""
    kind = sorted_.schema["doc_id"].dataType.simpleString()
    shared = sorted_.sparkSession.sparkContext.broadcast((a, b))
    names = ["block", "doc_id", "h", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times", "pair", "pair_docs", "entries"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _sizes(*shared.value)
        wide, form = len(sizes[1]), "<u4" if len(sizes[0]) * len(sizes[1]) <= 1 << 32 else "<u8"
        most = max(len(x) for x in sizes)
        names_of = np.array([f"{i}{c}" for c in ",|;" for i in range(most)], "S")
        block, rows, types = TaskContext.get().partitionId() << 32, [], []
        distinct: list[tuple[np.ndarray, int]] = []

        def text_of(g: Groups) -> bytes:
            """Each id with what follows it: '|' the last of A in a group, ';' the last of B, ',' the others."""
            out = np.empty(len(g.a) + len(g.b), np.int64)
            lasts = [np.diff(x, append=g.n) > 0 for x in (g.a_group, g.b_group)]
            a_ends, b_ends = (np.flatnonzero(x) + 1 for x in lasts)
            out[np.arange(len(g.a)) + np.concatenate([[0], b_ends])[g.a_group]] = g.a + lasts[0] * most
            out[np.arange(len(g.b)) + a_ends[g.b_group]] = g.b + lasts[1] * (2 * most)
            return names_of[out].tobytes().translate(None, b"\0")

        def group(own: _Digest, g: Groups, copies: int) -> list:
            i, j = g.links()
            own.n_a, own.n_b, own.n_groups, own.n_links = own.n_a + len(g.a), own.n_b + len(g.b), own.n_groups + g.n, own.n_links + len(i)
            if own.sha is None:
                own.sha, text = hashlib.sha256(), text_of(g)[:-1]
            else:
                text = b";" + text_of(g)[:-1]
            own.sha.update(text)
            own.pairs.append(g.a[i].astype(np.int64) * wide + g.b[j])
            own.waiting += len(i)
            if own.waiting >= LINKS:
                part(own, copies, None, False)
            return []

        def part(own: _Digest, copies: int, key, last: bool) -> None:
            """A row with the pairs so far; those of the document that earlier parts had don't count as documents again."""
            codes, times = np.unique(np.concatenate(own.pairs), return_counts=True) if own.pairs else (np.zeros(0, np.int64),) * 2
            new = codes if own.seen is None else np.setdiff1d(codes, own.seen, assume_unique=True)
            distinct.append((new, copies))
            if not last:
                own.seen = new if own.seen is None else np.union1d(own.seen, new)
            own.pairs, own.waiting = [], 0
            rows.append([block, *key_of(own, key), copies] + ([own.n_a, own.n_b, own.n_groups, own.n_links, own.sha.hexdigest() if own.sha else ""] if last else [0, 0, 0, 0, ""]) + [squeeze(np.diff(codes, prepend=0).astype(form)), squeeze(times.astype("<u4")), None, None, None])

        def key_of(own: _Digest, key) -> tuple:
            return key if key is not None else own.key

        def opened(key) -> _Digest:
            own = _Digest()
            own.key = key
            return own

        def closed(own: _Digest, key, copies: int, whole: bool) -> list:
            part(own if whole else _Digest(), copies, key, True)
            return []

        def between(end: bool = False) -> Iterator[pa.RecordBatch]:
            nonlocal block, rows, distinct
            if sum(len(x) for x, _ in distinct) >= LINKS or end and rows:
                every = np.concatenate([x for x, _ in distinct])
                docs = np.repeat([n for _, n in distinct], [len(x) for x, _ in distinct])
                codes, place = np.unique(every, return_inverse=True)
                rows.append([block, None, None, None, *[None] * 7, codes, np.bincount(place, docs, len(codes)).astype(np.int64), len(every)])
                block, distinct = block + 1, []
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), types[0], pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
                rows = []
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

        def first(it):
            for batch in it:
                types[:] = [batch.schema.field(0).type]
                yield batch

        yield from documents(first(batches), sizes, opened, group, closed, between)

    return sorted_.mapInArrow(run, f"block bigint, doc_id {kind}, h bigint, copies int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, codes binary, times binary, pair array<bigint>, pair_docs array<bigint>, entries bigint")


def _merged(parts: DataFrame) -> DataFrame:
    """Rows of ``_swept`` with consecutive blocks made one, if their entries begin in the same ``MERGED``; it has the number of the first."""
    # two numbers a block
    blocks = parts.where("entries IS NOT NULL").select("block", "entries")
    before = F.sum("entries").over(Window.orderBy("block")) - F.col("entries")
    blocks = blocks.withColumn("at", F.floor(before / MERGED)).select("block", F.min("block").over(Window.partitionBy("at")).alias("into"))
    return parts.join(F.broadcast(blocks), "block").withColumn("block", F.col("into")).drop("into")


def _counted(joined: DataFrame, form: str) -> DataFrame:
    """Rows of documents with count_sum and n_best from the dictionary rows (pair and value: twice the number of documents, and 1 more if it is the highest) that precede them in their block."""
    kept = ["doc_id", "h", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    own = joined.schema["own"].dataType
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.fields) + ", n_best bigint, count_sum bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, gathered, keys, values = None, [], None, None
        for batch in batches:
            blocks, pair = batch.column(0).to_numpy(), batch.column(1)
            bounds = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
            for lo, hi in zip(bounds, bounds[1:]):
                if blocks[lo] != block:
                    block, gathered, keys = blocks[lo], [], None
                n = hi - lo - pair.slice(lo, hi - lo).null_count
                if n:  # a block's dictionary comes first
                    gathered.append((pair.slice(lo, n).to_numpy(), batch.column(2).slice(lo, n).to_numpy()))
                if lo + n == hi:
                    continue
                if keys is None:
                    keys, values = (np.concatenate(x) if gathered else np.zeros(0, np.int64) for x in (list(zip(*gathered)) or ((), ())))
                part = batch.slice(lo + n, hi - lo - n)
                best, total = [], []
                for codes, times in zip(part.column(4).to_pylist(), part.column(5).to_pylist()):
                    times = expand(times, "<u4").astype(np.int64)
                    value = values[np.searchsorted(keys, np.cumsum(expand(codes, form).astype(np.int64)))] if len(times) else times
                    best.append(int((times * (value & 1)).sum()))
                    total.append(int((times * (value >> 1)).sum()))
                yield pa.RecordBatch.from_arrays([*part.column(3).flatten(), pa.array(best, pa.int64()), pa.array(total, pa.int64())], names=[*kept, "n_best", "count_sum"])

    return joined.mapInArrow(run, schema)


def digest(docs: DataFrame, a: Vocabulary, b: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A pair of ids counts the documents that hold it linked, over the whole corpus. ``n_best`` are the links whose count is the highest of their A id, ``count_sum`` is the sum over links.
    A null or empty text, and one whose tokens of A or B don't give its bytes, has zeros and an empty hash. Without rows there are none.
    """
    spark = docs.sparkSession
    place = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    _swept(sorted_events(docs, a, b, doc_id, text), a, b).write.option("compression", "zstd").parquet(place)
    release(spark)
    wide = len(b.worker().sizes)
    form = "<u4" if len(a.worker().sizes) * wide <= 1 << 32 else "<u8"
    parts = _merged(spark.read.parquet(place))
    pairs = parts.where("pair IS NOT NULL").select("block", F.inline(F.arrays_zip("pair", "pair_docs")))
    # dealt out by pair, which a block has once, for the sums by block and those over all blocks
    pairs = pairs.repartition("pair").groupBy("block", "pair").agg(F.sum("pair_docs").alias("pair_docs"))
    totals = pairs.groupBy("pair").agg(F.sum("pair_docs").alias("n"))
    # One row an id of A, so as many as its vocabulary has at most.
    best = totals.groupBy(F.expr(f"pair div {wide}").alias("a")).agg(F.max("n").alias("most"))
    scored = totals.withColumn("a", F.expr(f"pair div {wide}")).join(F.broadcast(best), "a").select("pair", (2 * F.col("n") + F.when(F.col("n") == F.col("most"), 1).otherwise(0)).alias("value"))
    own = F.struct("doc_id", "h", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    rows = parts.where("pair IS NULL").select("block", F.lit(None).cast("bigint").alias("pair"), F.lit(None).cast("bigint").alias("value"), own.alias("own"), "codes", "times")
    entries = pairs.select("block", "pair").join(scored, "pair").select("block", "pair", "value").withColumns({"own": F.lit(None).cast(rows.schema["own"].dataType), "codes": F.lit(None).cast("binary"), "times": F.lit(None).cast("binary")})
    joined = entries.unionByName(rows).repartition("block").sortWithinPartitions("block", F.col("pair").asc_nulls_last())
    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    counted = _counted(joined, form).groupBy("doc_id", "h").agg(F.max("copies").alias("copies"), *(F.sum(c).alias(c) for c in sums), F.max("groups_sha256").alias("groups_sha256"))
    out = cut(counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", *sums, "groups_sha256"))
    remove(spark, place)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a = ByteLevel.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    b = Pieces.from_file(public_tokenizers.path("piece_bpe_32k.model"))
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), a, b)
