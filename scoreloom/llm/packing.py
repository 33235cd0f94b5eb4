"""Packing documents into sequences of at most ``room`` tokens: patterns fitted to the histogram of lengths.

1. A narrow pass tokenizes each document, ends it by ``end`` and cuts only what is longer than
   ``room``: pieces of exactly ``room`` tokens but for the first, which may be shorter. A piece's number
   among those of its length in its task is counted on the way, with one counter a length. The table of
   pieces (no tokens) is checkpointed, so tasks and numbers stay as they are.
2. Counts by task and length, summed over the tasks before, turn these numbers into ranks within a
   length. No length is gathered or sorted anywhere, so one that a third of all pieces have is dealt
   out like any other.
3. The histogram, ``room`` numbers at most, is all that the driver sees. Patterns of up to three lengths
   that fill a sequence are enumerated, and their repeat counts fitted to the histogram by non-negative
   least squares, adding the patterns of steepest descent until none improves it. Counts are rounded
   down, also at lower shares; what then remains of the histogram is packed largest first, by the one or
   two lengths that fill a sequence best, and by best fit, and the plan of the fewest sequences is taken.
4. A pattern's place for a length takes a range of that length's ranks. The ranges, bounded by ``room``
   and not by the data, go to all tasks, where each piece finds its own by binary search.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .cut import cut
from .encoders import ByteLevel, Vocabulary

ROOM = 1024
#: The id that ends a document.
END = 2
#: Shares of the fitted repeat counts to be tried.
SHARES = (1.0, 0.95, 0.85, 0.7, 0.5, 0.0)


def cuts(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of ``room`` tokens but for the first, which has the rest."""
    first = n - (n - 1) // room * room
    return [(0, first), *((a, room) for a in range(first, n, room))]


def pieces(docs: DataFrame, vocabulary: Vocabulary, room: int = ROOM, end: int = END, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with task and number: its number among those of its length in its task. ``keep_ids`` adds the ids. A null text is an empty one, which is its end alone."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = shared.value.worker().encode, TaskContext.get().partitionId()
        seen = np.zeros(room + 1, np.int64)
        for batch in batches:
            for part, _, _ in K.slices(batch, 1, 4 * K.BLOCK):
                rows: list[list] = [[] for _ in range(len(names) - 1)]
                for k, t in enumerate(part.column(1).to_pylist()):
                    ids = np.array([*(encode(t) if t else ()), end], "<u4")
                    for n, (start, length) in enumerate(cuts(len(ids), room)):
                        own = ids[start : start + length]
                        for column, value in zip(rows, (k, n, start, length, zlib.crc32(own.tobytes()), int(seen[length])), strict=False):
                            column.append(value)
                        if keep_ids:
                            rows[6].append(own.astype(np.int64))
                        seen[length] += 1
                where, *rest = rows
                numbers = [pa.array(x, pa.int64()) for x in rest[:5]]
                columns = [part.column(0).take(pa.array(where, pa.int64())), numbers[0].cast(pa.int32()), *numbers[1:4], pa.array(np.full(len(where), task, np.int32)), numbers[4]]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(x, pa.list_(pa.int64())) for x in rest[5:]], names=names)

    schema = f"doc_id {dict(base.dtypes)['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, number bigint"
    return base.mapInArrow(run, schema + ", ids array<bigint>" * keep_ids)


# The plan: a list of (lengths of a sequence, how often), from counts by length alone.


def patterns(have: np.ndarray, room: int) -> list[np.ndarray]:
    """All ways to fill ``room`` by one, two or three of the lengths that ``have`` counts, as arrays of 1, 2 and 3 columns."""
    there = np.flatnonzero(have[: room + 1])
    out = [np.array([[room]])[: int(have[room] > 0)]]
    a = there[2 * there <= room]
    out.append(np.stack([a, room - a], 1)[have[room - a] > 0])
    x, y = np.meshgrid(a, there, indexing="ij")
    z = room - x - y
    keep = (x <= y) & (y <= z)
    x, y, z = x[keep], y[keep], z[keep]
    return [*out, np.stack([x, y, z], 1)[have[z] > 0]]


def fit(have: np.ndarray, room: int, rounds: int = 12, most: int = 128, sweeps: int = 60) -> list[tuple[tuple[int, ...], float]]:
    """Repeat counts that meet the histogram by non-negative least squares, over a growing set of patterns.

    Each round adds the ``most`` patterns of the steepest descent and then minimises one repeat count after another. Patterns with a count stay few, a small multiple of ``room``.
    """
    rest = have[: room + 1].astype(float)
    kinds = patterns(have, room)
    chosen: dict[tuple[int, ...], float] = {tuple(map(int, p)): 0.0 for kind in kinds[:2] for p in kind}
    total = max(1.0, rest.sum())
    for _ in range(rounds):
        for _ in range(sweeps):
            moved = 0.0
            for p, x in chosen.items():
                step = max(-x, sum(rest[i] for i in p) / sum(p.count(i) for i in p))
                if step:
                    chosen[p] = x + step
                    moved += abs(step)
                    for i in p:
                        rest[i] -= step
            if moved < 1e-4 * total:
                break
        steep = kinds[2]
        if not len(steep):
            break
        slope = rest[steep].sum(1)
        first = np.argsort(-slope, kind="stable")[:most]
        new = [tuple(map(int, steep[k])) for k in first if slope[k] > 0.5]
        new = [p for p in new if p not in chosen]
        if not new:
            break
        chosen |= dict.fromkeys(new, 0.0)
    return [(p, x) for p, x in chosen.items() if x >= 1]


def plan(have: dict[int, int], room: int = ROOM) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) such that every counted piece has one place.

    Several shares of the fitted counts are kept, as a larger rest has more ways to close a sequence, and the rest is packed in two ways; the
    plan of the fewest sequences counts, of equal ones that which keeps most of the fit. So it is never worse than best fit alone.
    """
    left = np.zeros(room + 1, np.int64)
    for length, n in have.items():
        left[length] = n
    fitted = sorted(fit(left, room), key=lambda e: (-e[1], e[0]))
    best = None
    for share in SHARES:
        kept, rest = rounded(fitted, left, share)
        for pack_rest in (closed, best_fit):
            made = kept + pack_rest(rest.copy())
            total = sum(n for _, n in made)
            if best is None or total < best[0]:
                best = total, made
    return best[1]


def rounded(fitted: list[tuple[tuple[int, ...], float]], have: np.ndarray, share: float) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Patterns by that share of their counts, rounded down, and what is left of the histogram."""
    out, left = [], have.copy()
    for p, x in fitted:
        n = min(int(share * x), *(int(left[i]) // p.count(i) for i in p))
        if n > 0:
            out.append((p, n))
            for i in p:
                left[i] -= n
    return out, left


def closed(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """A histogram packed largest first, each sequence closed by the one or two lengths that fill it best, as often as the counts allow."""
    out, room = [], len(left) - 1
    while (there := np.flatnonzero(left)).size:
        p = [int(there[-1])]
        while True:
            free, now = room - sum(p), left.copy()
            for i in p:
                now[i] -= 1
            some = np.flatnonzero(now[: free + 1])
            if not some.size:
                break
            # of equal fills the one with the longer first piece
            reach = np.maximum.accumulate(np.where(now[: free + 1] > 0, np.arange(free + 1), 0))
            second = reach[free - some]
            same = (second == some) & (now[some] < 2)
            below = np.where(some > 0, reach[np.maximum(some - 1, 0)], 0)
            second = np.where(same, np.minimum(below, second), second)
            second = np.where(second > some, 0, second)
            fill = some + second
            k = len(fill) - 1 - int(np.argmax(fill[::-1]))
            p += [int(some[k])] + [int(second[k])] * bool(second[k])
        n = min(int(left[i]) // p.count(i) for i in p)
        out.append((tuple(p), n))
        for i in p:
            left[i] -= n
    return out


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """A histogram packed by best fit, largest first, with all sequences of one make at once: the same as piece by piece, in steps that don't grow with the counts."""
    room = len(left) - 1
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for i in np.flatnonzero(left)[::-1].tolist():
        many = int(left[i])
        while many:
            free = min((r for r in open_ if r >= i), default=None)
            p, n = open_[free].pop() if free is not None else ((), -(-many // (room // i)))
            if free is not None and not open_[free]:
                del open_[free]
            space = room if free is None else free
            times = space // i  # the next piece of one length fits best where the last one went
            whole = min(n, many // times)
            if whole:
                open_.setdefault(space - times * i, []).append((p + (i,) * times, whole))
                many, n = many - whole * times, n - whole
            elif many:
                open_.setdefault(space - many * i, []).append((p + (i,) * many, 1))
                many, n = 0, n - 1
            if n and free is not None:
                open_.setdefault(free, []).append((p, n))
    return [e for own in open_.values() for e in own]


def ranges(plan_: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: the places of each length, in the order of its ranks."""
    rows, used, sequence = [], {}, 0
    for p, n in plan_:
        offset = 0
        for i in p:
            rows.append((i, used.get(i, 0), sequence, offset))
            used[i] = used.get(i, 0) + n
            offset += i
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(numbered: DataFrame, room: int = ROOM) -> DataFrame:
    """``numbered``, which is read again and must give the same rows (written or checkpointed pieces), with sequence_id and offset for task and number."""
    spark = numbered.sparkSession
    counts = cut(numbered.groupBy("task", "length").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("first"))
    places = ranges(plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, room))
    shared = spark.sparkContext.broadcast(places)
    ranked = numbered.join(firsts, ["task", "length"])
    kept = [c for c in numbered.columns if c not in ("task", "number")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, offset = shared.value.T
        # Ranks of a length are below 2**50, so that both fit into one number.
        starts = (length << 50) + first if len(length) else length
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.num_columns - 1).to_numpy()
            k = np.searchsorted(starts, (own << 50) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence[k] + rank - first[k]), pa.array(offset[k])], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    out = ranked.select(*kept, (F.col("first") + F.col("number")).alias("rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields[:-1])
    return out.mapInArrow(run, schema + ", sequence_id bigint, offset bigint")


def pack_docs(docs: DataFrame, vocabulary: Vocabulary, room: int = ROOM, end: int = END, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset, and ``ids`` if they are kept.

    Repeated rows are documents of their own; a null text is an empty one, which is a piece of its end alone; no rows give none. Only doc_id and text of ``docs`` are read. An end beyond ``room`` makes a piece like any other token.
    """
    return pack(cut(pieces(docs, vocabulary, room, end, doc_id, text, keep_ids)), room)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids and the doc_ids of its pieces in order, from pieces with ids. A sequence has at most ``room`` tokens, so a group is small."""
    own = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), own.alias("own")).select("sequence_id", "length", F.flatten("own.ids").alias("ids"), F.col("own.doc_id").alias("doc_ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_docs(docs, ByteLevel.from_file(public_tokenizers.path("byte_bpe_50k.json"), specials=True)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
