"""Hard negatives by a vantage-point tree over norm-augmented vectors.

A vector x gets one more component, sqrt(M^2 - |x|^2) with M the greatest norm, and an anchor gets a 0
there. Then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the highest scores are the nearest rows, and a window
of scores is an annulus around the anchor.

1. The driver builds a tree of vantage points and median radii on ``SAMPLE`` rows of least hash. Every row
   descends to a leaf, and the least and greatest distance of a leaf's rows to each vantage point above it, and to
   the leaf's middle, are aggregated over all rows, so bounds are exact whatever the sample was.
2. A leaf is dealt out in blocks of about ``BLOCK_ROWS`` rows by hash, so many copies of one vector make many
   blocks and not one large task. An anchor goes to the leaves that its annulus can meet and that can
   still hold one of its k best; the k best among the sample's rows, which are rows of the table, say how
   good those are at least.
3. Blocks and anchors meet by one shuffle, sorted so that a task reads a block's rows and then streams
   the anchors. A block has a tree of its own; its leaves are read nearest first from the inner edge of the
   annulus until the next is farther than the k-th found. The k best of all blocks are the anchor's.

Positives (the annulus is a ball, the label the same) are found first; each then gives its window for the
negatives. Every pair that matters is compared: bounds only leave out what can't be among the k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cut import cut

SAMPLE = 4096
BLOCK_ROWS = 16_384
#: Rows of a leaf of the whole table, while there are fewer than MOST_LEAVES, and of a leaf of a block.
LEAF_ROWS, MOST_LEAVES, SMALL_LEAF = 1024, 256, 128
FOUND = "qid bigint, qh bigint, w int, id bigint, score double"


def matrix(column: pa.ListArray, d: int) -> np.ndarray:
    """Rows of at most d numbers, missing ones at the end being 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = np.diff(column.offsets.to_numpy())
    if (n == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(n), d))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def augmented(x: np.ndarray, m2: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(m2 - (x * x).sum(1), 0.0))[:, None]])


def _distance(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - v) ** 2).sum(1))


class Tree:
    """Vantage points, radii, and for every leaf the points that bound it: those of the nodes above it and its own middle. ``descend`` gives the leaf of each row."""

    def __init__(self, x: np.ndarray, leaf_rows: int, m2: float, seed: int = 7):
        """x: augmented rows."""
        self.m2, self.points, self.radii, self.children, self.above = m2, [], [], [], []
        rng = np.random.default_rng(seed)

        def grow(rows: np.ndarray, path: tuple) -> int:
            """A node's number, or -1 - the number of a leaf."""
            if len(rows) > leaf_rows:
                tries = rows[rng.integers(len(rows), size=4)]
                d = [_distance(x[rows], x[t]) for t in tries]
                best = int(np.argmax([v.var() for v in d]))
                radius = float(np.median(d[best]))
                near = d[best] <= radius
                if near.all():  # copies, or most rows at one distance: the other side of it, if there is one
                    near = d[best] < radius
                # Rows that no distance parts well stay one leaf, so that the tree is never deep.
                if min(near.sum(), (~near).sum()) * 16 >= len(rows):
                    radius = float(d[best][near].max())
                    node = len(self.points)
                    self.points.append(x[tries[best]]), self.radii.append(radius), self.children.append(None)
                    self.children[node] = (grow(rows[near], (*path, node)), grow(rows[~near], (*path, node)))
                    return node
            self.points.append(x[rows].mean(0) if len(rows) else np.zeros(x.shape[1])), self.radii.append(0.0), self.children.append(None)
            self.above.append((*path, len(self.points) - 1))
            return -len(self.above)

        self.root = grow(np.arange(len(x)), ())
        self.points = np.array(self.points).reshape(-1, x.shape[1])
        self.depth = max(map(len, self.above))

    def descend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each augmented row, and its distances to the points that bound that (0 behind the last)."""
        leaf, far = np.zeros(len(x), np.int64), np.zeros((len(x), self.depth))

        def go(node: int, rows: np.ndarray, level: int) -> None:
            if node < 0:
                leaf[rows] = -1 - node
                far[rows, level] = _distance(x[rows], self.points[self.above[-1 - node][-1]])
            elif len(rows):
                d = _distance(x[rows], self.points[node])
                far[rows, level] = d
                near = d <= self.radii[node]
                go(self.children[node][0], rows[near], level + 1)
                go(self.children[node][1], rows[~near], level + 1)

        go(self.root, np.arange(len(x)), 0)
        return leaf, far

    def bounds(self, q: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that a row of each leaf can have with each anchor, from the least and greatest distances of its rows to the points that bound it."""
        with np.errstate(over="ignore", invalid="ignore"):
            return self._bounds(q, least, most)

    def _bounds(self, q: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q2 = (q * q).sum(1)
        base = q2 + self.m2
        slack = 1e-9 * (base + 1)
        to = np.sqrt(np.maximum(q2[:, None] + (self.points * self.points).sum(1)[None] - 2 * q @ self.points[:, :-1].T, 0.0))
        low, high = np.empty((len(q), len(self.above))), np.empty((len(q), len(self.above)))
        # The tightest ball that any row is in: the origin's, of radius M.
        widest = np.sqrt(np.maximum(self.m2, 0.0) * q2)
        for k, path in enumerate(self.above):
            near, far = np.zeros(len(q)), np.full(len(q), np.inf)
            for level, node in enumerate(path):
                d = to[:, node]
                near = np.maximum(near, np.maximum(least[k, level] - d, d - most[k, level]))
                far = np.minimum(far, d + most[k, level])
            high[:, k] = np.minimum((base - near * near) / 2, widest) + slack
            low[:, k] = np.maximum((base - far * far) / 2, -widest) - slack
        # Vectors so large that squares overflow bound nothing.
        return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


class Best:
    """The k best rows of each anchor and window found so far: by score, then by id."""

    def __init__(self, shape: tuple[int, int], k: int, at_least: np.ndarray):
        self.k, self.windows = k, shape[1]
        self.bar = at_least.copy()
        self.group, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, group: list[np.ndarray], id: list[np.ndarray], score: list[np.ndarray]) -> None:
        group, id, score = (np.concatenate([own, *new]) for own, new in ((self.group, group), (self.id, id), (self.score, score)))
        order = np.lexsort((id, -score, group))
        group, id, score = group[order], id[order], score[order]
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        keep = rank < self.k
        last = rank == self.k - 1
        self.group, self.id, self.score = group[keep], id[keep], score[keep]
        flat = self.bar.reshape(-1)
        flat[group[last]] = np.maximum(flat[group[last]], score[last])


def within(label: np.ndarray, id: np.ndarray, of: np.ndarray, of_id: np.ndarray, same: bool) -> np.ndarray:
    """Which (row, anchor) pairs are of different rows and of the same or of different labels."""
    return ((label[:, None] == of[None]) == same) & (id[:, None] != of_id[None])


class Block:
    """The rows of a block and their tree."""

    def __init__(self, id: np.ndarray, h: np.ndarray, label: np.ndarray, x: np.ndarray, m2: float):
        order = np.lexsort((h, label, id))
        id, h, label = id[order], h[order], label[order]
        first = np.ones(len(id), bool)
        first[1:] = (np.diff(id) != 0) | (np.diff(h) != 0) | (np.diff(label) != 0)
        id, label, x = id[first], label[first], x[order][first]
        wide = augmented(x, m2)
        self.tree = Tree(wide, SMALL_LEAF, m2)
        leaf, far = self.tree.descend(wide)
        order = np.argsort(leaf, kind="stable")
        self.id, self.label, self.x = id[order], label[order], x[order]
        self.starts = np.searchsorted(leaf[order], np.arange(len(self.tree.above) + 1))
        cells = [far[order][a:b] for a, b in zip(self.starts, self.starts[1:])]
        none = np.full((1, self.tree.depth), np.inf)
        self.least = np.array([(c if len(c) else none).min(0) for c in cells])
        self.most = np.array([(c if len(c) else -none).max(0) for c in cells])

    def search(self, q: np.ndarray, id: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, bar: np.ndarray, same: bool, k: int) -> Best:
        """The k best rows for each anchor (row of q) and window (column of low and high): leaves nearest to the inner edge first, while they can hold a better one than the k-th."""
        best = Best(low.shape, k, np.maximum(bar, low))
        if not len(q):
            return best
        least, most = self.tree.bounds(q, self.least, self.most)
        inner = np.minimum(most, high.max(1)[:, None])
        order = np.argsort(-inner, 1, kind="stable")
        every = np.arange(len(q))
        for step in range(order.shape[1]):
            leaf = order[:, step]
            open_ = ((most[every, leaf][:, None] >= best.bar) & (least[every, leaf][:, None] <= high)).any(1)
            group, ids, scores = [], [], []
            for at in np.unique(leaf[open_]):
                rows = slice(self.starts[at], self.starts[at + 1])
                who = np.flatnonzero(open_ & (leaf == at))
                s = self.x[rows] @ q[who].T
                fit = within(self.label[rows], self.id[rows], label[who], id[who], same)
                for w in range(low.shape[1]):
                    i, j = np.nonzero(fit & (s <= high[who, w][None]) & (s >= best.bar[who, w][None]))
                    group.append(who[j] * best.windows + w), ids.append(self.id[rows][i]), scores.append(s[i, j])
            if group:
                best.add(group, ids, scores)
        return best


def _windows(batch: pa.RecordBatch, columns: tuple[int, ...], k: int) -> list[np.ndarray]:
    """Lists of up to k numbers as matrices; windows that an anchor lacks are empty ones (low above high)."""
    out = []
    for c, missing in zip(columns, (np.inf, -np.inf, np.inf)):
        m = np.full((batch.num_rows, k), missing)
        column = batch.column(c)
        n = np.diff(column.offsets.to_numpy())
        m[np.arange(k)[None] < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        out.append(m)
    return out


class Index:
    """Rows with their leaves, and what anchors need to know of the leaves.

    ``rows`` has id (bigint), label (bigint), h (a hash of the vector) and x (array<double>) of the rows that take part.
    """

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
        n, m2, d = rows.agg(F.count("*"), F.coalesce(F.max(square), F.lit(0.0)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
        self.n, self.d = n, max(d, 1)
        m2 = float(m2)
        sample = rows.orderBy(F.xxhash64("id"), "id", "label", "h").limit(SAMPLE).select("id", "label", "x").toArrow().combine_chunks()
        x = matrix(sample["x"], self.d) if sample.num_rows else np.zeros((0, self.d))
        leaves = min(MOST_LEAVES, max(1, -(-n // LEAF_ROWS)))
        self.tree = Tree(augmented(x, m2), max(1, -(-len(x) // leaves)), m2)
        sampled = (sample["id"].to_numpy(), sample["label"].to_numpy(), x)
        shared = self.spark.sparkContext.broadcast((self.tree, self.d))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, d = shared.value
            for batch in batches:
                leaf, far = tree.descend(augmented(matrix(batch.column(3), d), tree.m2))
                far = pa.ListArray.from_arrays(pa.array(np.arange(0, far.size + 1, tree.depth, dtype=np.int32)), pa.array(far.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32)), far], names=["id", "label", "h", "x", "leaf", "far"])

        placed = cut(rows.select("id", "label", "h", "x").mapInArrow(place, "id bigint, label bigint, h bigint, x array<double>, leaf int, far array<double>"))
        depth = self.tree.depth
        edges = [f(F.get("far", F.lit(i))).alias(f"{name}{i}") for i in range(depth) for name, f in (("lo", F.min), ("hi", F.max))]
        cells = {r.leaf: r for r in placed.groupBy("leaf").agg(F.count("*").alias("n"), *edges).collect()}
        count = len(self.tree.above)
        least, most = np.full((count, depth), np.inf), np.full((count, depth), -np.inf)
        for leaf, r in cells.items():
            least[leaf], most[leaf] = [r[f"lo{i}"] for i in range(depth)], [r[f"hi{i}"] for i in range(depth)]
        self.blocks = [-(-cells[k].n // BLOCK_ROWS) if k in cells else 0 for k in range(count)]
        parts = F.get(F.array(*(F.lit(max(1, b)) for b in self.blocks)), F.col("leaf"))
        self.rows = placed.select("id", "label", "h", "x", "leaf", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
        self.shared = self.spark.sparkContext.broadcast((self.tree, self.d, least, most, np.array(self.blocks), sampled))

    def search(self, anchors: DataFrame, k: int, same: bool, windows: int) -> DataFrame:
        """qid, qh, w, id, score: the k best rows of each anchor and window, of the anchor's label or of others.

        ``anchors`` has qid, qh (with qid, its key), label, x, low and high (arrays of up to ``windows`` scores).
        """
        shared = self.shared
        kept = "qid bigint, qh bigint, label bigint, x array<double>, low array<double>, high array<double>"

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each anchor for each block that it has to see, with the scores it has to reach there (``bar``)."""
            tree, d, least, most, blocks, (s_id, s_label, s_x) = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    q, low, high = matrix(batch.column(3), d), *_windows(batch, (4, 5), windows)
                    id, label = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                    best = Best(low.shape, k, low)
                    s = s_x @ q.T
                    fit = within(s_label, s_id, label, id, same)
                    found = [np.nonzero(fit & (s <= high[:, w][None]) & (s >= low[:, w][None])) for w in range(windows)]
                    # Repeated rows of the sample count once.
                    pairs = [np.unique(np.stack([j * windows + w, s_id[i], s[i, j].view(np.int64)]), axis=1) for w, (i, j) in enumerate(found)]
                    best.add([p[0] for p in pairs], [p[1] for p in pairs], [p[2].view(np.float64) for p in pairs])
                    floor, top = tree.bounds(q, least, most)
                    see = ((top[:, :, None] >= best.bar[:, None]) & (floor[:, :, None] <= high[:, None])).any(2) & (blocks > 0)[None]
                    i, leaf = np.nonzero(see)
                    n = blocks[leaf]
                    own, leaf = np.repeat(i, n), np.repeat(leaf, n)
                    part = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                    bars = pa.ListArray.from_arrays(pa.array(np.arange(0, windows * len(own) + 1, windows, dtype=np.int32)), pa.array(best.bar[own].reshape(-1)))
                    take = pa.array(own)
                    yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array(leaf.astype(np.int32)), pa.array(part.astype(np.int32)), bars], names=[*batch.schema.names, "leaf", "part", "bar"])

        visits = anchors.select("qid", "qh", "label", "x", "low", "high").mapInArrow(route, kept + ", leaf int, part int, bar array<double>")
        visits = visits.select("leaf", "part", F.lit(1).alias("kind"), F.col("qid").alias("id"), F.col("qh").alias("h"), "label", "x", "low", "high", "bar")
        none = F.lit(None).cast("array<double>")
        stored = self.rows.select("leaf", "part", F.lit(0).alias("kind"), "id", "h", "label", "x", none.alias("low"), none.alias("high"), none.alias("bar"))
        meet = stored.unionByName(visits).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "kind")

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, d = shared.value[:2]
            here, gathered, block = None, [], None
            for batch in batches:
                key = np.stack([batch.column(i).to_numpy() for i in range(3)])
                bounds = [0, *(np.flatnonzero((np.diff(key) != 0).any(0)) + 1), batch.num_rows]
                for a, b in zip(bounds, bounds[1:]):
                    if (key[0, a], key[1, a]) != here:
                        here, gathered, block = (key[0, a], key[1, a]), [], None
                    if key[2, a] == 0:
                        part = batch.slice(a, b - a)
                        columns = [part.column(i).to_numpy() for i in (3, 4, 5)]
                        gathered.append((*columns, matrix(part.column(6), d)))
                        continue
                    if block is None and not gathered:
                        continue
                    if block is None:
                        block, gathered = Block(*(np.concatenate(x) for x in zip(*gathered)), tree.m2), []
                    for at in range(a, b, 512):
                        part = batch.slice(at, min(512, b - at))
                        low, high, bar = _windows(part, (7, 8, 9), windows)
                        id, h = part.column(3).to_numpy(), part.column(4).to_numpy()
                        best = block.search(matrix(part.column(6), d), id, part.column(5).to_numpy(), low, high, bar, same, k)
                        own = best.group // windows
                        yield pa.RecordBatch.from_arrays([pa.array(id[own]), pa.array(h[own]), pa.array((best.group % windows).astype(np.int32)), pa.array(best.id), pa.array(best.score)], names=["qid", "qh", "w", "id", "score"])

        found = meet.mapInArrow(answer, FOUND)
        rank = F.row_number().over(Window.partitionBy("qid", "qh", "w").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


def taking_part(vectors: DataFrame, vec_id: str, label: Column, vector: Column) -> DataFrame:
    """id, label, h and x of the rows that have an id, a label, and a vector of finite numbers. Labels that aren't integers go by their hash."""
    own = vectors.select(F.col(vec_id).cast("bigint").alias("id"), label.alias("label"), vector.cast("array<double>").alias("x"))
    code = F.col("label").cast("bigint") if isinstance(own.schema["label"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else F.xxhash64("label")
    number = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    return own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & number).select("id", code.alias("label"), F.xxhash64("x").alias("h"), "x")


def mine(vectors: DataFrame, anchors: Column, vec_id: str = "vec_id", label: Column | None = None, vector: Column | None = None, k: int = 10, positives: int = 5, low: float = 30, high: float = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on ``id``. An anchor's positives are its ``positives`` best rows of its label; for each, the k best rows of other
    labels whose score is from ``low`` to ``high`` per cent of the positive's. Score is the inner product, exact where vectors are of
    integers below 2**53 / 100 in all sums; higher ones come first, ties by the smaller id.

    Rows without an id, a label, or a vector of finite numbers take no part. A shorter vector counts as one with zeros behind. Repeated
    rows (id, label and vector alike) are one row; rows that share an id but not these are rows of their own, none of which is another row to an anchor of that id.
    Without rows, anchors, or rows in a window there are no results; a positive of a negative score has an empty window.
    """
    rows = taking_part(vectors, vec_id, F.col("label") if label is None else label, F.col("embedding") if vector is None else vector)
    index = Index(rows)
    one = F.array(F.lit(float("-inf"))), F.array(F.lit(float("inf")))
    own = cut(index.rows.where(anchors).select(F.col("id").alias("qid"), F.col("h").alias("qh"), "label", "x").dropDuplicates(["qid", "qh", "label"]))
    # With the label, as one id and vector may have two.
    own = own.withColumn("qh", F.xxhash64("qh", "label"))
    near = cut(index.search(own.withColumns({"low": one[0], "high": one[1]}), positives, True, 1))
    near = near.select("qid", "qh", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = near.groupBy("qid", "qh").agg(F.sort_array(F.collect_list(F.struct("w", "positive_score"))).alias("p"))
    # Of whole scores, a quotient that is whole is exact, and any other stays on its side of the next whole number.
    edge = lambda share: F.transform("p.positive_score", lambda s: s * float(share) / 100)
    seeking = own.join(windows, ["qid", "qh"]).withColumns({"low": edge(low), "high": edge(high)})
    out = index.search(seeking, k, False, positives).join(near, ["qid", "qh", "w"])
    return out.select(F.col("qid").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    out = mine(rows, F.col("id") % 100 == 0, label=label, vector=whole)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("positive_score").cast("long").alias("positive_score"), F.col("negative_score").cast("long").alias("negative_score"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS s FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS INTEGER) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s)
SELECT a AS anchor_id, p AS positive_id, rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 10"""
