"""Segmentation quality and k-means."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .once import once_packed
from .order import attach

#: Centres from which on distances are left out by bounds.
MANY_CENTRES = 16
#: Bytes of rows packed into one value, and a task's share at least where there are more tasks than cores.
BLOCK_BYTES, TASK_BYTES = 1 << 19, 1 << 24
#: Bytes of tasks' sums that come to the driver as they are; more are first added up in tasks.
SUMS_BYTES = 1 << 26


def ch_index(bcss: Column, wcss: Column, n: Column, k: Column) -> Column:
    """(bcss / (k - 1)) / (wcss / (n - k)); 1 where wcss is 0, null unless 2 <= k <= n - 1."""
    score = (bcss / F.nullif(k - 1, F.lit(0)).cast("double")) / F.nullif(wcss / F.nullif(n - k, F.lit(0)).cast("double"), F.lit(0.0))
    return F.when((k < 2) | (k > n - 1), F.lit(None).cast("double")).when(wcss == 0, 1.0).otherwise(score)


def calinski_harabasz(df: DataFrame, features: str, label: str) -> DataFrame:
    """n, k, wcss, bcss, calinski_harabasz of an array column by label.

    Sums go over (label, dimension), after a map-side combine: shuffled rows are labels times dimensions for each task.
    """
    long = df.select(F.col(label).alias("label"), F.posexplode(features).alias("d", "x")).select("label", "d", F.col("x").cast("double").alias("x"))
    cells = long.groupBy("label", "d").agg(F.count("*").alias("m"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    wcss = cells.agg(F.sum(F.col("m") * F.col("var")).alias("wcss"), F.count_distinct("label").alias("k"))
    centre = cells.groupBy("d").agg((F.sum(F.col("m") * F.col("mean")) / F.sum("m")).alias("centre"), F.sum("m").alias("n"))
    between = cells.join(centre, "d").agg(F.sum(F.col("m") * (F.col("mean") - F.col("centre")) * (F.col("mean") - F.col("centre"))).alias("bcss"), F.max("n").alias("n"))
    return attach(wcss, between).withColumn("calinski_harabasz", ch_index(F.col("bcss"), F.col("wcss"), F.col("n"), F.col("k")))


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0.0)


def nearest(x: np.ndarray, centres: np.ndarray, counted: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row (the first of equals) and the squared distance.

    With many centres most are left out by the triangle inequality: a row's guess is the best of the group of
    its nearest representative, and a guess that is nearer than half the way from it to any other centre is right. ``counted`` gets the number of
    distances that were worked out.
    """
    k = len(centres)
    if k < MANY_CENTRES:
        d = _squared(x, centres)
        if counted is not None:
            counted.append(d.size)
        return d.argmin(1), d[np.arange(len(x)), d.argmin(1)]
    between = _squared(centres, centres)
    heads = [0]
    for _ in range(int(np.sqrt(k)) - 1):  # farthest first
        heads.append(int(between[heads].min(0).argmax()))
    group = between[:, heads].argmin(1)
    head = _squared(x, centres[heads]).argmin(1)
    near, best = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    work = len(x) * len(heads)
    for g in range(len(heads)):
        rows, members = np.flatnonzero(head == g), np.flatnonzero(group == g)
        if len(rows):
            d = _squared(x[rows], centres[members])
            near[rows], best[rows] = members[d.argmin(1)], d.min(1)
            work += d.size
    np.fill_diagonal(between, np.inf)
    # strictly nearer, by more than rounding, so that no other centre is as near
    open_ = np.flatnonzero(best * (1 + 1e-9) + 1e-12 >= between.min(1)[near] / 4)
    if len(open_):
        d = _squared(x[open_], centres)
        near[open_], best[open_] = d.argmin(1), d.min(1)
        work += d.size
    if counted is not None:
        counted.append(work)
    return near, best


def _plus_plus(points: np.ndarray, weights: np.ndarray, k: int, seed: int, tries: int = 8, steps: int = 25) -> np.ndarray:
    """k centres of weighted points: k-means++, then some steps of Lloyd's over the points; the best of some tries, as points are few."""
    rng = np.random.default_rng(seed)
    best, least = None, np.inf
    for _ in range(tries):
        chosen = [points[rng.choice(len(points), p=weights / weights.sum())]]
        for _ in range(k - 1):
            far = _squared(points, np.array(chosen)).min(1) * weights
            chosen.append(points[rng.choice(len(points), p=far / far.sum()) if far.sum() else rng.integers(len(points))])
        centres = np.array(chosen)
        for _ in range(steps):
            near, d = nearest(points, centres)
            total = np.bincount(near, weights, k)
            moved = np.stack([np.bincount(near, weights * points[:, j], k) for j in range(points.shape[1])], 1)
            new = np.where(total[:, None] > 0, moved / np.maximum(total, 1e-300)[:, None], centres)
            if np.array_equal(new, centres):
                break
            centres = new
        cost = float((nearest(points, centres)[1] * weights).sum())
        if best is None or cost < least:
            best, least = centres, cost
    return best


def nearest_each(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` for several models of as many centres (models, k, dimensions), by one product of matrices: (models, rows) each."""
    models, k, width = centres.shape
    if k >= MANY_CENTRES:
        near, best = zip(*(nearest(x, c) for c in centres))
        return np.array(near), np.array(best)
    c = centres.transpose(1, 0, 2).reshape(k * models, width)
    d = (-2 * c) @ x.T
    d += (x * x).sum(1)
    d += (c * c).sum(1)[:, None]
    d = np.maximum(d, 0.0, out=d).reshape(k, models, len(x))
    near, best = np.zeros((models, len(x)), np.uint8), d[0]
    for j in range(1, k):
        np.copyto(near, j, where=d[j] < best)
        np.minimum(best, d[j], out=best)
    return near, best


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in blocks of bytes: the number of dimensions, then the numbers."""
    for batch in batches:
        x = _matrix(batch.column(0)) if len(batch) else np.zeros((0, 1))
        some = max(1, BLOCK_BYTES // (8 * max(1, x.shape[1])))
        for at in range(0, len(x), some):
            yield pa.RecordBatch.from_arrays([pa.array([np.int64(x.shape[1]).tobytes() + x[at : at + some].tobytes()], pa.binary())], names=["x"])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of arrays, or of blocks as ``_pack`` makes them."""
    column = column.drop_null()
    if pa.types.is_binary(column.type):
        blocks = [memoryview(b.as_buffer()) for b in column]
        return np.concatenate([np.frombuffer(b, np.float64, offset=8).reshape(-1, np.frombuffer(b, np.int64, 1)[0]) for b in blocks])
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows a batch at a time, or a block at a time."""
    for batch in batches:
        column = batch.column(0)
        many = 1 if pa.types.is_binary(column.type) else max(1, len(column))
        for at in range(0, len(column), many):
            yield _matrix(column.slice(at, many))


def _uniform(seed: int, step: int, task: int, rows: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) hashed from a seed and a row's place in a table that is read again as it is."""
    h = rows.astype(np.uint64) + np.uint64((task << 40) & (2**64 - 1)) + np.uint64((seed * 0x9E3779B97F4A7C15 + step * 0xD1B54A32D192ED03) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def seeding(rows: DataFrame, seeds: Sequence[int], k: int, rounds: int = 5) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Candidates and their weights for each seed, by oversampling over all rows (k-means||), for up to k centres.

    A first row is drawn evenly; each round then draws 2 k more, without replacement and with a chance by their squared distance to the
    candidates so far: those of the least -ln(u) / d^2, of which a task puts out 2 k at most. A last pass counts the rows nearest to
    each candidate. ``rows`` (x, arrays or blocks of ``_pack``) is read again in each round and has to be written or checkpointed. All seeds share the passes.
    """
    found: dict[int, np.ndarray] = {}

    def drawn(batches: Iterator[pa.RecordBatch], step: int, held: dict[int, np.ndarray], many: int) -> Iterator[pa.RecordBatch]:
        task, at, best = TaskContext.get().partitionId(), 0, {s: [] for s in seeds}
        for x in _matrices(batches):
            place = np.arange(at, at + len(x))
            at += len(x)
            for s in seeds if len(x) else ():
                d = nearest(x, held[s])[1] if s in held else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    key = np.where(d > 0, -np.log(_uniform(s, step, task, place)) / d, np.inf)
                order = np.argsort(key, kind="stable")
                order = order[np.isfinite(key[order])]
                # copies of a row are one candidate; they share a projection
                _, first = np.unique(x[order] @ _uniform(s, -1, 0, np.arange(x.shape[1])), return_index=True)
                best[s] = sorted([*best[s], *((float(key[i]), x[i].tolist()) for i in order[np.sort(first)][:many])])[:many]
        out = [(s, *e) for s in seeds for e in best[s]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(), pa.float64(), pa.list_(pa.float64())))], names=["seed", "key", "x"])

    for step in range(rounds + 1):
        many = 1 if step == 0 else 2 * k
        every = rows.mapInArrow(lambda b, step=step, held=dict(found), many=many: drawn(b, step, held, many), "seed bigint, key double, x array<double>")
        every = every.groupBy("seed", "x").agg(F.min("key").alias("key"))
        place = F.row_number().over(Window.partitionBy("seed").orderBy("key", "x"))
        for r in every.withColumn("place", place).where(F.col("place") <= many).orderBy("seed", "place").collect():
            point = np.array([r.x])
            found[r.seed] = np.concatenate([found[r.seed], point]) if r.seed in found else point
    if not found:
        raise ValueError("no rows to cluster")

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {s: np.zeros(len(c)) for s, c in found.items()}
        for x in _matrices(batches):
            for s, c in found.items() if len(x) else ():
                n[s] += np.bincount(nearest(x, c)[0], minlength=len(c))
        out = [(s, j, v) for s in n for j, v in enumerate(n[s].tolist()) if v]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.float64()))], names=["seed", "j", "n"])

    weights = {s: np.zeros(len(c)) for s, c in found.items()}
    for r in rows.mapInArrow(weighed, "seed bigint, j int, n double").groupBy("seed", "j").agg(F.sum("n").alias("n")).collect():
        weights[r.seed][r.j] = r.n
    return {s: (c, weights[s]) for s, c in found.items()}


def fit_kmeans(df: DataFrame, features: str, models: Sequence[tuple[int, int]], max_iter: int | None = None, tolerance: float = 1e-6, rounds: int = 5, starts: Sequence[np.ndarray] | None = None) -> list[tuple[np.ndarray, float]]:
    """Centres and cost of each (k, seed), all fitted side by side: a pass over the rows moves the centres of every model that still moves.

    Starts come from ``seeding`` over all rows, or are given (``starts``, an array of centres a model). The rows are evaluated once and packed into blocks, to a checkpoint
    that every pass reads. Each task adds up its rows; a sum a model, centre and dimension comes back. Rows without features take no part.

    A model is done where its centres are the means of their rows, to within ``tolerance``, or after ``max_iter`` moves if that is given. It also
    ends where a clustering comes back that it had before, told by a mark summed over hashes of rows and their centres: beyond that, only rounding moves it.
    """
    packed, held = once_packed(df.select(F.col(features).cast("array<double>").alias("x")).where("x IS NOT NULL").mapInArrow(_pack, "x binary"))
    spark = df.sparkSession
    packed = packed.coalesce(max(spark.sparkContext.defaultParallelism, held // TASK_BYTES))
    if starts is None:
        candidates = seeding(spark.createDataFrame(packed.map(lambda b: (b,)), "x binary"), sorted({s for _, s in models}), max(k for k, _ in models), rounds)
        starts = [_plus_plus(*candidates[s], k, s) for k, s in models]
    found = [(np.array(c, np.float64), np.inf) for c in starts]
    moving = list(range(len(models)))
    had: list[set[int]] = [set() for _ in models]

    def sums(blocks: Iterator[bytes], here: list[np.ndarray]) -> Iterator[list[tuple[np.ndarray, ...]]]:
        out = [(np.zeros_like(c), np.zeros(c.shape[:2]), np.zeros(len(c)), np.zeros(len(c), np.uint64)) for c in here]
        task, at = TaskContext.get().partitionId(), 0
        for block in blocks:
            x = _matrix(pa.array([block], pa.binary()))
            place = (_uniform(0, 0, task, np.arange(at, at + len(x))) * 2.0**53).astype(np.uint64)
            at += len(x)
            for c, (total, n, cost, mark) in zip(here, out):
                near, d = nearest_each(x, c)
                own = (near == np.arange(c.shape[1]).reshape(-1, 1, 1)).astype(np.float64)
                total += (own.reshape(-1, len(x)) @ x).reshape(own.shape[:2] + x.shape[1:]).transpose(1, 0, 2)
                n += own.sum(2).T
                cost += d.sum(1)
                mark += ((near.astype(np.uint64) + np.uint64(1)) * place).sum(1, dtype=np.uint64)
        yield out

    def added(a: list[tuple[np.ndarray, ...]], b: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
        return [tuple(p + q for p, q in zip(*both)) for both in zip(a, b)]

    for step in count():
        sizes: dict[tuple, list[int]] = {}  # models of as many centres together, those of many by themselves
        for m in moving:
            k = len(found[m][0])
            sizes.setdefault((k, m if k >= MANY_CENTRES else None), []).append(m)
        here = [np.array([found[m][0] for m in each]) for each in sizes.values()]
        parts = packed.mapPartitions(lambda blocks, here=here: sums(blocks, here))
        if packed.getNumPartitions() * sum(c.nbytes for c in here) > SUMS_BYTES:
            whole = parts.treeReduce(added)
        else:
            whole = reduce(added, parts.collect())
        still = []
        for each, centres, of in zip(sizes.values(), here, whole):
            for m, c, total, n, cost, mark in zip(each, centres, *of):
                new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)  # a centre without rows stays where it is
                moved = ((new - c) ** 2).sum(1).max()
                if moved > tolerance * tolerance and int(mark) not in had[m] and (max_iter is None or step < max_iter):
                    had[m].add(int(mark))
                    still.append(m)
                    found[m] = new, float(cost)
                else:
                    found[m] = c, float(cost)
        moving = sorted(still)
        if not moving:
            break
    return found


def centre_table(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """(cluster, centre) of fitted centres, to be kept or looked at."""
    return df.sparkSession.createDataFrame([(j, c.tolist()) for j, c in enumerate(centres)], "cluster int, centre array<double>")


def assign(df: DataFrame, features: str, centres: np.ndarray, out: str = "cluster", squared: str | None = None) -> DataFrame:
    """``df`` with the nearest centre's number (the first of equals), and its squared distance if ``squared`` names a column; null where features are."""
    centres = np.array(centres, np.float64)

    @F.pandas_udf("struct<c int, d double>")
    def of(x: pd.Series) -> pd.DataFrame:
        there = x.notna().to_numpy()
        found = pd.DataFrame({"c": pd.array([None] * len(x), "Int32"), "d": pd.array([None] * len(x), "Float64")})
        if there.any():
            near, d = nearest(np.array(x[there].tolist(), np.float64), centres)
            found.loc[there, "c"], found.loc[there, "d"] = near.astype(np.int32), d
        return found

    rows = df.withColumn("__near", of(F.col(features).cast("array<double>"))).withColumn(out, F.col("__near.c"))
    return (rows.withColumn(squared, F.col("__near.d")) if squared else rows).drop("__near")


def kmeans(df: DataFrame, features: str, k: int, seeds: Sequence[int] = (42,), out: str = "cluster") -> DataFrame:
    """Clusters of the best of several starts, by cost; null where features are."""
    centres, _ = min(fit_kmeans(df, features, [(k, s) for s in seeds]), key=lambda m: m[1])
    return assign(df, features, centres, out)


def k_sweep(df: DataFrame, features: str, ks: Sequence[int] = range(2, 8), seeds: Sequence[int] = range(42, 52)) -> DataFrame:
    """k, calinski_harabasz, is_best (the first maximum), of the best of the starts for each k; all are fitted side by side."""
    models = [(k, s) for k in ks for s in seeds]
    fitted = fit_kmeans(df, features, models)
    costs = [(k, min(cost for (k2, _), (_, cost) in zip(models, fitted) if k2 == k)) for k in ks]
    long = df.where(F.col(features).isNotNull()).select(F.posexplode(F.col(features).cast("array<double>")).alias("d", "x"))
    whole = long.groupBy("d").agg(F.count("*").alias("n"), F.var_pop("x").alias("v")).agg(F.max("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("tss"))
    table = attach(df.sparkSession.createDataFrame(costs, "k int, wcss double"), whole)
    table = table.select("k", ch_index(F.col("tss") - F.col("wcss"), F.col("wcss"), F.col("n"), F.col("k")).alias("calinski_harabasz"))
    best = table.agg(F.max_by("k", F.struct("calinski_harabasz", -F.col("k"))).alias("best"))
    return attach(table, best).select("k", "calinski_harabasz", (F.col("k") == F.col("best")).alias("is_best"))


def profile(df: DataFrame, cluster: str, means: Sequence[str], target: str | None = None) -> DataFrame:
    """count, the mean of each column and the target's rate, to two places, by cluster."""
    columns = [F.count("*").alias("count"), *(F.round(F.avg(c), 2).alias(f"mean_{c}") for c in means)]
    if target is not None:
        columns.append(F.round(F.avg(F.col(target).cast("double")), 2).alias("rate"))
    return df.groupBy(cluster).agg(*columns)
