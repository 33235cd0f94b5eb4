"""Quality classifier: gated-attention multiple-instance learning over passages.

A text is a bag of passages of ``PASSAGE`` consecutive words. Every passage is encoded by shape
statistics and a signed hashed bag of its words, a small dense layer embeds it, gated attention
(tanh and sigmoid branches multiplied) weighs the passages, and a logistic unit scores the weighted
sum. Only documents are labelled; attention learns which passages decide. Training is full-batch
Adam with hand-written gradients on a bounded sample of labelled documents; scoring is one narrow
pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .quality_rules import sample_of

PASSAGE, HASHED, EMBED, GATE = 64, 32, 16, 8
_SHAPE = {
    "symbol": K.byte_set(*((ord(c), ord(c)) for c in "#*$%&<>")),
    "bar": K.byte_set((124, 124)),
    "bang": K.byte_set((33, 33)),
    "upper": K.byte_set((65, 90)),
    "lower": K.byte_set((97, 122)),
    "digit": K.byte_set((48, 57)),
    "high": K.byte_set((128, 255)),
    "stop": K.byte_set((46, 46)),
    "comma": K.byte_set((44, 44)),
}
_LAGS = (1, 2, 3, 5, 8)
WIDTH = len(_SHAPE) + 3 + len(_LAGS) + HASHED


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (float32, WIDTH columns) and each text's first passage. A text without words has none."""
    starts, ends, first = K.spans(data, offsets, K.NOT_SPACE)
    counts = np.diff(first)
    passages = -(-counts // PASSAGE)
    bag = np.concatenate([[0], np.cumsum(passages)])
    if not bag[-1]:
        return np.zeros((0, WIDTH), np.float32), bag
    words = K.hashes(data, starts, ends, fold=True)
    owner = K.owners(first)
    within = np.arange(len(words)) - first[owner]
    passage = bag[owner] + within // PASSAGE
    head = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    n = np.diff(np.concatenate([head, [len(words)]])).astype(np.float64)
    a, b = starts[head], ends[np.concatenate([head[1:], [len(words)]]) - 1]
    chars = np.add.reduceat((ends - starts).astype(np.float64), head)
    columns = []
    for members in _SHAPE.values():
        running = np.concatenate([np.zeros(1, np.int64), np.cumsum(members[data], dtype=np.int64)])
        columns.append((running[b] - running[a]) / chars)
    columns += [chars / n / 10, np.log1p(n) / np.log1p(PASSAGE), np.add.reduceat((ends - starts == 1).astype(np.float64), head) / n]
    for lag in _LAGS:
        same = np.zeros(len(words))
        if len(words) > lag:
            same[lag:] = (words[lag:] == words[:-lag]) & (passage[lag:] == passage[:-lag])
        columns.append(np.add.reduceat(same, head) / n)
    bucket = (words >> K.U(40)).astype(np.int64) % HASHED
    sign = 1.0 - 2.0 * ((words >> K.U(8)) & K.U(1)).astype(np.float64)
    hashed = np.bincount(passage * HASHED + bucket, sign, bag[-1] * HASHED).reshape(-1, HASHED) / np.sqrt(n)[:, None] / 4
    return np.column_stack([*columns, hashed]).astype(np.float32), bag


@dataclass
class Model:
    """Parameters; ``shift`` and ``scale`` standardise the features."""

    shift: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        return _forward(self.weights, (x - self.shift) * self.scale, bag)["p"]

    def attention(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        return _forward(self.weights, (x - self.shift) * self.scale, bag)["a"]


def _segment_sum(x: np.ndarray, bag: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)])
    return sums[bag[1:]] - sums[bag[:-1]]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["enc"] + w["enc0"])
    t = np.tanh(h @ w["tan"])
    g = 1 / (1 + np.exp(-(h @ w["sig"])))
    e = np.exp(np.clip((t * g) @ w["att"], -30, 30))
    own = K.owners(bag)
    total = np.bincount(own, e, len(bag) - 1) if len(own) else np.zeros(len(bag) - 1)
    a = e / total[own]
    z = _segment_sum(a[:, None] * h, bag)
    p = 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out0"][0], -30, 30)))
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": p, "own": own}


def train(x: np.ndarray, bag: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.02, decay: float = 1e-4, seed: int = 11) -> Model:
    """Fit to bags. Input of one class, or none, gives a constant score (the smoothed share of 1)."""
    shift = x.mean(0) if len(x) else np.zeros(WIDTH)
    scale = 1 / (x.std(0) + 1e-3) if len(x) else np.ones(WIDTH)
    rng = np.random.default_rng(seed)
    w = {
        "enc": rng.normal(0, WIDTH**-0.5, (WIDTH, EMBED)),
        "enc0": np.zeros(EMBED),
        "tan": rng.normal(0, EMBED**-0.5, (EMBED, GATE)),
        "sig": rng.normal(0, EMBED**-0.5, (EMBED, GATE)),
        "att": rng.normal(0, GATE**-0.5, GATE),
        "out": np.zeros(EMBED),
        "out0": np.array([np.log((y.sum() + 1) / ((1 - y).sum() + 1))]),
    }
    if not len(y) or y.min() == y.max() or not len(x):
        return Model(shift, scale, w)
    x = ((x - shift) * scale).astype(np.float64)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(q) for k, q in w.items()}
    for step in range(1, steps + 1):
        s = _forward(w, x, bag)
        h, t, g, a, own = s["h"], s["t"], s["g"], s["a"], s["own"]
        d = (s["p"] - y) / len(y)
        dz = d[:, None] * w["out"]
        dh = a[:, None] * dz[own]
        da = (h * dz[own]).sum(1)
        ds = a * (da - np.bincount(own, a * da, len(y))[own])
        dt, dg = ds[:, None] * w["att"] * g * (1 - t * t), ds[:, None] * w["att"] * t * g * (1 - g)
        dh += dt @ w["tan"].T + dg @ w["sig"].T
        de = dh * (1 - h * h)
        grad = {"out": s["z"].T @ d, "out0": np.array([d.sum()]), "att": (t * g).T @ ds, "tan": h.T @ dt, "sig": h.T @ dg, "enc": x.T @ de, "enc0": de.sum(0)}
        for k in w:
            gk = grad[k] + (decay * w[k] if k not in ("out0", "enc0") else 0)
            m[k] = 0.9 * m[k] + 0.1 * gk
            v[k] = 0.999 * v[k] + 0.001 * gk * gk
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(shift, scale, w)


def _encoded(docs: DataFrame, text: int, columns: list[str]) -> DataFrame:
    """The id and label of each row with its passages' features as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.slices(batch, text):
                x, bag = encode(data, offsets)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in columns), pa.array([x[a:b].tobytes() for a, b in zip(bag[:-1], bag[1:])], pa.binary())], names=[*columns, "x"])

    types = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([f"{c} {types[c]}" for c in columns] + ["x binary"]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_labelled: int = 4_000, most_passages: int = 300_000, doc_id: str = "doc_id", text: str = "text", **options) -> Model:
    """Train on at most ``most_labelled`` documents whose crc32(id) mod 4 is not 2.

    The sample is taken by a hash of the id. ``most_passages`` bounds the driver's memory: in the order of that hash, a document that would pass it is left out of the training, never of the scoring, and shorter ones after it are not.
    """
    sample = sample_of(labels, docs, label, most_labelled, doc_id, text, where=~held_out())
    rows = _encoded(sample, sample.columns.index("text"), ["doc_id", "label"])
    bags, y, n = [], [], 0
    for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").toLocalIterator():
        x = np.frombuffer(bytes(r.x), np.float32).reshape(-1, WIDTH)
        if n + len(x) > most_passages:
            continue
        n += len(x)
        bags.append(x)
        y.append(float(r.label > 0))
    bag = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    return train(np.concatenate(bags) if bags else np.zeros((0, WIDTH)), bag, np.array(y), **options)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def score(docs: DataFrame, model: Model, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages of every row. Null and empty texts have no passage and get the model's constant; a null id counts as not held out. Rows are scored one by one, so ties and repeats are no matter; further columns of docs are not read. A very long text takes about 400 bytes a passage of PASSAGE words, and linear time."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.slices(batch, 1):
                x, bag = encode(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(x, bag)), pa.array(np.diff(bag))], names=["doc_id", "score", "n_passages"])

    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = base.mapInArrow(run, f"doc_id {dict(base.dtypes)['doc_id']}, score double, n_passages bigint")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "n_passages")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels))
