"""Quality classifier: random-indexing word vectors, pooled, then a small network.

1. Every token (a run of letters or a run of other signs, case kept) hashes to
   one of ``buckets`` words.  A word owns a sparse random index vector; its
   meaning vector is the sum of the index vectors found next to it anywhere in
   the corpus.  Tasks add up their own part, the parts are summed by Spark.
2. A document is the mean of its word vectors, the mean of their squares and
   the mean product of neighbours.
3. A two-layer network learns on a bounded sample of labelled documents; a
   temperature fitted on rows kept out of training calibrates its output.

Null and empty texts have no tokens: their vector is zero and they get the
network's answer to a zero vector; very long texts are pooled whole.  Repeated
rows score alike; rows that tie in the order of the sample are equal.  Without any
usable label the score is 0.5, and an empty table gives an empty result.  Input
columns may have any names; one called ``score`` gives way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm import textbytes as tb
from wardlight.llm.tables import first_by_hash, written

NEIGHBOURS = (1, 2)
NONZERO = 2
BLOCKS = 64


@dataclass(frozen=True)
class Settings:
    buckets: int = 8192
    dims: int = 32
    hidden: int = 48
    max_labelled: int = 20_000  # bound of the labelled sample that is learnt from
    epochs: int = 60
    seed: int = 7


@dataclass
class Network:
    """Weights of the fitted network; ``None`` weights mean nothing to learn from."""

    layers: list = field(default_factory=list)
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.zeros(len(x))
        w1, b1, w2, b2 = self.layers
        hidden = np.maximum(((x - self.centre) / self.scale) @ w1 + b1, 0)
        return hidden @ w2 + b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def index_vectors(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero parts of each word's index vector."""
    rng = np.random.default_rng(s.seed)
    return rng.integers(0, s.dims, (s.buckets, NONZERO)), rng.choice([-1, 1], (s.buckets, NONZERO))


def tokens(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Word bucket of every token, and where each row's tokens begin."""
    starts, ends = tb.runs(~tb.IS_SPACE[data], offsets, tb.IS_LETTER[data])
    words = tb.Hasher(data).ranges(starts, ends) % np.uint64(buckets)
    return words.astype(np.int64), tb.per_row(starts, offsets)


def _context_sums(s: Settings):
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors(s)
        total = np.zeros(s.buckets * s.dims)
        for batch in tb.slices(batches, "text"):
            words, bounds = tokens(*tb.text_bytes(batch.column("text")), s.buckets)
            row = tb.row_of(bounds)
            for gap in NEIGHBOURS:
                same = np.flatnonzero(row[gap:] == row[:-gap]) if len(row) > gap else []
                left, right = words[:-gap][same], words[gap:][same]
                for word, other in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        total += np.bincount(word * s.dims + places[other, k], signs[other, k], len(total))
        yield _blocks(np.arange(BLOCKS), total.astype(np.int64).reshape(BLOCKS, -1))

    return part


def _blocks(ids, sums) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(ids, np.int32)), pa.array([x.tobytes() for x in sums], pa.binary())], ["block", "sums"]
    )


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
            sums = np.frombuffer(raw, np.int64)
            found[block] = found[block] + sums if block in found else sums
    if found:
        yield _blocks(list(found), found.values())


def word_vectors(docs: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """Meaning vectors of all word buckets over the whole corpus.

    The result has a fixed size (``buckets`` x ``dims``).  Parts are added in
    two steps, so no task reads more than a sixteenth of a block's parts.
    """
    parts = docs.select("text").mapInArrow(_context_sums(s), "block int, sums binary")
    salted = parts.withColumn("salt", F.spark_partition_id() % 16).repartition("block", "salt").drop("salt")
    summed = salted.mapInArrow(_add_blocks, "block int, sums binary").repartition(BLOCKS, "block")
    table = np.zeros((BLOCKS, s.buckets * s.dims // BLOCKS))
    for row in summed.mapInArrow(_add_blocks, "block int, sums binary").collect():
        table[row.block] = np.frombuffer(row.sums, np.int64)
    vectors = table.reshape(s.buckets, s.dims)
    vectors = np.sign(vectors) * np.log1p(np.abs(vectors))
    seen = np.abs(vectors).sum(1) > 0
    if seen.any():
        vectors[seen] -= vectors[seen].mean(0)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Document vectors: mean, mean square and mean neighbour product."""
    words, bounds = tokens(data, offsets, len(vectors))
    out = np.zeros((len(bounds) - 1, 3 * vectors.shape[1]), np.float32)
    counts = np.diff(bounds)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    own = vectors[words]
    beside = np.zeros_like(own)
    beside[:-1] = own[:-1] * own[1:]
    beside[bounds[1:][full] - 1] = 0  # the last token of a row has no next one
    for k, values in enumerate((own, own * own, beside)):
        sums = np.add.reduceat(values, bounds[:-1][full], axis=0, dtype=np.float64)
        out[full, k * vectors.shape[1] : (k + 1) * vectors.shape[1]] = sums / counts[full, None]
    return out


def fit(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Network:
    """Two-layer network by Adam, then one temperature on a tenth kept apart."""
    if len(y) < 2 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        logit = np.log((share + 1e-3) / (1 - share + 1e-3))
        return Network([np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), logit], np.zeros(x.shape[1]), np.ones(x.shape[1]))
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(len(y))
    apart, train = order[: len(y) // 10], order[len(y) // 10 :]
    net = Network([], x[train].mean(0), x[train].std(0) + 1e-6)
    z = (x - net.centre) / net.scale
    w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], s.hidden)), np.zeros(s.hidden), rng.normal(0, s.hidden**-0.5, s.hidden), np.zeros(())]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    step = 0
    for epoch in range(s.epochs):
        rate = 3e-3 * 0.5 * (1 + np.cos(np.pi * epoch / s.epochs))
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
            hidden = np.maximum(z[rows] @ w[0] + w[1], 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(error, w[2]) * (hidden > 0)
            grads = [z[rows].T @ back + 1e-4 * w[0], back.sum(0), hidden.T @ error + 1e-4 * w[2], error.sum()]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.layers = w
    if len(apart):
        raw, grid = net.logits(x[apart]), np.exp(np.linspace(-1.5, 2.5, 81))
        loss = [np.mean(np.logaddexp(0, raw / t) - y[apart] * raw / t) for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def labelled_sample(labels: DataFrame, key: str, label: str, limit: int) -> DataFrame:
    """At most about ``limit`` labelled rows, chosen by a hash of the key."""
    usable = labels.select(key, F.col(label).cast("double").alias("y")).where(f"{key} is not null and y is not null")
    share = min(1.0, limit / max(1, usable.count()))
    return usable.where(F.pmod(F.xxhash64(key, F.lit("labelled")), F.lit(1_000_000)) < int(share * 1_000_000))


@dataclass
class Model:
    """Word vectors and network: all that scoring a text needs."""

    vectors: np.ndarray
    network: Network


def learn(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), label: str = "quality", key: str = "doc_id") -> Model:
    """Word vectors from all of ``docs``, the network from the labelled sample.

    The sample holds at most about ``max_labelled`` keys, so it may be broadcast;
    of the rows that have them at most twice as many are learnt from, the first
    by a hash of key and text, in that order, however the table is cut.
    """
    vectors = word_vectors(docs, s)
    sample = labelled_sample(labels, key, label, s.max_labelled)
    rows = docs.select(key, F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), key)
    rows = rows.withColumn("place", F.xxhash64(key, "text", F.lit("place")))

    def work(data, offsets):
        return [pa.array([v.tobytes() for v in pooled(data, offsets, vectors)], pa.binary())]

    found = written(tb.with_columns(rows, "text", work, "vector binary", ["place", "y"]), "quality-sample")
    got = first_by_hash(found, "place", 2 * s.max_labelled).toArrow().sort_by([(c, "ascending") for c in ("place", "y")])
    x = np.frombuffer(b"".join(got["vector"].to_pylist()), np.float32).reshape(got.num_rows, 3 * s.dims)
    return Model(vectors, fit(x.astype(np.float64), got["y"].to_numpy(), s))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score``, in one pass without a shuffle."""

    def work(data, offsets):
        x = pooled(data, offsets, model.vectors).astype(np.float64)
        return [pa.array(model.network.probabilities(x))]

    return tb.with_columns(docs, "text", work, "score double", keep)
