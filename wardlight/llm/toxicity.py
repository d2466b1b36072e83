"""Toxicity: a convolutional text classifier written in numpy.

Words (runs of letters, ASCII case folded) hash to embeddings; embeddings of the
word's first bytes, at several lengths, are added, so an unseen ending of a known
stem still counts.  Filters of widths one to three run over the word sequence,
each filter keeps its largest value in the text, and a logistic layer turns
these into a score.  Texts are scored whole.

Every labelled row is learnt from, and Spark does the passes: rows are dealt into
shards by hash, in each epoch every shard is trained on its own from the common
state, row after row, and the states are averaged by the shards' rows.  What reaches
the driver is one state, whatever the number of rows; what is shuffled is the labelled
rows and a state for each shard and epoch, so shards are large.

A fifth of the labelled rows is kept out of training.  A slope and a shift fitted
on it calibrate the score, and for each language a threshold is chosen that gives
the best F1 on it; languages with too few of its rows take the common threshold.
Both come from counts of all these rows by logit, in steps of 1/256.
The language decides the threshold only, never the score.  The rarer label and the
rarer languages weigh more in training, so that they are learnt as well.

Null and empty texts hold only padding and score what padding scores; repeated
rows score alike; a null language takes the common threshold.  Without usable
labels, or with one class only, every score is the share of that class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm import textbytes as tb
from wardlight.llm.tables import sifted, tidy, written

WIDTHS = (1, 2, 3)
#: Lengths in bytes of the stems embedded beside the whole word.
STEMS = (4, 6)
PARTS = 1 + len(STEMS)
#: (width, place in the filter) of each block of table columns.
TAPS = [(w, k) for w in WIDTHS for k in range(w)]


@dataclass(frozen=True)
class Settings:
    buckets: int = 16_384
    dims: int = 16
    filters: int = 8  # for each width
    epochs: int = 8
    batch: int = 32
    batch_words: int = 1 << 16  # smaller batches where texts are long
    shard: int = 8_192  # rows trained on between two averages, at least
    shards: int = 1_024  # at most; beyond that, shards have more rows
    sent: int = 16 << 20  # bytes of labels that may be broadcast; more are joined by a shuffle
    held: int = 1_024  # rows of a shard held and shuffled at once
    held_words: int = 1_000_000  # or about so many words
    seed: int = 11


@dataclass
class Model:
    table: np.ndarray  # what a word adds at each tap of each filter
    bias: np.ndarray
    out: np.ndarray
    base: float
    thresholds: dict = field(default_factory=dict)
    common: float = 0.5
    seen: int = 0  # rows that each epoch went through

    def logits(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        peaks, _ = convolve(self.table, self.bias, words, bounds)
        return np.clip(np.maximum(peaks, 0) @ self.out + self.base, -30, 30)

    def scores(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(words, bounds)))


def words_of(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and stem buckets of a padded word sequence, and each row's place in it.

    Two padding words (bucket ``buckets``) follow each row, so every filter
    fits and none reaches into the next row.
    """
    data = tb.LOWER[data]
    starts, ends = tb.runs(tb.IS_LETTER[data], offsets)
    hasher = tb.Hasher(data)
    bounds = tb.per_row(starts, offsets)
    place = np.arange(len(starts)) + 2 * tb.row_of(bounds)
    words = np.full((len(starts) + 2 * (len(offsets) - 1), PARTS), buckets, np.int32)
    words[place, 0] = hasher.ranges(starts, ends) % np.uint64(buckets)
    for part, length in enumerate(STEMS, 1):
        stems = hasher.ranges(starts, np.minimum(ends, starts + length)) ^ np.uint64(0x5DEECE66D * part)
        words[place, part] = tb.mix(stems) % np.uint64(buckets)
    return words, bounds + 2 * np.arange(len(bounds))


def tap_table(embeddings: np.ndarray, kernels: np.ndarray) -> np.ndarray:
    """Embeddings (buckets, dims) through all taps (taps, dims, filters); padding adds nothing."""
    flat = embeddings @ kernels.transpose(1, 0, 2).reshape(kernels.shape[1], -1)
    return np.vstack([flat, np.zeros((1, flat.shape[1]), flat.dtype)])


def convolve(table, bias, words, bounds):
    """Largest value of each filter in each row, and where its window starts."""
    filters = table.shape[1] // len(TAPS)
    rows = len(bounds) - 1
    peaks = np.zeros((rows, len(WIDTHS) * filters), table.dtype)
    places = np.zeros(peaks.shape, np.int64)
    if not rows:
        return peaks, places
    at = table[words[:, 0]]
    for part in range(1, words.shape[1]):
        at += table[words[:, part]]
    ends = bounds[1:]
    for b, width in enumerate(WIDTHS):
        first = TAPS.index((width, 0)) * filters
        value = at[:, first : first + filters].copy()
        for k in range(1, width):
            value[:-k] += at[k:, first + k * filters : first + (k + 1) * filters]
        value[ends - 1] = value[ends - 2] = -np.inf  # windows of padding only
        empty = bounds[:-1] == ends - 2
        value[bounds[:-1][empty]] = 0
        columns = slice(b * filters, (b + 1) * filters)
        top = np.maximum.reduceat(value, bounds[:-1], axis=0)
        peaks[:, columns] = top + bias[columns]
        for f in range(filters):
            hit = np.flatnonzero(value[:, f] == np.repeat(top[:, f], np.diff(bounds)))
            places[:, b * filters + f] = hit[np.searchsorted(hit, bounds[:-1])]
    return peaks, places


@dataclass
class State:
    """Parameters with Adam's two moments and its step; as one vector while it is averaged."""

    params: list[np.ndarray]
    first: list[np.ndarray]
    second: list[np.ndarray]
    step: float = 0.0

    def vector(self) -> np.ndarray:
        return np.concatenate([*(p.ravel() for p in (*self.params, *self.first, *self.second)), [self.step]]).astype(np.float32)

    def of(self, vector: np.ndarray) -> State:
        """The state of this one's shapes that ``vector`` holds."""
        parts, at = [], 0
        for p in (*self.params, *self.first, *self.second):
            parts.append(vector[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        k = len(self.params)
        return State(parts[:k], parts[k : 2 * k], parts[2 * k :], float(vector[at]))


def start(contrast: np.ndarray, s: Settings) -> State:
    """Random parameters; the first dimension starts as how much more often toxic texts hold the word."""
    rng = np.random.default_rng(s.seed)
    outputs = len(WIDTHS) * s.filters
    params = [
        rng.normal(0, 0.05, (s.buckets, s.dims)).astype(np.float32),
        rng.normal(0, s.dims**-0.5, (len(TAPS), s.dims, s.filters)).astype(np.float32),
        np.full(outputs, -1.0, np.float32),
        np.abs(rng.normal(0, 0.3, outputs)).astype(np.float32) * np.where(np.arange(outputs) % 4 == 3, -1, 1).astype(np.float32),
        np.full((), -1.0, np.float32),
    ]
    params[0][:, 0] = contrast
    params[1][:, 0, :] = np.abs(params[1][:, 0, :])
    return State(params, [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params])


def trained(state: State, rows: Iterator[list[tuple]], s: Settings, epoch: int, shard: int) -> State:
    """``state`` after one pass over a shard's rows: lists of (words, label, weight)."""
    rng = np.random.default_rng([s.seed, epoch, shard])
    rate = 1e-2 * 0.5 * (1 + np.cos(np.pi * epoch / s.epochs)) + 1e-4
    params, first, second, step = list(state.params), list(state.first), list(state.second), state.step
    for held in rows:
        labels, weights = np.array([r[1] for r in held]), np.array([r[2] for r in held])
        batches = max(1, len(held) // s.batch, sum(len(r[0]) for r in held) // s.batch_words)
        for chosen in np.array_split(rng.permutation(len(held)), min(batches, len(held))):
            words, bounds = joined([held[i][0] for i in chosen])
            step += 1
            for k, g in enumerate(gradients(params, words, bounds, labels[chosen], s, weights[chosen])):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return State(params, first, second, step)


def _contrast(held: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Standardised difference of the shares of texts, by label, that hold each bucket.

    ``held`` counts them by label and bucket, ``n`` the texts by label.
    """
    n = np.maximum(n, 1).reshape(2, 1)
    share = held / n
    both = (held.sum(axis=0) + 1) / (n.sum() + 2)
    z = (share[1] - share[0]) / np.sqrt(both * (1 - both) * (1 / n).sum())
    return np.clip(z / 3, -1, 3)[:-1].astype(np.float32)


def joined(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(sequences), np.cumsum([0, *(len(x) for x in sequences)])


def gradients(params, words, bounds, y, s: Settings, weights: np.ndarray | None = None):
    """Of the mean log loss; only the window that a filter kept passes it back."""
    embeddings, kernels, bias, out, base = params
    peaks, places = convolve(tap_table(embeddings, kernels), bias, words, bounds)
    active = np.maximum(peaks, 0)
    error = (1 / (1 + np.exp(-np.clip(active @ out + base, -30, 30))) - y) / len(y)
    if weights is not None:
        error = error * weights
    back = (np.outer(error, out) * (peaks > 0)).astype(np.float32)
    g_embeddings, g_kernels = np.zeros_like(embeddings), np.zeros_like(kernels)
    padded = np.vstack([embeddings, np.zeros((1, s.dims), embeddings.dtype)])
    for tap, (width, k) in enumerate(TAPS):
        block = WIDTHS.index(width)
        grad = back[:, block * s.filters : (block + 1) * s.filters]
        at = np.minimum(places[:, block * s.filters : (block + 1) * s.filters] + k, len(words) - 1)
        for part in range(words.shape[1]):
            ids = words[at, part]
            g_kernels[tap] += np.einsum("rfd,rf->df", padded[ids], grad)
            real = ids < s.buckets
            np.add.at(g_embeddings, ids[real], (grad[:, :, None] * kernels[tap].T[None])[real])
    return g_embeddings, g_kernels, back.sum(0), active.T @ error, error.sum()


def calibration(logits: np.ndarray, truth: np.ndarray, rounds: int = 50, counts: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of the logits that fit ``truth`` best, by Newton's method.

    ``counts`` tells how many rows each pair stands for (one).
    The targets are drawn in by what one more row of either label would change,
    so that labels which the logits part entirely still give a finite slope.
    """
    counts = np.ones(len(truth)) if counts is None else counts
    ones, rows = (truth * counts).sum(), counts.sum()
    if not 0 < ones < rows:
        return 1.0, 0.0
    target = np.where(truth == 1, (ones + 1) / (ones + 2), 1 / (rows - ones + 2))
    x = np.column_stack([logits, np.ones(len(logits))])
    at = np.array([1.0, 0.0])

    def loss(w):
        z = x @ w
        return float((counts * (np.logaddexp(0, z) - target * z)).sum()) + 1e-3 * (w[0] - 1) ** 2

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (counts * (p - target)) + np.array([2e-3 * (at[0] - 1), 0])
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + np.diag([2e-3, 1e-9]), slope)
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def best_threshold(scores: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> float:
    """The middle of the gap below which the cut with the best F1 lies.

    The scores differ; ``counts`` rows have each, ``ones`` of them labelled 1.
    """
    if ones.sum() == 0:
        return 0.5
    order = np.argsort(-scores, kind="stable")
    f1 = 2 * np.cumsum(ones[order]) / (np.cumsum(counts[order]) + ones.sum())
    k = int(np.argmax(f1))
    below = scores[order[k + 1]] if k + 1 < len(order) else 0.0
    return float((scores[order[k]] + below) / 2)


#: Floats of a shard's vector that are added up together, and steps of a logit.
CHUNK, STEPS = 4_096, 256


def _added(shards: DataFrame, make: Callable, s: Settings) -> np.ndarray | None:
    """Sum over shards of ``make(rows, shard)``'s vector times the shard's rows, and the sum of rows as its last entry.

    ``rows`` gives a shard's (words, label, weight) in lists of bounded size.  Shards
    are added in their order, so the sum is the same wherever they were worked on.
    """

    def lists(rows: Iterator[tuple], count: list) -> Iterator[list[tuple]]:
        held, words = [], 0
        for _, raw, n, y, weight in rows:
            held.append((_unpacked(raw, n, s), y, weight))
            count[0] += 1
            words += len(held[-1][0])
            if len(held) >= s.held or words >= s.held_words:
                yield held
                held, words = [], 0
        if held:
            yield held

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tb.release()
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "words", "n", "y", "weight"))))
        for shard, own in groupby(rows, key=lambda row: row[0]):
            count = [0]
            vector = np.append(make(lists(own, count), shard), 1).astype(np.float32)
            parts = [vector[a : a + CHUNK].tobytes() for a in range(0, len(vector), CHUNK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([shard] * len(parts), pa.int64()), pa.array(count * len(parts), pa.int64()), pa.array(parts)],
                ["part", "shard", "n", "vector"],
            )

    def add(table: pa.Table) -> pa.Table:
        total = 0.0
        for _, n, raw in sorted(zip(*(table[c].to_pylist() for c in ("shard", "n", "vector")))):
            total = total + n * np.frombuffer(raw, np.float32).astype(np.float64)
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})

    vectors = shards.mapInArrow(work, "part int, shard long, n long, vector binary")
    got = sorted(vectors.groupBy("part").applyInArrow(add, "part int, total binary").collect())
    return np.concatenate([np.frombuffer(r.total) for r in got]) if got else None


def _kind(s: Settings):
    return np.uint16 if s.buckets < 1 << 16 else np.int32


def _unpacked(raw: bytes, n: int, s: Settings) -> np.ndarray:
    kind = np.dtype(_kind(s))
    return np.frombuffer(pa.decompress(raw, n * PARTS * kind.itemsize, "zstd", asbytes=True), kind).reshape(-1, PARTS)


def _labelled(docs: DataFrame, usable: DataFrame, key: str, s: Settings) -> DataFrame:
    """``docs`` joined with ``usable``; hardly a text without a label is shuffled, and none where labels are few."""
    usable = written(usable, "toxicity-labels")
    size = usable.agg(F.sum(F.octet_length(F.col(key).cast("string")) + 24)).first()[0] or 0
    if size <= s.sent:
        return docs.join(F.broadcast(usable), key)
    return sifted(docs, key, usable).where("_maybe").drop("_maybe").join(usable, key)


def learn(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), key: str = "doc_id", label: str = "toxic") -> Model:
    """Fit on all documents that have a label.

    A hash of key and text decides a row's shard, its place there, and whether it
    is in the fifth that calibrates; so equal rows are on one side.
    Training rows weigh by the root of how rare their label and language are together.
    """
    usable = labels.select(key, F.col(label).cast("double").alias("y")).where(f"{key} is not null and y in (0, 1)")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(key, F.coalesce("text", F.lit("")).alias("text"), F.coalesce(lang, F.lit("")).alias("lang"))
    rows = _labelled(rows, usable, key, s).withColumn("place", F.xxhash64(key, "text", F.lit("place")))

    def work(data, offsets):
        words, bounds = words_of(data, offsets, s.buckets)
        words = words.astype(_kind(s))
        return [pa.array([pa.compress(words[a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(bounds, bounds[1:])], pa.binary()), pa.array(np.diff(bounds))]

    found = written(tb.with_columns(rows, "text", work, "words binary, n long", ["place", "y", "lang"]), "toxicity-rows")
    apart = F.pmod(F.shiftrightunsigned("place", 32), F.lit(5)) == 0
    counts = {(r.y, r.apart): r["count"] for r in found.groupBy("y", apart.alias("apart")).count().collect()}
    n = np.array([sum(c for (y, _), c in counts.items() if y == own) for own in (0, 1)])
    if not n.all():
        share = float(n[1] / n.sum()) if n.sum() else 0.5
        logit = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return Model(np.zeros((s.buckets + 1, len(TAPS) * s.filters), np.float32), np.zeros(len(WIDTHS) * s.filters), np.zeros(len(WIDTHS) * s.filters), logit)
    trains = [counts.get((y, False), 0) for y in (0.0, 1.0)]
    shards = min(s.shards, max(1, -(-sum(trains) // s.shard)))
    train = found.where(~apart)
    groups = train.groupBy("y", "lang").agg((1 / F.sqrt(F.count("*"))).alias("rare"), F.count("*").alias("rows"))
    groups = written(groups, "toxicity-groups")
    mean = groups.agg(F.sum(F.col("rare") * F.col("rows")) / F.sum("rows")).first()[0] or 1.0
    weighted = train.join(groups.select("y", "lang", (F.col("rare") / mean).alias("weight")), ["y", "lang"])
    dealt = weighted.select(F.pmod("place", F.lit(shards)).alias("shard"), "place", F.xxhash64("words").alias("tie"), "y", "weight", "words", "n")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "place", "tie", "y", "weight")
    dealt = dealt.select("shard", "y", "weight", "words", "n").persist(StorageLevel.DISK_ONLY)
    try:
        model = _passes(dealt, np.array(trains), s)
    finally:
        dealt.unpersist()
    return _calibrated(model, found.where(apart), s)


def _passes(dealt: DataFrame, n: np.ndarray, s: Settings) -> Model:
    def held(rows, shard):
        counts, texts = np.zeros((2, s.buckets + 1)), 0
        for part in rows:
            for words, y, _ in part:
                counts[int(y), np.unique(words)] += 1
            texts += len(part)
        return counts.ravel() / texts  # times the shard's rows when added

    got = _added(dealt, held, s)
    state = start(_contrast((np.zeros(2 * s.buckets + 2) if got is None else got[:-1]).reshape(2, -1), n), s)
    for epoch in range(s.epochs):
        tidy(dealt.sparkSession)  # the states of the epoch before
        got = _added(dealt, lambda rows, shard, state=state, epoch=epoch: trained(state, rows, s, epoch, shard).vector(), s)
        if got is not None:
            state = state.of(got[:-1] / got[-1])
    embeddings, kernels, bias, out, base = state.params
    seen = 0 if got is None else round(got[-1])
    return Model(tap_table(embeddings, kernels).astype(np.float32), bias, out, float(base), seen=seen)


def _calibrated(model: Model, apart: DataFrame, s: Settings) -> Model:
    """``model`` with the slope, shift and thresholds that fit the rows kept out of training."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "words", tb.SLICE // 4):
            sequences = joined([_unpacked(w, n, s) for w, n in zip(batch.column("words").to_pylist(), batch.column("n").to_pylist())])
            steps = np.rint(model.logits(*sequences) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("y"), pa.array(steps)], ["lang", "y", "step"])

    scored = apart.select("lang", "y", "words", "n").mapInArrow(work, "lang string, y double, step int")
    cells = written(scored.groupBy("lang", "step").agg(F.count("*").alias("n"), F.sum("y").alias("ones")), "toxicity-logits")
    common = cells.groupBy("step").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).orderBy("step").toPandas()
    if not len(common):
        return model
    logits, ones, rows = common["step"].to_numpy() / STEPS, common["ones"].to_numpy(), common["n"].to_numpy()
    truth = np.repeat([1.0, 0.0], len(logits))
    slope, shift = calibration(np.tile(logits, 2), truth, counts=np.concatenate([ones, rows - ones]))
    model.out, model.base = model.out * slope, model.base * slope + shift

    def scores(steps: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(steps / STEPS * slope + shift, -30, 30)))

    model.common = best_threshold(scores(common["step"].to_numpy()), ones, rows)
    enough = cells.where("lang <> ''").groupBy("lang").agg(F.sum("n").alias("rows"), F.sum("ones").alias("yes")).where("yes >= 10 and rows - yes >= 10")
    own = cells.join(enough.select("lang"), "lang").orderBy("lang", "step").toPandas()
    for name, mine in own.groupby("lang"):
        model.thresholds[name] = best_threshold(scores(mine["step"].to_numpy()), mine["ones"].to_numpy(), mine["n"].to_numpy())
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score``, ``threshold`` and ``toxic``.

    ``toxic`` is the verdict at the language's own threshold.
    """
    buckets = len(model.table) - 1

    def work(data, offsets):
        return [pa.array(model.scores(*words_of(data, offsets, buckets)).astype(np.float64))]

    names = docs.columns if keep is None else keep
    own = F.lit(None).cast("double")
    if "lang" in docs.columns:
        for lang, value in model.thresholds.items():
            own = F.when(F.col("lang") == lang, F.lit(value)).otherwise(own)
    held = docs.drop("threshold", "toxic").withColumn("threshold", F.coalesce(own, F.lit(model.common)))
    names = [c for c in names if c not in ("threshold", "toxic")] + ["threshold"]
    return tb.with_columns(held, "text", work, "score double", names).withColumn("toxic", F.col("score") >= F.col("threshold"))
