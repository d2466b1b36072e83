"""Hard negatives by zone maps of Hilbert-ordered candidate blocks.

Vectors become whole numbers, ``floor(256 x)``; a row's score for an anchor is
their inner product.  An anchor's positives are its first rows of the same label
by score; for each positive its negatives are the first rows of another label
whose score lies in a window around that of the positive.

1. *Blocks.*  Rows are ordered along a Hilbert curve through the leading whitened
   coordinates and cut into blocks of ``block`` rows, written as Parquet rows with
   the smallest and largest value of every dimension (zone map) and the labels held.
   The order only decides how tight the zone maps are.
2. *Anchors* are dealt out, in the same order, to groups of ``group``.
3. *Bounds.*  For an anchor ``a`` and a block, the score lies between
   ``a+ lo + a- hi`` and ``a+ hi + a- lo`` (positive and negative parts of ``a``).
   A block is read for an anchor's positives if its label occurs there and the
   upper bound reaches the anchor's last positive of its own block; it is read for
   the negatives if another label occurs and the bounds meet one of its windows.
   Only blocks that some anchor of a group must read are joined to the group, and
   only partitions of the block table that hold such blocks are scanned.
4. *Reading.*  A task scores a group against a run of blocks and keeps the first
   few of each anchor (and window); a ranking over the runs settles the rest.

Every anchor is held against every zone map, group by group; no task holds more
than a group and a run of blocks, whatever the size of a label.

Rows without id, label or vector, or with a null or non-finite component, take no
part; nor do components of 2**31 / 256 and more, whose products leave 64 bits.
Vectors of different lengths are compared as if the shorter ended in zeros.
Higher scores come first, then smaller ids; rows that repeat an id count as rows of
their own.  A positive whose score is negative has an empty window.  Empty tables
give no rows; columns other than key, vector and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.llm import whitening
from wardlight.llm.tables import written
from wardlight.operators.ordering import first_n, with_running
from wardlight.session import scratch_path

SCALE = 256
LOWEST = -(1 << 63)


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    negatives: int = 10
    low: int = 30  # per cent of the positive's score
    high: int = 90
    block: int = 256
    group: int = 1024
    run: int = 32  # blocks that a task scores against a group
    zones: int = 4096  # zone maps that a task holds against a group
    parts: int = 1024  # partitions of the block table, at most
    axes: int = 8
    bits: int = 7


# -- Hilbert order -----------------------------------------------------------------


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point (whole numbers below 2**bits) on the Hilbert curve.

    The axes are turned and mirrored bit by bit, from the highest, so that the
    curve enters each cell where it left the one before; then the bits are woven.
    """
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for k in range(axes):
            mirror = (x[k] >> level) & 1 == 1
            swap = np.where(mirror, 0, (x[0] ^ x[k]) & below)
            x[0] = np.where(mirror, x[0] ^ below, x[0] ^ swap)
            x[k] ^= swap
    for k in range(1, axes):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(axes):
            key = key << 1 | (x[k] >> level) & 1
    return key


def _keys(models: dict[int, whitening.Model], s: Settings):
    """Vectors as 32-bit whole numbers, with their place on the curve."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, whitening.ROWS):
                batch = whole.slice(at, whitening.ROWS)
                sizes = np.array([len(v) for v in batch.column("v")], np.int64)
                for size in np.unique(sizes):
                    rows = pa.array(np.flatnonzero(sizes == size))
                    v = batch.column("v").take(rows).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)
                    m = models.get(int(size))
                    axes = 0 if m is None else len(m.values)
                    key = np.zeros(len(rows), np.int64)
                    if axes:
                        mean = np.array([k / m.n for k in m.sums]) - whitening.SHIFT
                        z = (whitening.SCALE * v - mean) @ (m.components / np.sqrt(m.values)[:, None]).T
                        cells = np.floor((np.clip(z, -4, 4) + 4) / 8 * (1 << s.bits))
                        key = hilbert(np.clip(cells, 0, (1 << s.bits) - 1), s.bits)
                    x = np.floor(SCALE * v).astype("<i4")
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("id").take(rows),
                            batch.column("label").take(rows),
                            pa.array(np.full(len(rows), size), pa.int32()),
                            pa.array(key),
                            pa.array([r.tobytes() for r in x], pa.binary()),
                        ],
                        ["id", "label", "size", "curve", "x"],
                    )

    return work


# -- blocks and their bounds ----------------------------------------------------------


def matrix(raw: list[bytes]) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    width = max(map(len, raw), default=0) // 4
    if all(len(r) == 4 * width for r in raw):
        return np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), width).astype(np.int64)
    out = np.zeros((len(raw), width), np.int64)
    for k, r in enumerate(raw):
        out[k, : len(r) // 4] = np.frombuffer(r, "<i4")
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a b'`` of whole numbers, exact."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * width
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), LOWEST, (1 << 63) - 1).astype(np.int64)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score that any vector between ``low`` and ``high`` can have."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def _zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's rows as one matrix, its zone map and its labels."""
    for batch in batches:
        for block, part, held in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), batch.column("held")):
            rows = pa.RecordBatch.from_struct_array(held.values)
            x = matrix(rows.column("x").to_pylist())
            label = rows.column("label").to_numpy()
            values = (
                block, rows.column("row").to_numpy().tobytes(), rows.column("id").to_numpy().tobytes(), label.tobytes(), x.astype("<i4").tobytes(),
                x.min(axis=0).astype("<i4").tobytes(), x.max(axis=0).astype("<i4").tobytes(), np.unique(label).tolist(), part,
            )
            kinds = [pa.int64(), *[pa.binary()] * 6, pa.list_(pa.int64()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], BLOCK_NAMES)


BLOCK_NAMES = ["block", "rows", "ids", "row_labels", "x", "low", "high", "labels", "part"]
BLOCKS = "block long, rows binary, ids binary, row_labels binary, x binary, low binary, high binary, labels array<long>, part int"


def write_blocks(rows: DataFrame, s: Settings) -> DataFrame:
    """The block table: one row a block, a folder for each part of the curve."""
    total = rows.count()
    per_part = max(1, -(-total // (s.block * s.parts)))
    block = F.expr(f"(row - 1) div {s.block}")
    cut = rows.withColumn("block", block).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("row", "id", "label", "x"))).alias("held"))
    cut = cut.withColumn("part", F.expr(f"cast(block div {per_part} as int)"))
    path = scratch_path(rows.sparkSession, "blocks")
    cut.repartition("part").mapInArrow(_zones, BLOCKS).write.partitionBy("part").parquet(path)
    return rows.sparkSession.read.schema(BLOCKS).parquet(path)


# -- what an anchor looks for ----------------------------------------------------------


class Goals:
    """Score ranges of the anchors of a group, each for one label or for the others.

    ``low`` and ``high`` have a row for each anchor and a column for each range.
    """

    def __init__(self, group: pd.DataFrame, same: bool, count: int):
        self.pos = group["pos"].to_numpy()
        self.row, self.label = group["row"].to_numpy(), group["label"].to_numpy()
        self.x = matrix(group["x"].tolist())
        self.low = np.array(group["low"].tolist(), np.int64).reshape(len(group), -1)
        self.high = np.array(group["high"].tolist(), np.int64).reshape(len(group), -1)
        self.same, self.count = same, count

    def wanted(self, low: np.ndarray, high: np.ndarray, labels: list) -> np.ndarray:
        """Flags (anchor, block): a block that must be read."""
        least, most = bounds(self.x, low, high)
        reach = ((most[:, :, None] >= self.low[:, None, :]) & (least[:, :, None] <= self.high[:, None, :])).any(axis=2)
        for k, held in enumerate(labels):
            held = np.asarray(held)
            reach[:, k] &= np.isin(self.label, held) if self.same else (len(held) > 1) | (self.label != held[0])
        return reach


def _needs(same: bool):
    """Zone maps of a run against a group: blocks to read, and for which anchors."""

    def work(zones: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(zones) and len(group):
            goals = Goals(group, same, 0)
            for at in range(0, len(zones), 64):
                part = zones.iloc[at : at + 64]
                flags = goals.wanted(matrix(part["low"].tolist()), matrix(part["high"].tolist()), part["labels"].tolist())
                for k, (block, folder) in enumerate(zip(part["block"], part["part"])):
                    who = goals.pos[flags[:, k]]
                    if len(who):
                        out.append((group["g"].iloc[0], block, folder, who.tolist()))
        return pd.DataFrame(out, columns=["g", "block", "part", "who"])

    return work


NEEDS = "g long, block long, part int, who array<long>"
FOUND = "g long, pos long, goal int, score long, id long, row long"


def _read(same: bool, count: int):
    """Scores of a group against a run of blocks: the first ``count`` rows of each range."""

    def work(run: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        names = [f.split()[0] for f in FOUND.split(", ")]
        if not len(run) or not len(group):
            return pd.DataFrame([], columns=names)
        goals = Goals(group, same, count)
        place = {p: k for k, p in enumerate(goals.pos.tolist())}
        floor = goals.low.copy()
        best = np.zeros((0, 5), np.int64)  # anchor, goal, minus score, id, row
        for who, rows, ids, labels, x in zip(run["who"], run["rows"], run["ids"], run["row_labels"], run["x"]):
            at = np.array([place[p] for p in who])
            rows, ids, labels = (np.frombuffer(raw, np.int64) for raw in (rows, ids, labels))
            vectors = np.frombuffer(x, "<i4").reshape(len(rows), -1).astype(np.int64)
            score = products(goals.x[at], vectors)
            fits = (goals.label[at][:, None] == labels) == same
            fits &= goals.row[at][:, None] != rows
            new = [best]
            for goal in range(floor.shape[1]):
                held = fits & (score >= floor[at, goal][:, None]) & (score <= goals.high[at, goal][:, None])
                if len(rows) > count:  # of each anchor only what reaches its last place in this block
                    last = np.partition(np.where(held, score, LOWEST), -count, axis=1)[:, -count]
                    held &= score >= last[:, None]
                i, j = np.nonzero(held)
                new.append(np.column_stack([at[i], np.full(len(i), goal), -score[i, j], ids[j], rows[j]]))
            best = _first(np.concatenate(new), count)
            # Where a range is full, only as high a score can still enter.
            key, start, size = np.unique(best[:, 0] * floor.shape[1] + best[:, 1], return_index=True, return_counts=True)
            full = size == count
            lowest = -best[start[full] + count - 1, 2]
            floor[key[full] // floor.shape[1], key[full] % floor.shape[1]] = lowest
        g = group["g"].iloc[0]
        out = pd.DataFrame(best, columns=["pos", "goal", "score", "id", "row"])
        out["pos"], out["score"] = goals.pos[best[:, 0]], -best[:, 2]
        out["g"], out["goal"] = g, out["goal"].astype(np.int32)
        return out[names]

    return work


def _first(rows: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` rows of each (anchor, goal), in order."""
    rows = rows[np.lexsort((rows[:, 4], rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    if not len(rows):
        return rows
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    start = np.flatnonzero(new)
    rank = np.arange(len(rows)) - start[np.cumsum(new) - 1]
    return rows[rank < count]


def _run_of(size: int) -> Column:
    return F.expr(f"block div {size}")


def _meet(left: DataFrame, goals: DataFrame, size: int, fn, schema: str) -> DataFrame:
    """``fn`` of each run of ``size`` blocks of ``left`` and the anchors of its group."""
    left = written(left.withColumn("c", _run_of(size)), "units")
    pairs = left.select(F.col("g").alias("_g"), F.col("c").alias("_c")).distinct()
    right = goals.join(pairs, F.col("g") == F.col("_g")).drop("g").withColumnRenamed("_g", "g")
    return left.groupBy("g", "c").cogroup(right.groupBy("g", "_c")).applyInPandas(fn, schema)


def _search(blocks: DataFrame, goals: DataFrame, needs: DataFrame, same: bool, count: int, s: Settings) -> DataFrame:
    """The first ``count`` rows of each range among the blocks that ``needs`` names."""
    parts = [r["part"] for r in needs.select("part").distinct().collect()]  # at most s.parts
    chosen = blocks.where(F.col("part").isin(parts)) if parts else blocks.where("false")
    units = needs.select("g", "block", "who").join(chosen.select("block", "rows", "ids", "row_labels", "x"), "block")
    found = written(_meet(units, goals, s.run, _read(same, count), FOUND), "found")
    order = [F.desc("score"), F.asc("id"), F.asc("row")]
    return first_n(found, ["g", "pos", "goal"], order, count, spread_by=F.col("row"))


def _bounded(blocks: DataFrame, goals: DataFrame, groups: int, same: bool, s: Settings) -> DataFrame:
    """Blocks that the zone maps do not rule out, for each group of anchors."""
    zones = blocks.select("block", "part", "low", "high", "labels")
    spread = zones.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("g", F.col("g").cast("long"))
    return written(_meet(spread, goals, s.zones, _needs(same), NEEDS), "needs")


# -- the job ------------------------------------------------------------------------


def usable(vectors: DataFrame, key: str, column: str, label: Column) -> DataFrame:
    """(id, label, v): rows that take part."""
    whole = F.transform(column, lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float((1 << 31) // SCALE))))
    rows = vectors.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v"))
    return rows.where("id is not null and label is not null and v is not null").where(fine)


def mine(
    vectors: DataFrame,
    anchor: Column | None = None,
    key: str = "vec_id",
    column: str = "embedding",
    label: Column | None = None,
    s: Settings = Settings(),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` says, in terms of ``id``, which rows are anchors (all by default).
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, column, F.col("label") if label is None else label)
    sized = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    commonest = -1 if sized is None else sized["size"]
    models = whitening.fit(rows.where(F.size("v") == commonest).select("v"), s.axes) if sized else {}
    keyed = rows.mapInArrow(_keys(models, s), "id long, label long, size int, curve long, x binary")
    order = ["size", "curve", "id", "label", "x"]
    numbered = written(with_running(keyed, [], order, number="row"), "numbered")
    blocks = write_blocks(numbered, s)
    chosen = numbered.where(F.lit(True) if anchor is None else anchor).select("row", "id", "label", "x")
    anchors = with_running(chosen, [], ["row"], number="_number")
    place = [F.expr(f"(_number - 1) div {s.group}").alias("g"), F.expr(f"(_number - 1) % {s.group}").alias("pos")]
    anchors = written(anchors.select(*place, "row", "id", "label", "x"), "anchors")
    groups = -(-anchors.count() // s.group)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not groups:
        return spark.createDataFrame([], schema)

    # The last positive in an anchor's own block is a score that its positives reach at least.
    every = anchors.withColumns({"low": F.array(F.lit(LOWEST + 1)), "high": F.array(F.lit((1 << 63) - 1))})
    own = anchors.withColumn("block", F.expr(f"(row - 1) div {s.block}")).groupBy("g", "block").agg(F.collect_list("pos").alias("who"))
    own = written(own.join(blocks.select("block", "part"), "block"), "own-blocks")
    seen = _search(blocks, every, own, True, s.positives, s)
    least = seen.groupBy("g", "pos").agg(F.when(F.count("*") == s.positives, F.min("score")).alias("least"))
    goals = every.join(least, ["g", "pos"], "left").withColumn("low", F.array(F.coalesce("least", F.lit(LOWEST + 1)))).drop("least")
    goals = written(goals, "positive-goals")
    found = _search(blocks, goals, _bounded(blocks, goals, groups, True, s), True, s.positives, s)
    rank = F.row_number().over(W.partitionBy("g", "pos").orderBy(F.desc("score"), "id", "row"))  # at most s.positives rows
    positives = written(
        found.select("g", "pos", (rank - 1).alias("goal"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives"
    )

    # Windows in whole numbers: low * score <= 100 * negative <= high * score.
    low = -F.expr(f"cast(floor(cast(-{s.low} as decimal(38,0)) * positive_score / 100) as long)")
    high = F.expr(f"cast(floor(cast({s.high} as decimal(38,0)) * positive_score / 100) as long)")
    ranges = positives.groupBy("g", "pos").agg(F.sort_array(F.collect_list(F.struct("goal", low.alias("low"), high.alias("high")))).alias("windows"))
    # Every anchor has as many ranges; those it lacks are empty.
    padded = F.slice(F.concat("windows", F.array_repeat(F.struct(F.lit(s.positives).alias("goal"), F.lit(1).cast("long").alias("low"), F.lit(0).cast("long").alias("high")), s.positives)), 1, s.positives)
    goals = anchors.join(ranges, ["g", "pos"]).withColumn("windows", padded)
    goals = written(goals.withColumn("low", F.col("windows.low")).withColumn("high", F.col("windows.high")).drop("windows"), "negative-goals")
    found = _search(blocks, goals, _bounded(blocks, goals, groups, False, s), False, s.negatives, s)
    rank = F.row_number().over(W.partitionBy("g", "pos", "goal").orderBy(F.desc("score"), "id", "row"))  # at most s.negatives rows
    ranked = found.select("g", "pos", "goal", rank.alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.join(anchors.select("g", "pos", F.col("id").alias("anchor_id")), ["g", "pos"])
    return ranked.join(named, ["g", "pos", "goal"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
