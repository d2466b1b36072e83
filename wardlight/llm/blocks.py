"""Comparing the rows of a group with each other, with groups of any size.

A group larger than a block is cut into blocks by a hash; its rows are sent to
every pair of blocks that theirs belongs to.  So no task holds more than two
blocks of a group, and only what a comparison finds leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 48
#: Side of a row within its unit: alone, lower block, upper block.
ALONE, LOWER, UPPER = 0, 1, 2


def block_units(rows: DataFrame, size: int, key: str = "key", count: str = "n", spread: str = "id") -> DataFrame:
    """``rows`` with ``unit`` and ``side``, sorted by unit within partitions.

    ``count`` is the number of rows of the row's group.
    """
    blocks = F.ceil(F.col(count) / F.lit(size)).cast("int")
    held = rows.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64(spread, F.lit("block")), F.col("_blocks")).cast("int"))
    other = F.explode(F.when(F.col("_blocks") > 1, F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(F.array(F.lit(0))))
    paired = held.withColumn("_other", other)
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(F.col("_own") == F.col("_other"), ALONE).when(F.col("_own") < F.col("_other"), LOWER).otherwise(UPPER)
    units = paired.withColumn("unit", F.xxhash64(key, low, high)).withColumn("side", side)
    return units.drop("_blocks", "_own", "_other", count).repartition("unit").sortWithinPartitions("unit")


def whole_units(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.Table]:
    """The sorted batches again, in tables of about ``rows`` rows that never split a unit."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows)
            at += part.num_rows
            unit = part.column("unit").to_numpy()
            last = int(np.searchsorted(unit, unit[-1]))  # units ascend, so this is where the last one begins
            if held and (last > 0 or held[-1].column("unit")[-1].as_py() != unit[0]):
                cut = last if last > 0 else 0
                if count + cut >= rows or last == 0:
                    if cut:
                        held.append(part.slice(0, cut))
                    yield pa.Table.from_batches(held)
                    held, count, part = [], 0, part.slice(cut)
            held.append(part)
            count += part.num_rows
    if held:
        yield pa.Table.from_batches(held)


def unit_bounds(unit: np.ndarray) -> np.ndarray:
    """Where each unit of a sorted column begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(np.diff(unit)) + 1, [len(unit)]]) if len(unit) else np.zeros(1, int)


def small_pairs(unit: np.ndarray, side: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs to compare within units of up to ``SMALL`` rows, at once."""
    sizes = np.diff(bounds)
    inside = np.repeat(sizes <= SMALL, sizes)
    lefts, rights = [], []
    for gap in range(1, min(SMALL, int(sizes[sizes <= SMALL].max(initial=0)))):
        at = np.flatnonzero((unit[gap:] == unit[:-gap]) & inside[gap:])
        lefts.append(at)
        rights.append(at + gap)
    if not lefts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = np.concatenate(lefts), np.concatenate(rights)
    meet = (side[left] == ALONE) | (side[left] != side[right])
    return left[meet], right[meet]


def large_units(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a > SMALL:
            yield int(a), int(b)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the smallest row that the pairs connect it to."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new[new]
    return label
