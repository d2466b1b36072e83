"""Words and hashes of whole Arrow text columns, by numpy over the UTF-8 bytes.

A batch is worked on in slices of about ``SLICE`` bytes, so memory follows the
slice (or the longest single text), not the batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE = 1 << 19
#: What an entry of a dictionary of byte strings takes besides its bytes.
ENTRY_BYTES = 170

_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value per byte, and an odd base for the rolling hash.
BYTE_VALUE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

#: ASCII space and \t \n \v \f \r.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Letters, digits and every byte of a multi-byte character.
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Powers kept for good; longer runs are worked out anew.
KEPT_POWERS = SLICE + 1
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below ``n``."""

    def make(size: int, base: np.uint64) -> np.ndarray:
        steps = np.full(size, base, np.uint64)
        steps[:1] = 1
        return np.cumprod(steps)

    if n > KEPT_POWERS:
        return make(n, BASE), make(n, BASE_INVERSE)
    if not _powers:
        _powers.extend(make(KEPT_POWERS, base) for base in (BASE, BASE_INVERSE))
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit hash over the whole word."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE, owner: str | None = None
) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``limit`` bytes of text.

    What another operator than ``owner`` left in the worker's store is let go.
    """
    release(owner)
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths.astype(np.int64)) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


class Hasher:
    """Hashes of any ranges of one buffer of bytes, or of 64-bit hashes, from one running sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values = BYTE_VALUE[data] if data.dtype == np.uint8 else data
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all ranges of ``size``, in order."""
        n = max(0, len(self.sums) - size)
        return mix((self.sums[size : size + n] - self.sums[:n]) * self.down[:n] + np.uint64(size))


def runs(inside: np.ndarray, offsets: np.ndarray, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``inside`` that stay in a row (and in one ``kind``)."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if kind is not None:
        edge[1:n] |= kind[1:] != kind[:-1]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    return np.flatnonzero(inside & (edge[:-1] | ~before)), np.flatnonzero(inside & (edge[1:] | ~after)) + 1


def per_row(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the first run of each row, and the number of runs at the end."""
    return np.searchsorted(starts, offsets)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each run, from :func:`per_row`."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def with_columns(
    df: DataFrame, text: str, make, added: str, keep: list[str] | None = None, owner: str | None = None
) -> DataFrame:
    """``df`` with columns computed from its ``text`` column, without a shuffle.

    ``make(data, offsets)`` gets a slice's bytes and row offsets and returns one
    Arrow array per column of the DDL ``added``.  A column of ``df`` that has a
    new column's name gives way to it.  ``keep`` names the columns passed on.
    """
    new = StructType.fromDDL(added)
    clash = set(new.fieldNames())
    kept = [c for c in (df.columns if keep is None else keep) if c not in clash]
    source = df.select(*kept, F.col(text).alias("_text"))
    schema = StructType([source.schema[c] for c in kept] + list(new.fields))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", owner=owner):
            columns = make(*text_bytes(batch.column("_text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, *new.fieldNames()])

    return source.mapInArrow(work, schema)


def _store() -> dict:
    return sys.modules.setdefault("wardlight_worker_store", types.ModuleType("wardlight_worker_store")).__dict__.setdefault("held", {})


def per_worker(owner: str, make: Callable[[], object]) -> object:
    """``make()``, kept in this Python worker until another operator works in it.

    Spark gives a worker task after task; a cache of pure results held here
    serves all of them.  A worker holds one such value at a time, and what is
    held must be bounded in bytes.
    """
    held = _store()
    if owner not in held:
        release()
        held[owner] = make()
    return held[owner]


def release(owner: str | None = None) -> None:
    """Let go of what other operators than ``owner`` hold, and give the memory back."""
    held = _store()
    if not held or owner in held:
        return
    held.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries can be asked
        ctypes.CDLL(None).malloc_trim(0)
