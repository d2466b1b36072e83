"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of shingles of ``words`` consecutive words (a shorter text is
one shingle).  1. Equal texts become one class.  2. MinHash bands bring classes
together in buckets.  3. Within a bucket the MinHash values of a pair are
compared in steps; the pair is dropped as soon as the posterior probability
that its similarity reaches the threshold falls below ``tolerance``.  4. The
surviving pairs' connected groups are verified exactly: intersections of whole
shingle sets are counted for every pair of a group, in blocks.

Buckets and groups of any size are cut into blocks, and only link counts and
spanning forests leave a task, so a group of thousands of near copies is never
written out as pairs.

Null texts count as empty; texts without words link with equal texts only.
Rows without an id belong to no class and have no links.  Rows that repeat an
id and its text are copies of each other; one id with several texts is in as
many classes, each with links of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm import blocks
from wardlight.llm import textbytes as tb
from wardlight.llm.components import components
from wardlight.llm.tables import sifted, written


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: float = 0.8
    hashes: int = 128
    band: int = 4  # MinHash values per band
    bands: int = 24
    step: int = 16  # values compared at a time
    tolerance: float = 1e-6
    bucket_block: int = 1024
    verify_block: int = 512


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and where each row's begin."""
    starts, ends = tb.runs(~tb.IS_SPACE[data], offsets)
    hashes = tb.Hasher(data).ranges(starts, ends)
    bounds = tb.per_row(starts, offsets)
    counts = np.diff(bounds)
    sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(sizes)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    first = bounds[:-1][row] + np.arange(out[-1]) - out[:-1][row]
    value = np.zeros(len(first), np.uint64)
    length = np.minimum(counts[row], words)
    for k in range(words):
        more = k < length
        value[more] = tb.mix(value[more] * tb.BASE + hashes[first[more] + k])
    return value, out


def signatures(value: np.ndarray, bounds: np.ndarray, s: Settings) -> np.ndarray:
    """(rows, hashes) MinHash values, sixteen bits each."""
    rng = np.random.default_rng(5)
    factor = rng.integers(0, 1 << 31, s.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.integers(0, 1 << 32, s.hashes, dtype=np.uint32)
    out = np.zeros((len(bounds) - 1, s.hashes), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        low = (value >> np.uint64(32)).astype(np.uint32)
        for at in range(0, s.hashes, 8):
            mixed = low[None, :] * factor[at : at + 8, None] + shift[at : at + 8, None]
            least = np.minimum.reduceat(mixed, bounds[:-1][full], axis=1)
            out[full, at : at + 8] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).T
    return out


def fewest_matches(s: Settings) -> np.ndarray:
    """After each step, the matches below which a pair is dropped.

    With a uniform prior, m matches of n leave the similarity a
    Beta(m + 1, n - m + 1) distribution.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    above = grid >= s.threshold
    out = []
    for n in range(s.step, s.hashes + 1, s.step):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(grid) + (n - m) * np.log1p(-grid)
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        chance = weight[:, above].sum(1) / weight.sum(1)
        out.append(int(np.argmax(chance >= s.tolerance)))
    return np.array(out)


def _prune(sig: np.ndarray, left: np.ndarray, right: np.ndarray, fewest: np.ndarray, step: int) -> np.ndarray:
    """Places of the pairs that stay possible through all steps."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int32)
    for k, need in enumerate(fewest):
        part = slice(k * step, (k + 1) * step)
        matches = matches + (sig[left[alive], part] == sig[right[alive], part]).sum(axis=1)
        stay = matches >= need
        alive, matches = alive[stay], matches[stay]
    return alive


def _spread(sig: np.ndarray, fewest: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the surviving pairs of one large bucket.

    Breadth first: a row is compared with rows not reached yet, so a bucket of
    near copies needs little more than one comparison per row.
    """
    waiting = np.arange(len(sig))
    left, right = [], []
    while len(waiting):
        queue, waiting = [waiting[0]], waiting[1:]
        while queue and len(waiting):
            row = queue.pop()
            reached = _prune(sig, np.full(len(waiting), row), waiting, fewest, step)
            left.append(np.full(len(reached), row))
            right.append(waiting[reached])
            queue.extend(waiting[reached])
            waiting = np.delete(waiting, reached)
    return np.concatenate([*left, np.zeros(0, int)]), np.concatenate([*right, np.zeros(0, int)])


def _candidates(s: Settings):
    fewest = fewest_matches(s)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.whole_units(batches):
            unit, side, ids, band = (table[c].to_numpy() for c in ("unit", "side", "id", "band"))
            sig = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(len(ids), -1)
            lanes = np.ascontiguousarray(sig[:, : s.band * s.bands]).reshape(len(ids), s.bands, s.band)
            bounds = blocks.unit_bounds(unit)
            a, b = blocks.small_pairs(unit, side, bounds)
            same = (lanes[a] == lanes[b]).all(axis=2)
            once = np.argmax(same, axis=1) == band[a]  # in the first band that they share
            a, b = a[once], b[once]
            alive = _prune(sig, a, b, fewest, s.step)
            lefts, rights = [a[alive]], [b[alive]]
            for low, high in blocks.large_units(bounds):
                i, j = _spread(sig[low:high], fewest, s.step)
                lefts.append(low + i)
                rights.append(low + j)
            yield pa.RecordBatch.from_arrays([pa.array(ids[np.concatenate(x)]) for x in (lefts, rights)], ["a", "b"])

    return work


def intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, exact."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    _, group, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = counts > 1
    place = np.cumsum(often) - 1
    shared = often[group]
    row, column = row[shared], place[group[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.int64)
    width = int(often.sum())
    for at in range(0, width, columns):
        a, b = np.searchsorted(column, [at, at + columns])
        part = np.zeros((n, min(columns, width - at)), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def _verify(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.whole_units(batches, 256):
            unit, side, ids, mult = (table[c].to_numpy() for c in ("unit", "side", "id", "mult"))
            sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
            bounds = blocks.unit_bounds(unit)
            nodes, roots, counts = [], [], []
            for low, high in zip(bounds[:-1], bounds[1:]):
                own, sides, names, copies = sets[low:high], side[low:high], ids[low:high], mult[low:high]
                both = intersections(own)
                sizes = np.array([len(x) for x in own])
                linked = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
                linked &= (sides[:, None] == blocks.ALONE) | (sides[:, None] != sides[None, :])
                np.fill_diagonal(linked, False)
                label = blocks.forest(len(own), *np.nonzero(np.triu(linked)))
                nodes.append(names)
                roots.append(names[label])
                counts.append(linked @ copies)
            if nodes:
                columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in (nodes, roots, counts)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "links"])

    return work


def near_duplicates(docs: DataFrame, key: str = "doc_id", s: Settings = Settings()) -> DataFrame:
    """(key, class_id, n_links, component_id, kept) for every row.

    ``class_id`` is the smallest id with an equal text, ``n_links`` the number of
    other documents that reach the threshold, ``component_id`` the smallest id
    reachable by links; the document with that id is ``kept``.  Rows without an
    id are kept.
    """
    texts = docs.select(F.col(key).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("same", F.md5("text"))

    def sign(data, offsets):
        value, bounds = shingles(data, offsets, s.words)
        sig = signatures(value, bounds, s)
        return [pa.array([x.tobytes() if n else None for x, n in zip(sig, np.diff(bounds))], pa.binary())]

    signed = written(tb.with_columns(texts, "text", sign, "signature binary", ["id", "same"]), "signatures")
    named = signed.where("id is not null")
    # Classes are numbered: their smallest ids may clash.
    numbered = named.groupBy("same").agg(F.min("id").alias("id"), F.count("*").alias("mult"))
    classes = written(numbered.withColumn("node", F.monotonically_increasing_id()), "classes")
    member = named.where("signature is not null").join(classes, ["id", "same"])
    own = member.select(F.col("node").alias("id"), "mult", "signature").dropDuplicates(["id"])

    lanes = [F.substring("signature", 1 + 2 * s.band * k, 2 * s.band) for k in range(s.bands)]
    keys = F.array(*[F.xxhash64(F.lit(k), lane) for k, lane in enumerate(lanes)])
    entries = own.select("id", F.posexplode(keys).alias("band", "key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = entries.join(buckets, "key").join(own.select("id", "signature"), "id")
    pairs = blocks.block_units(met, s.bucket_block).mapInArrow(_candidates(s), "a long, b long")
    groups = components(pairs)

    grouped = groups.withColumnRenamed("component", "key")
    chosen = written(grouped.join(classes, "node").select("id", "same", "mult", "node", "key"), "candidates")
    likely = sifted(texts, "id", chosen).where("_maybe").select("id", "same", "text")
    found_texts = likely.join(chosen, ["id", "same"]).dropDuplicates(["node"]).drop("id").withColumnRenamed("node", "id")

    def sets(data, offsets):
        value, bounds = shingles(data, offsets, s.words)
        return [pa.array([np.unique(value[a:b]).tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())]

    whole = written(tb.with_columns(found_texts, "text", sets, "shingles binary", ["id", "mult", "key"]), "shingles")
    weight = F.greatest(F.count("*"), F.ceil(F.sum(F.length("shingles")) / 16_384))
    sized = whole.join(whole.groupBy("key").agg(weight.cast("long").alias("n")), "key")
    checked = written(blocks.block_units(sized, s.verify_block).mapInArrow(_verify(s.threshold), "a long, b long, links long"), "links")

    counts = checked.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    final = written(components(checked.where("a <> b").select("a", "b")).join(classes.select("node", "id"), "node"), "members")
    lowest = written(final.groupBy("component").agg(F.min("id").alias("component_id")), "lowest")
    named_groups = final.join(lowest, "component").select("node", "component_id")
    per_class = classes.join(counts, "node", "left").join(named_groups, "node", "left").select(
        "same",
        F.col("id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
    rows = signed.select(F.col("id").alias(key), "same").withColumn("same", F.when(F.col(key).isNotNull(), F.col("same")))
    joined = rows.join(per_class, "same", "left")
    return joined.select(
        key,
        "class_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "component_id",
        F.coalesce(F.col("component_id") == F.col(key), F.lit(True)).alias("kept"),
    )
