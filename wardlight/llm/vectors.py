"""Near-duplicate vectors by a permutation index of nearest pivots.

Every vector is described by its ``nearest`` reference points (pivots) in order
of nearness.  The inverted lists are those of sets of ``shared`` pivots: a vector
is posted, with its ordered description, to the list of every such set that its
order puts near the front (ranks adding up to ``ranks`` at most).  Vectors that
meet in a list merge their descriptions: every pivot they share counts, and it
counts the more, the nearer it is to both (``nearest`` less the larger rank).
What stays below ``weight``, and so has too few shared pivots or too different an
order, is dropped; the rest is verified by cosine in double precision.

Pivots are a bounded sample of each vector length (out of at most about ``sample``
vectors, no two of them close); their number grows with the root of the number of
vectors, up to ``pivots``.  Every vector is indexed.  Equal vectors are one entry
with a multiplicity.  Long lists are compared in blocks; only link counts and a
spanning forest of each list leave a task.

Vectors that are null, zero, or hold null or non-finite components link with
nothing; so do rows without an id, which have no component either.  Vectors of
different lengths never link.  Rows that repeat an id and its vector count as
vectors of their own; ties in nearness go to the earlier pivot.  Very long vectors
are compared whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm import blocks
from wardlight.llm.components import components
from wardlight.llm.tables import written
from wardlight.operators.ordering import first_n, small_side


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.95
    pivots: int = 1024  # of one vector length, at most
    per_root: int = 4  # pivots for each unit of the root of the number of vectors
    sample: int = 4096
    nearest: int = 7
    shared: int = 3
    ranks: int = 12
    weight: int = 6
    apart: float = 0.6  # two pivots are less alike than this
    block: int = 768

    def sets(self, k: int) -> np.ndarray:
        """The sets of ranks of a description of ``k`` pivots that it is posted under, as flags."""
        chosen = [t for t in combinations(range(k), min(self.shared, k)) if sum(t) <= self.ranks]
        return np.array([[int(r in t) for t in chosen] for r in range(k)], np.int64)


#: A number for each pivot; those of a set add up to the number of its list, in any order.
NUMBERS = np.random.Generator(np.random.PCG64(20240611)).integers(1 << 40, 1 << 60, 1 << 13)
#: Bytes of pivots sent to the tasks at once.
PIVOT_BYTES = 64 << 20


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, vector as doubles, mult): distinct usable vectors."""
    whole = F.transform(column, lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).alias("id"), whole.alias("v")).where("id is not null and v is not null")
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    return rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("mult"))


def choose_pivots(rows: DataFrame, s: Settings) -> DataFrame:
    """(size, points): for each vector length, spread-out unit vectors from a bounded sample.

    The sample of a length is its first ``sample`` vectors by hash.  A bound on
    the hash, from the number of vectors, leaves little more than those to rank.
    """
    sized = rows.select("id", "v", F.size("v").alias("size"), F.xxhash64("id", F.lit("pivot")).alias("hash"))
    lengths = small_side(sized.groupBy("size").agg(F.count("*").alias("n"), F.min("hash").alias("lowest")))
    share = (s.sample + 8 * s.sample**0.5 + 32) / F.col("n")
    low = (F.col("hash").cast("double") / 2.0**64 + 0.5 <= share) | (F.col("hash") == F.col("lowest"))
    order = ["hash", "id", F.xxhash64("v")]
    ranked = first_n(sized.join(lengths, "size").where(low), ["size"], order, s.sample, spread_by=F.xxhash64("v"))

    def spread(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["hash", "id", "tie"])
        wanted = int(min(s.pivots, max(64, s.per_root * group["n"].iloc[0] ** 0.5)))
        unit = unit_rows(np.array(group["v"].tolist()))
        kept = np.zeros((wanted, unit.shape[1]))
        count = 0
        for row in unit:
            if count == wanted:
                break
            if not count or (kept[:count] @ row).max() < s.apart:
                kept[count] = row
                count += 1
        return pd.DataFrame({"size": [group["size"].iloc[0]], "points": [kept[:count].tobytes()]})

    chosen = ranked.select("size", "v", "hash", "id", "n", order[2].alias("tie")).groupBy("size").applyInPandas(spread, "size int, points binary")
    return written(chosen, "pivots")


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def describe(rows: DataFrame, pivots: DataFrame, s: Settings) -> DataFrame:
    """(id, mult, unit vector as bytes, pivots in order as bytes, lists as longs).

    Lengths go in lots, so that the pivots sent to the tasks at once are bounded.
    """
    sizes = {r["size"]: r["bytes"] for r in pivots.select("size", F.length("points").alias("bytes")).collect()}  # two numbers a length
    lots: list[list[int]] = [[]]
    for size in sorted(sizes):
        if lots[-1] and sum(sizes[k] for k in lots[-1]) + sizes[size] > PIVOT_BYTES:
            lots.append([])
        lots[-1].append(size)
    done = []
    for lot in lots:
        found = pivots.where(F.col("size").isin(lot)).collect() if lot else []
        points = {r["size"]: np.frombuffer(r["points"]).reshape(-1, r["size"]) for r in found}
        chosen = rows.where(F.size("v").isin(lot)) if len(lots) > 1 else rows
        done.append(chosen.select("id", "mult", "v").mapInArrow(_described(points, s), DESCRIBED))
    return reduce(DataFrame.unionByName, done)


DESCRIBED = "id long, mult long, unit_vector binary, near binary, lists array<long>"


def _described(points: dict[int, np.ndarray], s: Settings):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                sizes = np.array([len(x) for x in batch.column("v")])
                for size in np.unique(sizes):
                    part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                    x = unit_rows(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
                    k = min(s.nearest, len(points[size]))
                    near = np.argsort(-(x @ points[size].T), axis=1, kind="stable")[:, :k]
                    keys = NUMBERS[near] @ s.sets(k) + int(size)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("id"),
                            part.column("mult"),
                            pa.array([r.tobytes() for r in x], pa.binary()),
                            pa.array([r.tobytes() for r in near.astype(np.int16)], pa.binary()),
                            pa.array(keys.tolist(), pa.list_(pa.int64())),
                        ],
                        ["id", "mult", "unit_vector", "near", "lists"],
                    )

    return work


def shared_pivots(near: np.ndarray, left: np.ndarray, right: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of ordered descriptions: the weight of the shared pivots, and the rank in
    ``right`` of each pivot of ``left`` (a large number if it has none)."""
    k = near.shape[1]
    place = np.full((len(left), k), 1000, np.int16)
    a, b = near[left], near[right]
    for rank in range(k):
        place = np.where(a == b[:, rank : rank + 1], np.int16(rank), place)
    return np.maximum(s.nearest - np.maximum(place, np.arange(k, dtype=np.int16)), 0).sum(axis=1), place


def _compare(s: Settings):
    def found(x, near, mult, ids, key, left, right):
        """Link counts to add, and forest edges, of the pairs that reach the threshold."""
        weight, place = shared_pivots(near, left, right, s)
        keep = weight >= s.weight
        left, right, place = left[keep], right[keep], place[keep]
        keep = np.einsum("ij,ij->i", x[left], x[right]) >= s.threshold
        left, right, place = left[keep], right[keep], place[keep]
        label = blocks.forest(len(ids), left, right)
        tied = np.flatnonzero(label != np.arange(len(ids)))
        # Counted in one of their common lists only, the one with the least number.
        sets = s.sets(near.shape[1])
        common = place.astype(np.int64) @ sets <= s.ranks
        first = np.where(common, NUMBERS[near[left]] @ sets, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        once = first + x.shape[1] == key[left]
        left, right = left[once], right[once]
        links = np.bincount(left, mult[right], len(ids)) + np.bincount(right, mult[left], len(ids))
        return links, tied, label

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.whole_units(batches):
            unit, side = table["unit"].to_numpy(), table["side"].to_numpy()
            ids, mult, key = (table[c].to_numpy() for c in ("id", "mult", "key"))
            raw, near_raw = table["unit_vector"].to_pylist(), table["near"].to_pylist()
            total, nodes, roots = np.zeros(len(ids)), [], []
            sizes = np.array([len(r) for r in raw]) // 8
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)  # lists hold vectors of one length
                x = np.frombuffer(b"".join(raw[i] for i in at)).reshape(len(at), -1)
                near = np.frombuffer(b"".join(near_raw[i] for i in at), np.int16).reshape(len(at), -1)
                own = blocks.unit_bounds(unit[at])
                pairs = [blocks.small_pairs(unit[at], side[at], own)]
                for a, b in blocks.large_units(own):
                    alike = x[a:b] @ x[a:b].T >= s.threshold - 1e-9
                    lone = side[at][a:b]
                    alike &= (lone[:, None] == blocks.ALONE) | (lone[:, None] != lone[None, :])
                    i, j = np.nonzero(np.triu(alike, 1))
                    pairs.append((a + i, a + j))
                for left, right in pairs:
                    if not len(left):
                        continue
                    links, tied, label = found(x, near, mult[at], ids[at], key[at], left, right)
                    total[at] += links
                    nodes.append(ids[at][tied])
                    roots.append(ids[at][label[tied]])
            rows = np.flatnonzero(total)
            node = np.concatenate([ids[rows], *nodes])
            root = np.concatenate([ids[rows], *roots])
            count = np.concatenate([total[rows], np.zeros(len(node) - len(rows))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array(count)], ["a", "b", "links"])

    return work


def links(rows: DataFrame, s: Settings) -> DataFrame:
    """(a, b, links): a spanning forest of the links as edges, and link counts as loops."""
    described = written(describe(rows, choose_pivots(rows, s), s), "described")
    entries = described.select("id", F.explode("lists").alias("key"))
    lists = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = entries.join(lists, "key").join(described.drop("lists"), "id")
    found = blocks.block_units(met, s.block).mapInArrow(_compare(s), "a long, b long, links long")
    return written(found, "links")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", s: Settings = Settings()) -> DataFrame:
    """(key, n_links, component_id, kept) for every row."""
    entries = written(usable(vectors, key, column), "vectors")
    found = links(entries, s)
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    groups = components(found.where("a <> b").select("a", "b"))
    per_vector = entries.join(counts, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left").select(
        "v",
        (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    rows = vectors.select(F.col(key), F.transform(column, lambda x: x.cast("double")).alias("v"))
    joined = rows.join(per_vector, (rows["v"] == per_vector["v"]) & rows[key].isNotNull(), "left")
    component = F.coalesce("component_id", key)
    return joined.select(
        key,
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col(key)).alias("kept"),
    )
