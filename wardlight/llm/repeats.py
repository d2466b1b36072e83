"""Repeated byte strings by merging shard Burrows-Wheeler transforms.

Every byte that lies in a string of ``length`` bytes which also starts anywhere
else (in the same or another text, overlaps included) is marked.

1. *Anchors.*  Each window of ``length`` bytes names one of its ``gram``-byte
   substrings, by a rule that sees the window's content only: the smallest hash,
   the rightmost of equals.  Equal windows name equal anchors at equal places.
   The windows of a text that name the same anchor occurrence are neighbours;
   together they make up a segment of less than two windows.  Segments of equal
   content are one, with a multiplicity, and segments whose anchor is found only
   once cannot hold a repeat.
2. *Shards.*  Segments are dealt out by anchor.  A task cuts them into shards
   and builds each shard's transform over an alphabet of blocks of ``stride``
   bytes: a segment is ``stride`` strings, one for each residue of the position.
3. *Merge.*  The transforms are merged by refining an interleave of the shards:
   a pass deals the interleave out, stably, by the symbols that precede its
   suffixes, and so sorts it by one more symbol.  No suffix is sorted again.
   The pass after which two neighbours part gives their common prefix; after
   ``length / stride`` passes, intervals that have not parted are the repeated
   windows.
4. An anchor with more segments than one task should hold is dealt to several
   tasks; these also publish a fingerprint of each window they hold once, or of
   each repeated interval, and equal fingerprints of different tasks meet in a
   last step.

The same search runs on words (runs of other than ASCII white space): a text is then
the string of its words' 64-bit hashes, and lengths and places count words.  So white
space does not matter, and a passage is told by its words, however many bytes they have.

Symbols and fingerprints are 64-bit and 128-bit hashes of bytes.  Null texts
count as empty; texts shorter than ``length`` have no repeats; equal texts of at
least ``length`` bytes are repeats of each other as a whole.  Rows are told
apart by content, so repeated and missing ids do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardlight.llm import blocks
from wardlight.llm import textbytes as tb
from wardlight.llm.tables import sifted, tidy, written


@dataclass(frozen=True)
class Settings:
    length: int = 400
    stride: int = 100  # divides ``length``
    gram: int = 64  # bytes of an anchor
    per_task: int = 1_024  # segments of one anchor that one task holds
    slice_bytes: int = 1 << 18
    shard_bytes: int = 1 << 17
    merge_bytes: int = 1 << 19
    words: bool = False  # lengths and places count words, not bytes

    @property
    def kind(self) -> np.dtype:
        return np.dtype("<u8" if self.words else "u1")


def word_settings(length: int) -> Settings:
    """To search for repeated strings of ``length`` words."""
    stride = max(k for k in range(1, max(1, length // 3) + 1) if length % k == 0)
    return Settings(length=length, stride=stride, gram=min(8, length), shard_bytes=1 << 15, merge_bytes=1 << 17, words=True)


def places(data: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """What a slice is searched as: its bytes, or the hashes of its words; with the rows' offsets therein."""
    if not s.words:
        return data, offsets
    starts, ends = tb.runs(~tb.IS_SPACE[data], offsets)
    return tb.Hasher(data).ranges(starts, ends), tb.per_row(starts, offsets)


def strung(texts: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each followed by one place that stands for its end; and where each begins."""
    end = bytes(s.kind.itemsize)
    sizes = [len(t) // s.kind.itemsize + 1 for t in texts]
    return np.frombuffer(end.join(texts) + end, s.kind), np.concatenate([[0], np.cumsum(sizes)])


# -- anchors --------------------------------------------------------------------


#: Low bits of a window's key that hold the place; the high ones are the hash's.
PLACE_BITS = np.uint64((1 << 36) - 1)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes, the place of its smallest (by the first 28 bits), rightmost of equals."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    padded = -(-len(h) // width) * width
    key = np.full(padded, np.iinfo(np.uint64).max, np.uint64)
    key[: len(h)] = (h | PLACE_BITS) - np.arange(len(h), dtype=np.uint64)
    blocks = key.reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(down[:n], up[width - 1 : width - 1 + n])
    return (PLACE_BITS - (low & PLACE_BITS)).astype(np.int64)


@dataclass
class Segments:
    """Segments of a slice: row, byte range, anchor hash and content hash."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def find_segments(data: np.ndarray, offsets: np.ndarray, s: Settings) -> Segments:
    hasher = tb.Hasher(data)
    starts, ends, rows, anchors = [], [], [], []
    width = s.length - s.gram + 1
    grams = hasher.windows(s.gram)
    # One pass over the slice; windows that reach over a row's end are left out.
    place = window_minima(grams, width)
    if len(place):
        sizes = np.diff(offsets)
        row = np.repeat(np.arange(len(sizes)), sizes)[: len(place)]
        stop = np.repeat(offsets[1:], sizes)[: len(place)]
        window = np.flatnonzero(np.arange(s.length, s.length + len(place)) <= stop)
        place, row = place[window], row[window]
        first = np.ones(len(window), bool)
        first[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(first)
        last = np.append(first[1:], len(window)) - 1
        starts, ends = window[first], window[last] + s.length
        rows, anchors = row[first], grams[place[first]]
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    content = hasher.ranges(starts, ends)
    return Segments(np.asarray(rows, np.int64), starts, ends, np.asarray(anchors, np.uint64), content)


# -- transforms and their merge ---------------------------------------------------


@dataclass
class Transform:
    """A shard's suffixes in order: positions, and the symbols before them (0: none)."""

    position: np.ndarray
    before: np.ndarray


def stable_order(values: np.ndarray) -> np.ndarray:
    """Stable sorting order of unsigned 8-, 16- or 32-bit integers, by radix."""
    if values.itemsize <= 2:
        return np.argsort(values, kind="stable").astype(np.int32)
    order = np.argsort(values.astype(np.uint16), kind="stable").astype(np.int32)
    high = (values >> np.uint32(16)).astype(np.uint16)
    most = high.max(initial=0)
    if most < 256:
        high = high.astype(np.uint8)
    return order[np.argsort(high[order], kind="stable")] if most else order


def dense(symbol: np.ndarray) -> np.ndarray:
    """The symbols as small numbers in the same order, 0 for 0."""
    order = stable_order(symbol)
    sorted_ = symbol[order]
    new = np.zeros(len(symbol), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    new[:1] = sorted_[:1] != 0
    out = np.empty(len(symbol), np.uint32)
    out[order] = np.cumsum(new, dtype=np.uint32)
    return out


def build(symbol: np.ndarray, low: int, high: int, begins: np.ndarray, stride: int, length: int) -> Transform:
    """The transform of positions ``low`` .. ``high`` by prefix doubling.

    ``symbol`` is 0 where a string ends.  Strings end in their own order.  Suffixes
    are sorted by their first ``length`` bytes at least, which is as far as the
    merge looks; those that agree so far stay in any order.
    """
    n = high - low
    own = symbol[low:high]
    order = stable_order(own)
    new = np.ones(n, bool)
    new[1:] = own[order][1:] != own[order][:-1]
    new[: int((own == 0).sum())] = True
    rank = np.empty(n, np.uint32)
    rank[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    step = stride
    while step < length and not new.all():
        # In the order of what follows the first ``step`` bytes.  The last suffixes hold an end there, so their ranks are their own.
        order = np.concatenate([np.arange(max(0, n - step), n, dtype=np.int32), order[order >= step] - np.int32(step)])
        order = order[stable_order(rank[order])]
        a, b = rank[order], rank[np.minimum(order + step, n - 1)]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rank[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        step *= 2
    position = np.int32(low) + order
    return Transform(position, before_of(symbol, position, begins, stride))


def before_of(symbol: np.ndarray, position: np.ndarray, begins: np.ndarray, stride: int) -> np.ndarray:
    """Symbol that precedes each position in its string; 0 at a string's start."""
    earlier = position - stride
    out = symbol[np.maximum(earlier, 0)]
    out[earlier < begins[position]] = 0
    return out


def merge(shards: list[Transform], ends: list[int], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged order (positions) and, for each suffix, its common prefix with the one before.

    ``ends`` is, for each shard, the number of suffixes that are only a string's
    end; they come first in every order, shard by shard.  Common prefixes are
    counted in symbols, up to ``passes``.
    """
    numbers = np.arange(len(shards), dtype=np.uint8 if len(shards) <= 256 else np.uint16)
    interleave = np.repeat(numbers, [len(x.position) for x in shards])
    position = np.concatenate([x.position for x in shards])
    before = np.concatenate([x.before for x in shards])
    head = np.repeat(numbers, ends)
    n, m = len(position), len(head)
    common = np.full(n, passes, np.int16)
    block = np.zeros(n, np.int32)
    read = np.arange(n, dtype=np.int32)  # the shards' suffixes in the order of the interleave
    for step in range(passes):
        symbols = before[read]
        inner = np.flatnonzero(symbols)
        order = inner[stable_order(symbols[inner])]
        interleave = np.concatenate([head, interleave[order]])
        symbol, earlier = symbols[order], block[order]
        new = np.ones(n, bool)
        new[m + 1 :] = (symbol[1:] != symbol[:-1]) | (earlier[1:] != earlier[:-1])
        common[new & (common == passes)] = step
        block = np.cumsum(new, dtype=np.int32)
        read = np.empty(n, np.int32)
        read[stable_order(interleave)] = np.arange(n, dtype=np.int32)
    return position[read], common


def repeated_windows(texts: list[bytes], weights: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of distinct segments that occur twice or more, multiplicities counted.

    Returns flags by byte position (windows that repeat; windows that lead an
    interval of equal ones) and where each segment begins.  Each segment is
    followed by one byte that stands for its end.  Symbols are 32-bit hashes of
    blocks; an interval is parted, and where needed sorted, by a 64-bit hash of the
    window, so that windows whose symbols collide are told apart.
    """
    data, bounds = strung(texts, s)
    segment = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(bounds))
    stops, begins = (bounds[1:] - 1).astype(np.int32)[segment], bounds[:-1].astype(np.int32)[segment]
    at = np.arange(len(data), dtype=np.int32)
    hasher = tb.Hasher(data)
    full = np.flatnonzero(at + s.stride <= stops)
    symbol = np.zeros(len(data), np.uint32)
    symbol[full] = np.maximum(hasher.ranges(full, full + s.stride) >> np.uint64(32), np.uint64(1))
    symbol = dense(symbol)
    cuts = np.searchsorted(bounds, np.arange(s.shard_bytes, bounds[-1], s.shard_bytes))
    edges = np.unique(np.concatenate([[0], bounds[cuts], [bounds[-1]]]))
    shards = [build(symbol, a, b, begins, s.stride, s.length) for a, b in zip(edges, edges[1:])]
    ends = [int((symbol[a:b] == 0).sum()) for a, b in zip(edges, edges[1:])]
    passes = s.length // s.stride
    order, common = merge(shards, ends, passes)
    whole = (at + s.length <= stops)[order]
    order, lead = order[whole], (common < passes)[whole]
    repeated, leading = np.zeros(len(data), bool), np.zeros(len(data), bool)
    if len(order):
        prints = hasher.windows(s.length)[order]
        lead[0] = True
        if (~lead[1:] & (prints[1:] != prints[:-1])).any():  # symbols collide
            block = np.cumsum(lead)
            again = np.lexsort((prints, block))
            order, prints = order[again], prints[again]
            lead[1:] |= prints[1:] != prints[:-1]
        interval = np.cumsum(lead) - 1
        weight = np.bincount(interval, weights[segment[order]])
        repeated[order] = weight[interval] > 1
        leading[order] = lead
    return repeated, leading, bounds


# -- the job --------------------------------------------------------------------


def _pack(starts: np.ndarray, ends: np.ndarray) -> bytes:
    return np.column_stack([starts, ends]).astype("<i8").tobytes()


def _occurrences(s: Settings):
    """Segments of every text, equal ones of a text together: (same, anchor, content, starts)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "text", s.slice_bytes):
            data, offsets = places(*tb.text_bytes(batch.column("text")), s)
            found = find_segments(data, offsets, s)
            if not len(found.row):
                continue
            order = np.lexsort((found.start, found.content, found.anchor, found.row))
            row, anchor, content = found.row[order], found.anchor[order], found.content[order]
            start = (found.start - offsets[found.row])[order].astype("<i8")
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(row))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("same").take(pa.array(row[first])),
                    pa.array(anchor[first].view(np.int64)),
                    pa.array(content[first].view(np.int64)),
                    pa.array([start[a:b].tobytes() for a, b in zip(first, last)], pa.binary()),
                ],
                ["same", "anchor", "content", "starts"],
            )

    return work


def _cut_out(s: Settings):
    """The chosen segments of each text with their bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tb.release()
        for batch in batches:
            for packed, size, wanted in zip(batch.column("packed").to_pylist(), batch.column("size").to_pylist(), batch.column("wanted")):
                raw = pa.decompress(packed, size, "zstd", asbytes=True) if size else b""
                data, offsets = places(np.frombuffer(raw, np.uint8), np.array([0, size]), s)
                found = find_segments(data, offsets, s)
                table = pa.RecordBatch.from_struct_array(wanted.values)
                anchor, content = table.column("anchor").to_numpy(), table.column("content").to_numpy()
                key = {pair: i for i, pair in enumerate(zip(anchor.tolist(), content.tolist()))}
                rows, parts = [], []
                for a, c, low, high in zip(found.anchor.view(np.int64).tolist(), found.content.view(np.int64).tolist(), found.start.tolist(), found.end.tolist()):
                    at = key.pop((a, c), None)
                    if at is not None:
                        rows.append(at)
                        parts.append(data[low:high].tobytes())
                if rows:
                    kept = table.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [*(kept.column(c) for c in ("anchor", "content", "weight", "salts")), pa.array(parts, pa.binary())],
                        ["anchor", "content", "weight", "salts", "bytes"],
                    )

    return work


ENTRY = np.dtype([("print", "<u8", 2), ("segment", "<i4"), ("at", "<i4"), ("settled", "?")])


def _merged(s: Settings, buckets: int):
    """Runs of repeated window starts of each segment; windows of shared anchors as entries.

    Rows of bucket -1 hold the runs of one segment (anchor, content); rows of
    other buckets hold packed entries that meet in the last step.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tb.release()
        for table in blocks.whole_units(batches, max(1, s.merge_bytes // (2 * s.length))):
            anchor, content, weight, salts = (table[c].to_numpy() for c in ("anchor", "content", "weight", "salts"))
            texts = table["bytes"].to_pylist()
            repeated, leading, bounds = repeated_windows(texts, weight, s)
            yield from _runs(repeated, bounds, anchor, content)
            if (salts > 1).any():
                yield from _entries(texts, leading, repeated, bounds, anchor, content, salts > 1, s, buckets)

    return work


MERGED = "bucket int, anchor long, content long, runs binary, anchors binary, contents binary, entries binary"


def _merged_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in MERGED.split(", ")])


def _runs(flags, bounds, anchor, content) -> Iterator[pa.RecordBatch]:
    starts, ends = tb.runs(flags, bounds)
    of = np.searchsorted(bounds, starts, side="right") - 1
    cut = np.searchsorted(of, np.arange(len(anchor) + 1))
    rows = [
        (-1, int(anchor[k]), int(content[k]), _pack(starts[a:b] - bounds[k], ends[a:b] - bounds[k]), None, None, None)
        for k, (a, b) in enumerate(zip(cut, cut[1:]))
        if b > a
    ]
    if rows:
        yield _merged_batch(rows)


def _entries(texts, leading, repeated, bounds, anchor, content, hot, s: Settings, buckets: int) -> Iterator[pa.RecordBatch]:
    """One entry for each distinct window of the segments of shared anchors."""
    data, _ = strung(texts, s)
    segment = np.repeat(np.arange(len(texts)), np.diff(bounds))
    at = np.flatnonzero(leading & hot[segment])
    hasher = tb.Hasher(data)
    half = s.length // 2
    entry = np.zeros(len(at), ENTRY)
    entry["print"][:, 0] = hasher.ranges(at, at + s.length)
    entry["print"][:, 1] = hasher.ranges(at, at + half) ^ tb.mix(hasher.ranges(at + half, at + s.length))
    entry["segment"], entry["at"], entry["settled"] = segment[at], at - bounds[segment[at]], repeated[at]
    bucket = (entry["print"][:, 0] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = []
    for k, (a, b) in enumerate(zip(cut, cut[1:])):
        if b > a:
            part = entry[order[a:b]]
            used, part["segment"] = np.unique(part["segment"], return_inverse=True)
            rows.append((k, None, None, None, anchor[used].tobytes(), content[used].tobytes(), part.tobytes()))
    if rows:
        yield _merged_batch(rows)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of one bucket: equal prints of different tasks are repeats."""
    for table in blocks.whole_units(batches, 1):
        parts, anchors, contents, base = [], [], [], 0
        for a, c, raw in zip(table["anchors"].to_pylist(), table["contents"].to_pylist(), table["entries"].to_pylist()):
            part = np.frombuffer(raw, ENTRY).copy()
            part["segment"] += base
            parts.append(part)
            anchors.append(np.frombuffer(a, np.int64))
            contents.append(np.frombuffer(c, np.int64))
            base += len(anchors[-1])
        entry, anchor, content = np.concatenate(parts), np.concatenate(anchors), np.concatenate(contents)
        order = np.lexsort((entry["print"][:, 1], entry["print"][:, 0]))
        entry = entry[order]
        same = (entry["print"][1:] == entry["print"][:-1]).all(axis=1)
        again = np.zeros(len(entry), bool)
        again[1:] |= same
        again[:-1] |= same
        entry = entry[again & ~entry["settled"]]
        entry = entry[np.lexsort((entry["at"], entry["segment"]))]
        rows = []
        cut = np.searchsorted(entry["segment"], np.arange(len(anchor) + 1))
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            if b > a:
                at = entry["at"][a:b].astype(np.int64)
                rows.append((-1, int(anchor[k]), int(content[k]), _pack(at, at + 1), None, None, None))
        if rows:
            yield _merged_batch(rows)


def repeats(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(same, found) for each distinct text with repeats: where its segments lie, and their runs."""
    if s.length % s.stride or s.gram > s.length:
        raise ValueError("stride must divide length, and gram must not be longer")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("same", F.unhex(F.md5("text")))
    least = 2 * s.length - 1 if s.words else s.length
    long_enough = texts.where(F.octet_length("text") >= least)
    occurrences = long_enough.mapInArrow(_occurrences(s), "same binary, anchor long, content long, starts binary")
    # Copies of a text meet map-side; the rest is one row per text and segment.
    held = written(
        occurrences.groupBy("same", "anchor", "content").agg(F.first("starts").alias("starts"), F.count("*").alias("copies")), "segments"
    )
    times = F.sum(F.col("copies") * F.length("starts") / 8).cast("long")
    distinct = held.groupBy("anchor", "content").agg(times.alias("weight"), F.min("same").alias("same"))
    distinct = written(distinct, "distinct-segments")
    anchors = distinct.groupBy("anchor").agg(F.sum("weight").alias("all"), F.count("*").alias("n")).where("`all` > 1")
    salts = F.ceil(F.col("n") / s.per_task).cast("int").alias("salts")
    chosen = written(distinct.join(anchors, "anchor").select("same", "anchor", "content", "weight", salts), "chosen")
    hot = chosen.where("salts > 1").count()
    buckets = max(1, -(-hot * 2 * s.length * ENTRY.itemsize // (16 << 20)))

    def pack(data, offsets):
        raw = memoryview(data.tobytes())
        parts = [pa.compress(raw[a:b], "zstd", asbytes=True) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        return [pa.array(parts, pa.binary()), pa.array(np.diff(offsets))]

    wanted = chosen.groupBy("same").agg(F.collect_list(F.struct("anchor", "content", "weight", "salts")).alias("wanted"))
    likely = sifted(long_enough, "same", chosen.select("same").distinct()).where("_maybe").select("same", "text")
    packed = tb.with_columns(likely, "text", pack, "packed binary, size long", ["same"])
    sources = packed.groupBy("same").agg(F.first("packed").alias("packed"), F.first("size").alias("size")).join(wanted, "same")
    cut = sources.select("packed", "size", "wanted").mapInArrow(_cut_out(s), "anchor long, content long, weight long, salts int, bytes binary")
    unit = F.xxhash64("anchor", F.pmod(F.col("content"), F.col("salts")))
    dealt = cut.withColumn("unit", unit).repartition("unit").sortWithinPartitions("unit")
    merged = written(dealt.mapInArrow(_merged(s, buckets), MERGED), "merged")
    runs = merged.where("bucket < 0")
    if hot:
        met = merged.where("bucket >= 0").withColumn("unit", F.col("bucket").cast("long"))
        met = met.repartition("unit").sortWithinPartitions("unit")
        runs = runs.unionByName(met.mapInArrow(_meet, MERGED))
    lying = held.join(runs.select("anchor", "content", "runs"), ["anchor", "content"])
    return lying.groupBy("same").agg(F.collect_list(F.struct("starts", "runs")).alias("found"))


def remove_repeats(
    docs: DataFrame,
    s: Settings = Settings(),
    keep: list[str] | None = None,
    whole_characters: bool = False,
    passage_words: int | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``kept_bytes``, ``n_bytes``, ``n_removed``, ``n_spans``.

    With ``whole_characters`` a character goes as soon as one of its bytes does,
    so that what is kept stays valid UTF-8.  With ``passage_words`` every word goes,
    too, that lies in a string of so many words which also starts anywhere else,
    with the white space between such words; both are judged on the input.
    """
    added = "kept_bytes binary, n_bytes long, n_removed long, n_spans long"
    names = [c for c in (docs.columns if keep is None else keep) if c not in {f.split()[0] for f in added.split(", ")}]
    found = written(repeats(docs, s), "repeats")
    passages = word_settings(passage_words) if passage_words else None
    if passages:
        tidy(docs.sparkSession)
        of_words = written(repeats(docs, passages), "repeated-words").withColumnRenamed("found", "words")
        found = written(found.join(of_words, "same", "full"), "both-repeats")
    else:
        found = found.withColumn("words", F.lit(None).cast(found.schema["found"].dataType))
    rows = docs.select(*names, F.coalesce("text", F.lit("")).alias("_text")).withColumn("_same", F.unhex(F.md5("_text")))
    found = found.withColumnsRenamed({"same": "_same", "found": "_found", "words": "_words"})
    likely = sifted(rows, "_same", found, "_likely")
    # Only texts that may have repeats meet the table of repeats.
    met = likely.where("_likely").join(found, "_same", "left").select(*names, "_text", "_found", "_words")
    none = F.lit(None).cast(found.schema["_found"].dataType)
    clean = likely.where("not _likely").select(*names, "_text", none.alias("_found"), none.alias("_words"))
    joined = met.unionByName(clean)
    schema = StructType([docs.schema[c] for c in names] + list(StructType.fromDDL(added).fields))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "_text"):
            data, offsets = tb.text_bytes(batch.column("_text"))
            out = []
            for a, b, found, words in zip(offsets.tolist(), offsets[1:].tolist(), batch.column("_found").to_pylist(), batch.column("_words").to_pylist()):
                gone = covered(b - a, found or [], s.length)
                if words:
                    gone |= covered_by_words(data[a:b], words, passages.length)
                if whole_characters and gone.any():
                    character = np.cumsum((data[a:b] & 0xC0) != 0x80)
                    gone = (np.bincount(character, gone) > 0)[character]
                starts, _ = tb.runs(gone, np.array([0, b - a]))
                out.append((data[a:b][~gone].tobytes(), b - a, int(gone.sum()), len(starts)))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], schema.names)

    return joined.mapInArrow(work, schema)


def covered(size: int, found: list[dict], length: int) -> np.ndarray:
    """Flags of the bytes, or words, that repeated windows cover."""
    steps = np.zeros(size + 1, np.int64)
    for segment in found:
        starts = np.frombuffer(segment["starts"], "<i8")
        for low, high in np.frombuffer(segment["runs"], "<i8").reshape(-1, 2):
            np.add.at(steps, starts + low, 1)
            np.add.at(steps, starts + high - 1 + length, -1)
    return np.cumsum(steps[:-1]) > 0


def covered_by_words(data: np.ndarray, found: list[dict], length: int) -> np.ndarray:
    """Flags of a text's bytes from the first to the last word of each run of words that repeated windows cover."""
    starts, ends = tb.runs(~tb.IS_SPACE[data], np.array([0, len(data)]))
    lows, highs = tb.runs(covered(len(starts), found, length), np.array([0, len(starts)]))
    gone = np.zeros(len(data), bool)
    for low, high in zip(lows, highs):
        gone[starts[low] : ends[high - 1]] = True
    return gone
