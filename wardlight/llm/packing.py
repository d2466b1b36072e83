"""Vector bin packing of tokenised documents into training sequences.

A sequence is a bin with three limits: tokens, segments (pieces of documents)
and loss-bearing tokens.  Each task packs the documents it reads.  It keeps a
pool of documents; into the open sequence it puts the document whose demand has
the largest dot product with what is still free, among those that fit.  When
none fits, or a document is longer than any sequence, a document is cut so that
it fills the sequence, and its rest stays in the pool.

A sequence that cannot be filled (too many short pieces, or the end of a
task's documents) is closed at a power of two; what is beyond goes back to the
pool.  So no sequence needs padding.  There is no shuffle, and memory holds one
pool: at most ``pool`` documents, or about ``pool_tokens`` tokens, and one text.

Null and empty texts are the end token alone.  Repeated rows are packed as often
as they occur.  Sequence ids are unique over the whole result; they follow the
partitions of the input.  With a loss mask, a document's mask says which of its
tokens bear loss; without one all do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from wardlight.llm import textbytes as tb


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096
    pool: int = 512
    pool_tokens: int = 2_000_000


PIECE = (
    "start long, length long, ids binary, loss_tokens long, doc_tokens long, "
    "sequence_id long, offset long, sequence_tokens long"
)


@dataclass
class Item:
    key: object
    ids: np.ndarray
    loss: np.ndarray | None
    start: int = 0


def power_below(n: int) -> int:
    return 1 << (n.bit_length() - 1)


class Packer:
    """Packs one task's documents; ``add`` and ``finish`` give closed pieces."""

    def __init__(self, limits: Limits, first_sequence: int):
        if min(limits.tokens, limits.segments, limits.loss_tokens) < 1:
            raise ValueError("limits must be positive")
        self.limits, self.sequence = limits, first_sequence
        self.items: list[Item] = []
        self.held = 0
        self.demand = np.zeros((0, 3))

    def add(self, key, ids: np.ndarray, loss: np.ndarray | None = None) -> Iterator[tuple]:
        self._put(Item(key, ids, loss))
        while len(self.items) >= self.limits.pool or self.held > self.limits.pool_tokens:
            yield from self._fill()

    def finish(self) -> Iterator[tuple]:
        while self.items:
            yield from self._fill()

    def _sizes(self, item: Item) -> tuple[int, int, int]:
        length = len(item.ids) - item.start
        return length, 1, length if item.loss is None else int(item.loss[item.start :].sum())

    def _put(self, item: Item) -> None:
        self.items.append(item)
        self.demand = np.vstack([self.demand, self._sizes(item)])
        self.held += len(item.ids) - item.start

    def _take(self, at: int, length: int) -> tuple[Item, int, int]:
        """Cut ``length`` tokens off an item; the item leaves the pool when used up."""
        item, start = self.items[at], self.items[at].start
        item.start += length
        self.held -= length
        if item.start < len(item.ids):
            self.demand[at] = self._sizes(item)
        else:
            self.items[at] = self.items[-1]
            self.demand[at] = self.demand[-1]
            self.items.pop()
            self.demand = self.demand[:-1]
        return item, start, length

    def _room(self, item: Item, tokens: int, loss: int) -> int:
        """How many of an item's next tokens the free tokens and loss tokens allow."""
        length = min(tokens, len(item.ids) - item.start)
        if item.loss is None:
            return min(length, loss)
        return int(np.searchsorted(np.cumsum(item.loss[item.start : item.start + length]), loss, side="right"))

    def _fill(self) -> Iterator[tuple]:
        limits = self.limits
        size = limits.tokens if self.held >= limits.tokens else power_below(self.held)
        whole = np.array([size, limits.segments, limits.loss_tokens], float)
        free, pieces = whole.copy(), []
        while self.items and free[0] > 0 and free[1] > 0:
            fits = (self.demand <= free).all(axis=1)
            must_cut = (self.demand > whole).any(axis=1)
            gain = (np.minimum(self.demand, free) / whole) @ (free / whole)
            choice = fits | must_cut
            at = int(np.argmax(np.where(choice, gain, -1) if choice.any() else gain))
            length = self._room(self.items[at], int(free[0]), int(free[2]))
            if length == 0:
                others = [self._room(x, int(free[0]), int(free[2])) for x in self.items]
                at = int(np.argmax(others))
                length = others[at]
                if length == 0:
                    break
            piece = self._take(at, length)
            pieces.append(piece)
            item, start, _ = piece
            used = length if item.loss is None else int(item.loss[start : start + length].sum())
            free -= (length, 1, used)
        total = size - int(free[0])
        if total < limits.tokens:
            total = self._cut_back(pieces, total, power_below(total))
        offset = 0
        for item, start, length in pieces:
            ids = item.ids[start : start + length]
            loss = length if item.loss is None else int(item.loss[start : start + length].sum())
            yield item.key, start, length, ids.astype("<u4").tobytes(), loss, len(item.ids), self.sequence, offset, total
            offset += length
        self.sequence += 1

    def _cut_back(self, pieces: list, total: int, target: int) -> int:
        """Give tokens back from the end until ``target`` are left."""
        while total > target:
            item, start, length = pieces.pop()
            back = min(length, total - target)
            self._give_back(item, start + length - back)
            if back < length:
                pieces.append((item, start, length - back))
            total -= back
        return total

    def _give_back(self, item: Item, start: int) -> None:
        """The item's tokens from ``start`` on return; only its last piece can be given back."""
        for at, held in enumerate(self.items):
            if held is item:
                self.held += item.start - start
                item.start = start
                self.demand[at] = self._sizes(item)
                return
        item.start = start
        self._put(item)


def _pieces(packed: Iterator[tuple], key: pa.DataType, name: str) -> Iterator[pa.RecordBatch]:
    kinds = [key, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
    names = [name, *(f.split()[0] for f in PIECE.split(", "))]
    rows = list(packed)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _schema(df: DataFrame, key: str) -> StructType:
    return StructType([StructField(key, df.schema[key].dataType), *StructType.fromDDL(PIECE).fields])


#: Words whose normal form and pre-tokens are plain to see: Latin-1 letters, then ASCII signs.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """Latin-1 letters as the characters that byte-level models write for their two bytes.

    Bytes that print stand for themselves; the others take 256, 257, ... in turn.
    """
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    letter = {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(128, 256)}


class WordTokens(dict):
    """Ids of white-space-separated words by a ``tokenizers`` file, remembered by word.

    Such a tokenizer drops white space, so the ids of a text are those of its
    words in turn.  The remembered words are bounded in bytes.  Plain words go straight to the tokenizer's model, others
    through the whole tokenizer.
    """

    def __init__(self, definition: str, end_id: int, limit: int = 96 << 20):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(definition)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.end, self.limit, self.bytes = np.array([end_id], "<u4").tobytes(), limit, 0
        self.blank = bytes.maketrans(b"\t\n\r", b"   ")

    def __missing__(self, raw: bytes) -> bytes:
        word = raw.decode("utf-8", "replace")
        plain = PLAIN.fullmatch(word)
        if plain:
            parts = [plain[1].lower().translate(self.letters), plain[2]]
            ids = [token.id for part in parts if part for token in self.model.tokenize(part)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        found = np.array(ids, "<u4").tobytes()
        if len(raw) <= 256:
            self.bytes += len(raw) + len(found) + tb.ENTRY_BYTES
            if self.bytes > self.limit:
                self.clear()
                self.bytes = 0
            self[raw] = found
        return found

    def encode(self, text: bytes) -> np.ndarray:
        words = text.translate(self.blank).split(b" ")
        return np.frombuffer(b"".join(map(self.__getitem__, words)) + self.end, "<u4")


def pack_texts(docs: DataFrame, definition: str, end_id: int, limits: Limits = Limits(), key: str = "doc_id") -> DataFrame:
    """Tokenise and pack ``docs``; one row per piece.

    ``definition`` is the content of a ``tokenizers`` JSON file whose tokenizer
    drops white space.
    """
    name = sha256(f"{end_id} {definition}".encode()).hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tb.per_worker(name, lambda: WordTokens(definition, end_id))
        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        kind = None
        for batch in tb.slices(batches, "text", owner=name):
            kind = batch.column(key).type

            def packed(batch=batch):
                data, offsets = tb.text_bytes(batch.column("text"))
                for name, a, b in zip(batch.column(key).to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                    yield from packer.add(name, tokens.encode(data[a:b].tobytes()))

            yield from _pieces(packed(), kind, key)
        yield from _pieces(packer.finish(), kind, key)

    return docs.select(key, "text").mapInArrow(work, _schema(docs, key))


def pack_tokens(items: DataFrame, limits: Limits = Limits(), key: str = "doc_id") -> DataFrame:
    """Pack documents already tokenised: ``ids`` (little-endian 32-bit words) and,
    optionally, ``loss_mask`` (one byte per token, zero: no loss).  Null ids are
    no tokens and give no piece; a null mask means that all tokens bear loss."""
    masked = "loss_mask" in items.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        kind = None
        for batch in batches:
            kind = batch.column(key).type
            masks = batch.column("loss_mask").to_pylist() if masked else [None] * batch.num_rows

            def packed(batch=batch, masks=masks):
                for name, ids, mask in zip(batch.column(key).to_pylist(), batch.column("ids").to_pylist(), masks):
                    if ids:
                        yield from packer.add(name, np.frombuffer(ids, "<u4"), None if mask is None else np.frombuffer(mask, np.uint8) > 0)

            yield from _pieces(packed(), kind, key)
        yield from _pieces(packer.finish(), kind, key)

    return items.select(key, "ids", *(["loss_mask"] if masked else [])).mapInArrow(work, _schema(items, key))
