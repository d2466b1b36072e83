"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list.  For every merge rank there is a bucket
of list positions whose pair has that rank; two levels of bitmaps over the
ranks give the lowest filled bucket by find-first-set.  A bucket gives its
leftmost position first; an entry whose pair has changed since is skipped.
Each merge touches two neighbouring pairs, so a pre-token of n bytes takes
about n log n steps, however long it is.

Pre-tokens repeat, so each Python worker keeps the ids of those it has seen, up
to a bound in bytes.  Null and empty texts give no ids; repeated rows give equal ids.
"""

from __future__ import annotations

import base64
from hashlib import sha256
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wardlight.llm import textbytes as tb

WORD_BITS = 8
WORD_MASK = (1 << WORD_BITS) - 1
CACHE_BYTES, CACHE_LENGTH = 128 << 20, 64


def read_ranks(path: str, limit: int = 64 << 20) -> dict[bytes, int]:
    """A rank file (base64 token, rank per line); refused beyond ``limit`` bytes.

    The vocabulary is sent to every worker, so its size is checked here.
    """
    with open(path, "rb") as file:
        raw = file.read(limit + 1)
    if len(raw) > limit:
        raise ValueError(f"{path} has more than {limit} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token.

    ``top`` has a bit for each word of ``words`` that is not zero, and a word has
    a bit for each rank whose bucket is filled; ``x & -x`` is the lowest set bit.
    """
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after = list(range(1, n + 1))  # start of the next part; n: none
    before = list(range(-1, n - 1))
    pair = [get(piece[at : at + 2], -1) for at in range(n - 1)]  # rank of the pair that starts here; -1: none
    pair.append(-1)
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}
    top = 0
    for at, rank in enumerate(pair):
        if rank >= 0:
            if rank in buckets:
                buckets[rank].append(at)  # ascending, so it is a heap
            else:
                buckets[rank] = [at]
                word = rank >> WORD_BITS
                words[word] = words.get(word, 0) | 1 << (rank & WORD_MASK)
                top |= 1 << word
    while top:
        word = (top & -top).bit_length() - 1
        bits = words[word]
        rank = word << WORD_BITS | (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        at = heappop(bucket)
        if not bucket:
            del buckets[rank]
            words[word] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
        if pair[at] != rank:
            continue  # stale
        second = after[at]
        pair[second] = -1
        after[at] = third = after[second]
        if third < n:
            before[third] = at
        earlier = before[at]
        for left in (earlier, at) if earlier >= 0 else (at,):
            right = after[left]
            rank = get(piece[left : after[right]], -1) if right < n else -1
            pair[left] = rank
            if rank >= 0:
                if rank in buckets:
                    heappush(buckets[rank], left)
                else:
                    buckets[rank] = [left]
                    word = rank >> WORD_BITS
                    words[word] = words.get(word, 0) | 1 << (rank & WORD_MASK)
                    top |= 1 << word
    ids, at = [], 0
    while at < n:
        end = after[at]
        ids.append(ranks[piece[at:end]])
        at = end
    return ids


class Encoder(dict):
    """Ids of pre-tokens as little-endian 32-bit words, remembered by pre-token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.bytes = ranks, 0
        self.tokens = token_list(ranks)
        self.split = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
        if len(piece) <= CACHE_LENGTH:
            self.bytes += len(piece) + len(ids) + tb.ENTRY_BYTES
            if self.bytes > CACHE_BYTES:
                self.clear()
                self.bytes = 0
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))


def decode(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def token_list(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def _texts(data: np.ndarray, offsets: np.ndarray):
    raw = data.tobytes()
    for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
        yield raw[a:b].decode("utf-8", "replace")


def _name(ranks: dict[bytes, int], pattern: str) -> str:
    """Tells vocabularies apart in a worker's store."""
    return sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``ids``: little-endian 32-bit words."""
    name = _name(ranks, pattern)

    def work(data, offsets):
        encoder = tb.per_worker(name, lambda: Encoder(ranks, pattern))
        return [pa.array([encoder.encode(text) for text in _texts(data, offsets)], pa.binary())]

    return tb.with_columns(docs, "text", work, "ids binary", keep, name)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` and the SHA-256 of the ids and of what they decode to."""
    name = _name(ranks, pattern)

    def work(data, offsets):
        encoder = tb.per_worker(name, lambda: Encoder(ranks, pattern))
        counts, of_ids, of_text = [], [], []
        for text in _texts(data, offsets):
            ids = encoder.encode(text)
            counts.append(len(ids) // 4)
            of_ids.append(sha256(ids).hexdigest())
            of_text.append(sha256(decode(ids, encoder.tokens)).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)]

    return tb.with_columns(docs, "text", work, "n_tokens long, ids_sha256 string, decoded_sha256 string", keep, name)
