"""Byte-level BPE encoding and decoding (operator 1).

Two tiers. A minimal perfect hash over the vocabulary resolves every pre-token that is itself a token, for a
whole batch in a few array operations; the slot it names is compared byte for byte, so an absent pre-token is
never mistaken. The distinct misses of a batch are merged by a heap of (rank, position) over the linked list of
their bytes. Both tiers are read-only tables of the vocabulary's size (about 50,000 entries), broadcast once.

Null texts encode as empty texts; repeated rows are encoded each; columns other than the two named are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import binary_array, row_chunks, spans, utf8
from .pretokens import cut_points, distinct_pieces, mixed, padded, piece_hash, piece_starts, same_pieces

#: Bytes of text that one round of array work covers, and misses that a Python worker remembers between rounds.
CHUNK_BYTES, MEMO = 2 << 20, 150_000


class PerfectHash:
    """Hash and displace: buckets of about four keys, each with the least displacement that lands all its keys on free slots."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        size = np.fromiter(map(len, keys), np.int64, n)
        self.pad = padded(np.frombuffer(b"".join(keys), np.uint8))
        self.start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
        self.size, self.n = size, n
        self.buckets = max(1, n // 4)
        h = piece_hash(self.pad, self.start, size)
        if len(np.unique(h)) != n:
            raise ValueError("keys are repeated")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        counts = np.diff(first)
        self.shift = np.zeros(self.buckets, np.int64)
        taken = np.zeros(n, bool)
        self.key = np.zeros(n, np.int32)
        for b in np.argsort(-counts, kind="stable"):
            own = order[first[b] : first[b + 1]]
            if len(own) < 2:
                break
            tried, step = 0, 64
            while True:
                d = np.arange(tried, tried + step)
                slots = self._slot(h[own][None, :], d[:, None])
                good = ~taken[slots].any(1)
                srt = np.sort(slots, axis=1)
                good &= (srt[:, 1:] != srt[:, :-1]).all(1)
                if good.any():
                    k = int(np.argmax(good))
                    self.shift[b] = d[k]
                    taken[slots[k]] = True
                    self.key[slots[k]] = own
                    break
                tried, step = tried + step, min(step * 2, 8192)
        free = iter(np.flatnonzero(~taken).tolist())
        for b in np.flatnonzero(counts == 1):  # a bucket of one key names its slot outright
            slot = next(free)
            self.shift[b] = -slot - 1
            self.key[slot] = order[first[b]]

    def _slot(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mixed(h + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def find(self, pad: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The key's number, or -1, of each piece."""
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(shift < 0, -shift - 1, self._slot(h, np.maximum(shift, 0)))
        key = self.key[slot].astype(np.int64)
        return np.where(same_pieces(pad, start, size, self.pad, self.start[key], self.size[key]), key, -1)


class Vocabulary:
    """Token bytes by rank, the perfect hash over them, and the ranks for the merges."""

    def __init__(self, tokens: list[bytes], ids: list[int]):
        self.hash = PerfectHash(tokens)
        self.ids = np.array(ids, np.uint32)
        self.tokens = tokens
        self.ranks: dict[bytes, int] = {}
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self):
        return {"hash": self.hash, "ids": self.ids, "tokens": self.tokens}

    def __setstate__(self, state):
        self.__dict__.update(state, ranks={}, memo={})

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """A rank file: a line has a token in base 64, a blank, and its rank."""
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        return cls([base64.b64decode(a) for a, _ in pairs], [int(b) for _, b in pairs])

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Lowest rank first, leftmost of equals, until no two neighbours form a token."""
        if not self.ranks:
            self.ranks = dict(zip(self.tokens, self.ids.tolist(), strict=True))
        get, n = self.ranks.get, len(piece)
        bits = (n + 1).bit_length()
        low = (1 << bits) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [((r << bits | i) << bits) | i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            end, i = top & low, (top >> bits) & low
            mid = after[i]
            if mid <= 0 or mid >= n or after[mid] != end:
                continue
            after[i], after[mid] = end, -1
            if end < n:
                before[end] = i
                if (r := get(piece[i : after[end]])) is not None:
                    heappush(heap, ((r << bits | i) << bits) | after[end])
            if (p := before[i]) >= 0 and (r := get(piece[p:end])) is not None:
                heappush(heap, ((r << bits | p) << bits) | end)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, pad: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text) of the texts between ``offs``."""
        start = piece_starts(pad, offs)
        size = np.diff(np.append(start, offs[-1]))
        h = piece_hash(pad, start, size)
        key = self.hash.find(pad, start, size, h)
        miss = np.flatnonzero(key < 0)
        count = np.ones(len(start), np.int64)
        place = np.where(key >= 0, key, 0)
        pool = self.ids
        if len(miss):
            index, kind = distinct_pieces(pad, start[miss], size[miss], h[miss])
            raw, at = pad.tobytes(), miss[index]
            got, memo = [], self.memo
            for a, z in zip(start[at].tolist(), size[at].tolist(), strict=True):
                piece = raw[a : a + z]
                if (ids := memo.get(piece)) is None:
                    ids = self.merged(piece)
                    if len(piece) <= 64:
                        if len(memo) >= MEMO:
                            memo.clear()
                        memo[piece] = ids
                got.append(ids)
            each = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((x for ids in got for x in ids), np.uint32, int(each.sum()))
            count[miss] = each[kind]
            place[miss] = (len(pool) + np.cumsum(each) - each)[kind]
            pool = np.concatenate((pool, flat))
        ids = pool[spans(place, count)]
        ends = np.concatenate(([0], np.cumsum(count)))
        return ids, np.diff(ends[np.searchsorted(start, offs)])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts whose ids are given one after another, ``counts`` of them each."""
        by_id = np.full(int(self.ids.max()) + 1, -1, np.int64)
        by_id[self.ids] = np.arange(len(self.ids))
        if len(ids) and int(ids.max()) >= len(by_id):
            raise ValueError("an id is not in the vocabulary")
        key = by_id[ids]
        if (key < 0).any():
            raise ValueError("an id is not in the vocabulary")
        size = self.hash.size[key]
        data = self.hash.pad[spans(self.hash.start[key], size)]
        ends = np.concatenate(([0], np.cumsum(size)))
        return data, ends[np.concatenate(([0], np.cumsum(counts)))]


def encode_chunks(raw: np.ndarray, offs: np.ndarray, encode, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [a, b), their ids, and how many each has, in pieces of bounded size; texts beyond the limit are cut between pre-tokens."""
    for a, b in row_chunks(offs, limit):
        pad = padded(raw[offs[a] : offs[b]])
        own = offs[a : b + 1] - offs[a]
        if b - a > 1 or own[-1] <= 2 * limit:
            yield a, b, *encode(pad, own)
            continue
        cuts = [0, *cut_points(pad, 0, int(own[-1]), limit), int(own[-1])]
        parts = [encode(padded(pad[x:y]), np.array([0, y - x], np.int64))[0] for x, y in zip(cuts, cuts[1:], strict=False)]
        ids = np.concatenate(parts)
        yield a, b, ids, np.array([len(ids)], np.int64)


def encode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids``: the text's token ids as little-endian unsigned 32-bit integers, in one binary value.

    Null and empty texts have no ids. One pass without a shuffle; a task holds a few MB of text at a time.
    """
    table = df.sparkSession.sparkContext.broadcast(vocabulary)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column(1))
            for a, b, ids, counts in encode_chunks(raw, offs, table.value.encode):
                ends = np.concatenate(([0], np.cumsum(counts))) * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), binary_array(ids.astype("<u4").view(np.uint8), ends)], [id_col, "ids"]
                )

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def decode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``ids_col`` and ``decoded``: the bytes that the ids of ``encode`` stand for. Null ids decode to no bytes."""
    table = df.sparkSession.sparkContext.broadcast(vocabulary)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column(1))
            for a, b in row_chunks(offs, CHUNK_BYTES):
                own = offs[a : b + 1] - offs[a]
                ids = np.frombuffer(raw[offs[a] : offs[b]].tobytes(), "<u4")
                data, ends = table.value.decode(ids, np.diff(own) // 4)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a).cast(pa.binary()), binary_array(data, ends)],
                    [id_col, ids_col, "decoded"]
                )

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` binary, decoded binary")


def _runs(texts: pa.Array) -> np.ndarray:
    """Places where a text differs from the one before it."""
    kind = np.asarray(texts.dictionary_encode().indices.fill_null(-1))
    return np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1]))) if len(kind) else np.zeros(0, np.int64)


def coded_and_back(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` and ``decoded``: ``decode`` of ``encode`` in one pass, so that a task needs one Python worker, not two.

    Equal texts in rows that follow each other, as a mix with repeats has them, are worked on once.
    """
    table = df.sparkSession.sparkContext.broadcast(vocabulary)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = _runs(batch.column(1))
            run_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, batch.num_rows)))
            first = np.append(first, batch.num_rows)
            raw, offs = utf8(batch.column(1).take(pa.array(first[:-1])))
            for a, b, ids, counts in encode_chunks(raw, offs, table.value.encode):
                data, ends = table.value.decode(ids, counts)
                places = np.concatenate(([0], np.cumsum(counts))) * 4
                lo, hi = int(first[a]), int(first[b])
                coded, back = binary_array(ids.astype("<u4").view(np.uint8), places), binary_array(data, ends)
                if hi - lo > b - a:
                    times = pa.array(run_of[lo:hi] - a)
                    coded, back = coded.take(times), back.take(times)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), coded, back], [id_col, "ids", "decoded"])
            pa.default_memory_pool().release_unused()

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")


@lru_cache(maxsize=4)
def _read(path: str, changed: int) -> Vocabulary:
    return Vocabulary.read(path)


def vocabulary_at(path: str) -> Vocabulary:
    """The vocabulary of a rank file, built once a driver while the file stays as it is."""
    return _read(path, os.stat(path).st_mtime_ns)


def round_trip(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode, decode, and tell both in digests: id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ``ids`` (as ``encode`` gives them)."""
    return coded_and_back(df, vocabulary_at(vocabulary_path), id_col, text_col).select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(["ids"] if with_ids else []),
    )
