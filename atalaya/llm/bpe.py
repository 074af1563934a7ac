"""Byte-level BPE by rank: encoding and decoding of whole texts with numpy matrices.

A text is cut by the pattern, distinct pieces of a batch are encoded together, and the ids of a
text are gathered from its pieces. Pieces of similar length form a padded matrix of token ids,
one piece a row. In each round every row looks up its adjacent pairs in a hash table, merges its
leftmost pair of least rank and closes the gap; rows without a pair left drop out.

Defined results: a null text is an empty one, and an empty text has no ids; rows that repeat are
encoded each on its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from atalaya.llm.frames import chunks, documents, small_batches
from atalaya.llm.tokens import Pieces, gather

#: Longer pieces are merged with a heap, in the same order of merges: a matrix round costs a row's length.
LONG_PIECE = 256
#: Pieces kept by one Python worker; beyond that the cache starts anew. Bounds memory only.
CACHE_PIECES = 600_000
#: Cells of one padded matrix.
MATRIX_CELLS = 1 << 21
_NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of the joined token."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # whoever wrote a free slot last keeps it; the others go on to the next slot
            at = slots[left]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            own = self.keys[at] == keys[left]
            self.values[at[own]] = values[left[own]]
            left = left[~own]
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Joined ids, or a number above all ids."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], _NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class PairMerger:
    """Merges of adjacent ids: always the leftmost pair of least rank of a piece.

    `pairs` gives the rank of a pair, `joined` the id that a rank's pair becomes.
    """

    def __init__(self, pairs: dict[tuple[int, int], int], joined: np.ndarray):
        self.pairs, self.joined, self.table = pairs, joined, PairTable(pairs)

    def _merge_matrix(self, rows: np.ndarray, lengths: np.ndarray) -> None:
        """Merges in place; `rows` is padded on the right, `lengths` are cut as ids join."""
        active = np.flatnonzero(lengths > 1)
        work, size = rows[active], lengths[active]
        joined = np.full((len(work), work.shape[1] - 1), _NONE, np.int32)
        valid = np.arange(1, work.shape[1]) < size[:, None]
        joined[valid] = self.table.find(work[:, :-1][valid], work[:, 1:][valid])
        while len(active):
            at = joined.argmin(axis=1)
            each = np.arange(len(work))
            best = joined[each, at]
            done = best == _NONE
            if done.any():
                rows[active[done]], lengths[active[done]] = work[done], size[done]
                keep = ~done
                active, work, size, joined, at, best = (x[keep] for x in (active, work, size, joined, at, best))
                if not len(active):
                    return
                each = np.arange(len(work))
            # Close the gap behind the merged pair, in ids and in the joins known so far.
            columns = np.arange(work.shape[1] - 1)
            moved = columns[None, :] > at[:, None]
            work[:, :-1] = np.where(moved, work[:, 1:], work[:, :-1])
            best = self.joined[best]
            work[each, at] = best
            size -= 1
            joined[:, :-1] = np.where(moved[:, :-1], joined[:, 1:], joined[:, :-1])
            joined[:, -1] = _NONE
            # Only the two pairs around the new id change.
            joined[each, at] = _NONE
            right = np.flatnonzero(at + 1 < size)
            joined[right, at[right]] = self.table.find(best[right], work[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            joined[left, at[left] - 1] = self.table.find(work[left, at[left] - 1], best[left])
            widest = max(2, int(size.max()))
            if widest < work.shape[1]:
                rows_wide = rows.shape[1]
                work, joined = work[:, :widest], joined[:, : widest - 1]
                if widest < rows_wide // 2:
                    work, joined = work.copy(), joined.copy()
                rows = rows[:, :widest]

    def _merge_long(self, ids: list[int]) -> list[int]:
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= len(ids) or ids[j] != right:
                continue
            ids[i], ids[j] = self.joined[rank], -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(ids) and (r := self.pairs.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [x for x in ids if x >= 0]

    def merge(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged pieces, concatenated in order, and their lengths. The pieces come concatenated too."""
        starts = np.cumsum(lengths) - lengths
        parts = []
        for i in np.flatnonzero(lengths > LONG_PIECE).tolist():
            merged = self._merge_long(ids[starts[i] : starts[i] + lengths[i]].tolist())
            parts.append(([i], [len(merged)], merged))
        # A bucket holds lengths from one power of two to the next.
        bucket = np.where(lengths > LONG_PIECE, -1, np.frexp(lengths)[1])
        for which in np.unique(bucket[bucket >= 0]).tolist():
            members = np.flatnonzero(bucket == which)
            width = max(1, int(lengths[members].max()))
            step = max(1, MATRIX_CELLS // width)
            for low in range(0, len(members), step):
                part = members[low : low + step]
                size = lengths[part]
                rows = np.zeros((len(part), width), np.int32)
                rows[np.arange(width) < size[:, None]] = gather(ids, starts[part], size)
                self._merge_matrix(rows, size)
                parts.append((part, size, rows[np.arange(width) < size[:, None]]))
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        which, sizes, flat = (np.concatenate([np.asarray(p[k], np.int64) for p in parts]) for k in range(3))
        order = np.argsort(which)
        return gather(flat, (np.cumsum(sizes) - sizes)[order], sizes[order]).astype(np.uint32), sizes[order]


class RankCodec:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, file: str, pattern: str):
        import regex

        with open(file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.cut = regex.compile(pattern).findall
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left, right] = rank
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        by_id = sorted((rank, token) for token, rank in self.ranks.items())
        size = by_id[-1][0] + 1
        self.merger = PairMerger(pairs, np.arange(size, dtype=np.int32))
        self.token_length = np.zeros(size, np.int64)
        self.token_length[[r for r, _ in by_id]] = [len(t) for _, t in by_id]
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.index, self.pieces = {}, Pieces(np.uint32)

    def encode_pieces(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, concatenated in order, and how many each has."""
        # A piece that is a token as a whole needs no merges.
        whole = np.fromiter((self.ranks.get(p, -1) for p in data), np.int64, len(data))
        flat = self.single[np.frombuffer(b"".join(data), np.uint8)]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        starts = np.cumsum(lengths) - lengths
        known = whole >= 0
        starts[known], lengths[known] = np.arange(len(flat), len(flat) + known.sum()), 1
        return self.merger.merge(gather(np.append(flat, whole[known].astype(np.int32)), starts, lengths), lengths)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.cut(t) for t in texts]
        if len(self.index) > CACHE_PIECES:
            self.clear()
        index = self.index
        new = list(set().union(*cut) - index.keys())
        if new:
            base = len(index)
            index.update(zip(new, range(base, base + len(new)), strict=True))
            self.pieces.extend(*self.encode_pieces([p.encode() for p in new]))
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        order = np.fromiter(map(index.__getitem__, itertools.chain.from_iterable(cut)), np.int64, int(counts.sum()))
        ids, lengths = self.pieces.of(order)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        borders = np.concatenate([[0], np.cumsum(counts)])
        return np.split(ids, sums[borders[1:-1]]) if texts else []

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.token_bytes, self.token_start[ids], self.token_length[ids]).tobytes()


@lru_cache(maxsize=1)
def codec(file: str, pattern: str) -> RankCodec:
    """One table and cache per Python worker."""
    return RankCodec(file, pattern)


def encode_documents(docs: DataFrame, file: str, pattern: str) -> DataFrame:
    """doc_id and its ids as little-endian unsigned 32-bit numbers, with their count."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(file, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [x.astype("<u4") for low, high in chunks(texts) for x in tool.encode(texts[low:high])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["doc_id", "n_tokens", "ids"],
            )

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, file: str, pattern: str) -> DataFrame:
    """The bytes that the ids of `encode_documents` stand for, beside the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(file, pattern)
        for batch in batches:
            data = [tool.decode(np.frombuffer(x, "<u4")) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


