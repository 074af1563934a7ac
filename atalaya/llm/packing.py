"""Packing of token sequences: best-fit decreasing with whole id matrices, and first-fit decreasing.

Both cut a long document into full sequences and a rest, lose no id, and pack in random groups:
a piece goes to a group by a hash of the id, its place, its ids and how many equal pieces its task has had
before, so neither repeated nor null ids, long documents nor repeated rows crowd one group.

Defined results: a null text is an empty one and still carries its end id; rows that repeat are
packed each on its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya.llm.frames import documents, gathered, ranges_of, small_batches, tidy
from atalaya.llm.tokens import gather, word_ids

CAPACITY = 2048
END_ID = 1
#: Documents' worth of pieces per random group, on average. A group's ids are held by one task at a time.
GROUP_DOCS = 512
#: The same where only lengths travel.
GROUP_PIECE_DOCS = 2048
#: Bytes of text that a task encodes at once. The more, the fewer times a word is looked up.
WINDOW_BYTES = 4_000_000
#: Equal pieces are told apart by their number within a task. The tasks share these numbers in runs of so many, so
#: one number of one piece comes up at most so often.
SHARING_TASKS = 1024


# --- packing of lengths ---------------------------------------------------------------


class CapacityTree:
    """Segment tree over capacities 0..size: how many open bins have each one.

    `best(n)` finds the smallest capacity of at least n that some bin has.
    """

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.tree[node] += by
            node >>= 1

    def best(self, least: int) -> int:
        """-1 if no bin has room."""
        node = least + self.leaves
        if self.tree[node]:
            return least
        while node > 1:
            if not node & 1 and self.tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each length. Among equal lengths the first comes first, among equal bins the latest."""
    tree, bins, taken, out = CapacityTree(capacity), {}, 0, [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = tree.best(lengths[i])
        if room < 0:
            room, which = capacity, taken
            taken += 1
        else:
            tree.add(room, -1)
            which = bins[room].pop()
        out[i] = which
        tree.add(room - lengths[i], 1)
        bins.setdefault(room - lengths[i], []).append(which)
    return out


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each length: the first bin with room, found in a tournament tree of capacities.

    Each node holds the larger capacity of its two children, so the leftmost leaf with room is
    reached by going left whenever the left winner has room.
    """
    leaves = 1 << max(1, len(lengths)).bit_length()
    tree, out = [capacity] * (2 * leaves), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        node = 1
        while node < leaves:
            node = 2 * node if tree[2 * node] >= lengths[i] else 2 * node + 1
        out[i] = node - leaves
        tree[node] -= lengths[i]
        while node > 1:
            node >>= 1
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return out


def offsets_in(bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where each piece starts in its bin, in the order of the pieces."""
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]]) if len(bins) else np.empty(0, bool)
    start = before[first][np.cumsum(first) - 1] if len(bins) else before
    out = np.empty(len(bins), np.int64)
    out[order] = before - start
    return out


# --- pieces and groups ----------------------------------------------------------------

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, file: str, *, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids of each document, with their checksum.

    `salt` numbers equal pieces of one task. It follows from what the task reads, in any order, so a task that
    runs again gives the same rows. `with_ids` adds the ids, in 16 bits if the vocabulary allows it, else in 32.
    """
    small_batches(docs.sparkSession)
    schema = f"{PIECES}, salt long" + (", ids binary" if with_ids else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = word_ids(file), Counter()
        narrow = "<u2" if max(end_id, encoder.tokenizer.get_vocab_size()) < 1 << 16 else "<u4"
        sharing = TaskContext.get().partitionId() // SHARING_TASKS
        for batch in gathered(batches, WINDOW_BYTES):
            for low, high in ranges_of(pc.binary_length(batch.column(1)).to_pylist(), WINDOW_BYTES):
                ids, counts = encoder.encode_column(batch.column(1).slice(low, high - low))
                tokens = counts + 1
                ends = np.cumsum(tokens)
                flat, inside = np.full(int(ends[-1]), end_id, "<u4"), np.ones(int(ends[-1]), bool)
                inside[ends - 1] = False
                flat[inside] = ids
                # All pieces of all documents, in order: they lie end to end in `flat`.
                pieces = -(-tokens // capacity)
                owner = np.repeat(np.arange(len(tokens)), pieces)
                start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, tokens[owner] - start)
                borders = np.concatenate([[0], np.cumsum(length)])
                data = memoryview(flat).cast("B")
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(borders.tolist(), borders[1:].tolist(), strict=False)]
                doc_id = batch.column(0).slice(low, high - low).take(pa.array(owner))
                salt = []
                for piece in zip(doc_id.to_pylist(), start.tolist(), crcs, tokens[owner].tolist(), strict=True):
                    salt.append(sharing << 40 | seen[piece])
                    seen[piece] += 1
                columns = [doc_id, *(pa.array(c, pa.int64()) for c in (start, length, crcs, tokens[owner], salt))]
                if with_ids:
                    wide = np.dtype(narrow).itemsize
                    buffers = [None, pa.py_buffer((borders * wide).astype(np.int32)), pa.py_buffer(flat.astype(narrow))]
                    columns.append(pa.Array.from_buffers(pa.binary(), len(owner), buffers))
                yield pa.RecordBatch.from_arrays(columns, names)

    return documents(docs).mapInArrow(tidy(run), schema)


def _groups(pieces: DataFrame, docs: DataFrame, per_group: int, seed: int) -> DataFrame:
    """Random group of each piece."""
    groups = max(1, -(-docs.count() // per_group))
    mixed = F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "doc_tokens", "salt")
    return pieces.withColumn("_group", F.pmod(mixed, F.lit(groups)).cast("long"))


def _in_order(part: pa.Table, keys: list[tuple[str, str]]) -> pa.Table:
    return part.sort_by([*keys, *((k, "ascending") for k in ("doc_id", "start", "ids_crc32", "doc_tokens"))]).combine_chunks()


# --- op 2: first-fit decreasing -------------------------------------------------------


def pack_first_fit(pieces: DataFrame, docs: DataFrame, *, capacity: int = CAPACITY, seed: int = 2) -> DataFrame:
    """Adds `sequence_id` and `offset` to pieces; each random group is packed on its own."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        part = _in_order(part, [("length", "descending")])
        lengths = part["length"].to_numpy()
        bins = np.array(first_fit_decreasing(lengths.tolist(), capacity), np.int64)
        part = part.drop_columns(["_group", "salt"])
        part = part.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins))
        return part.append_column("offset", pa.array(offsets_in(bins, lengths)))

    grouped = _groups(pieces, docs, GROUP_PIECE_DOCS, seed).groupBy("_group")
    return grouped.applyInArrow(run, f"{PIECES}, sequence_id long, offset long")


def ffd_pack(docs: DataFrame, file: str, *, capacity: int = CAPACITY, end_id: int = END_ID, seed: int = 2) -> DataFrame:
    """First-fit-decreasing packing of whole documents; one row per piece."""
    return pack_first_fit(token_pieces(docs, file, capacity=capacity, end_id=end_id), docs, capacity=capacity, seed=seed)


# --- op 1: best-fit decreasing, with the matrices -------------------------------------

MATRIX = (
    "sequence_id long, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, "
    "input_ids binary, position_ids binary"
)


def pack_matrices(
    docs: DataFrame,
    file: str,
    *,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    pad_id: int = 0,
    group_docs: int = GROUP_DOCS,
    seed: int = 1,
) -> DataFrame:
    """Packed rows of `capacity` ids, one per sequence.

    `input_ids` are little-endian unsigned 32-bit ids, padded with `pad_id`. `cu_seqlens` are the
    cumulative lengths of the segments, from 0 to `n_tokens`. `position_ids` (same layout) restart
    at 0 with each segment and are 0 on padding. `doc_ids` and `starts` name each segment's
    document and its first id there, so the documents can be put together again.
    """

    def run(key: tuple, part: pa.Table) -> pa.Table:
        part = _in_order(part, [])
        lengths = part["length"].to_numpy()
        bins = np.array(best_fit_decreasing(lengths.tolist(), capacity), np.int64)
        places = offsets_in(bins, lengths)
        data = b"".join(part["ids"].to_pylist())
        flat = np.frombuffer(data, f"<u{len(data) // int(lengths.sum())}")
        # Every id and its position go to their cell by one scatter.
        inside = gather(np.arange(capacity), np.zeros(len(lengths), np.int64), lengths)
        cells = np.repeat(bins * capacity + places, lengths) + inside
        input_ids, positions = np.full((int(bins.max()) + 1, capacity), pad_id, "<u4"), np.zeros((int(bins.max()) + 1, capacity), "<u4")
        input_ids.reshape(-1)[cells], positions.reshape(-1)[cells] = flat, inside
        # The segments of each sequence, in order of their places.
        order = np.lexsort([places, bins])
        members = np.bincount(bins)
        borders = pa.array(np.concatenate([[0], np.cumsum(members)]), pa.int32())
        used = np.bincount(bins, lengths).astype(np.int64)
        cuts = np.insert(places[order], np.cumsum(members), used)
        lists = pa.ListArray.from_arrays
        return pa.table([
            pa.array((key[0].as_py() << 32) + np.arange(len(members))),
            pa.array(used, pa.int32()),
            lists(borders, part["doc_id"].combine_chunks().take(pa.array(order))),
            lists(borders, pa.array(part["start"].to_numpy()[order])),
            lists(pa.array(np.concatenate([[0], np.cumsum(members + 1)]), pa.int32()), pa.array(cuts, pa.int32())),
            pa.array([row.tobytes() for row in input_ids], pa.binary()),
            pa.array([row.tobytes() for row in positions], pa.binary()),
        ], [f.split()[0] for f in MATRIX.split(", ")])

    pieces = token_pieces(docs, file, capacity=capacity, end_id=end_id, with_ids=True)
    return _groups(pieces, docs, group_docs, seed).groupBy("_group").applyInArrow(run, MATRIX)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet files, ready for a loader that reads binary columns."""
    packed.write.mode("errorifexists").parquet(path)
