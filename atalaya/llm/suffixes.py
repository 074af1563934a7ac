"""Removal of byte strings that occur more than once, by ranks of growing length over thinned suffixes.

A byte goes when it lies in a string of `LENGTH` bytes that also starts anywhere else. Ranking every
suffix at doubling lengths would shuffle tens of times the input, so suffixes are thinned first
and a rank is a hash of the string it stands for:

1. A window is a place where `LENGTH` bytes start. Its anchor is the place of the least hash of `GRAM`
   bytes inside the window, the first one on ties. Equal windows have equal anchors, and neighbouring
   windows mostly share theirs: such a run of windows becomes one row.
2. Rank at `GRAM` bytes: rows are dealt by the anchor's hash. Whose anchor occurs once drops out. Of
   the others, runs whose whole stretch (all their windows) occurs twice are settled: all their windows repeat.
3. Rank at `LENGTH` bytes, from the pair of ranks of its two halves (offset `LENGTH` / 2): the windows
   of the runs that are still open, and of one of each settled kind beside them, are dealt by
   that pair. What occurs twice repeats.

Each task first settles what it can among its own documents and sends one row per key, so a string
in a third of all documents is as many rows as there are tasks. Hashes of 96 bits decide.

Defined results: a null text is an empty one and loses nothing; texts shorter than `LENGTH` bytes lose
nothing; rows that repeat are occurrences of their own, so both lose what is long enough; matches never cross
documents; an empty table gives an empty result; other columns are kept by `without_repeats` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atalaya.llm.frames import numbered, partitions_of, small_batches, tidy
from atalaya.llm.shingles import mix, powers, prefix_hash
from atalaya.runtime import materialize

LENGTH = 200
GRAM = 72
#: Bytes of text worked on at once; a longer document is a chunk of its own.
CHUNK_BYTES = 2_000_000
#: Low bits of a sort key that hold a place inside a part of a chunk.
_PLACE_BITS = 24
#: Rows that Python gets at once: long documents or packed columns, which add up.
ROWS_AT_ONCE = 64
#: Bytes of text per bucket of rows. A bucket is sorted in one task.
BUCKET_BYTES = 8_000_000
_U = np.uint64
ALONE, SEVERAL, MIXED = 0, 1, 2


def reference(doc_id: Column, text: Column) -> Column:
    """Names a document's id and text; rows that repeat share it."""
    return F.xxhash64(doc_id, text)


def _short(keys: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of 64-bit numbers."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _long(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


class Chunk:
    """Bytes of some documents in a row, with hashes of any stretch."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        self.starts = self.ends - np.fromiter(map(len, texts), np.int64, len(texts))
        self.sums = prefix_hash(self.data)
        self.down = powers(len(self.data) + 1)[1]

    def raw(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def _anchors(self, low: int, high: int, gram: int, width: int) -> np.ndarray:
        """Anchors of the windows that start at low to high - 1, each with `width` grams."""
        end = high + width - 1
        hashes = mix((self.sums[low + gram : end + gram] - self.sums[low:end]) * self.down[low:end])
        least = (hashes >> _U(_PLACE_BITS) << _U(_PLACE_BITS)) | np.arange(len(hashes), dtype=_U)
        del hashes
        reach = 1
        while reach * 2 <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        least = np.minimum(least[: high - low], least[width - reach : width - reach + high - low])
        return (least & _U((1 << _PLACE_BITS) - 1)).astype(np.int64) + low

    def runs(self, length: int, gram: int) -> tuple[np.ndarray, ...]:
        """(document, first window, further windows, anchor) of every run of windows with one anchor."""
        n = len(self.data)
        if n < length:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        width = length - gram + 1
        windows, step = n - length + 1, 1 << _PLACE_BITS
        # Places are packed relative to a part, so a document of any size fits; each window lies in one part whole.
        step -= width - 1
        anchor = np.concatenate([self._anchors(low, min(low + step, windows), gram, width) for low in range(0, windows, step)])
        whole = np.zeros(n + 1, np.int8)  # windows inside one document
        size = self.ends - self.starts
        fits = size >= length
        np.add.at(whole, self.starts[fits], 1)
        np.add.at(whole, self.ends[fits] - length + 1, -1)
        inside = np.flatnonzero(np.cumsum(whole[:windows]))
        if not len(inside):
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        own = anchor[inside]
        new = np.ones(len(inside), bool)
        new[1:] = (own[1:] != own[:-1]) | (inside[1:] != inside[:-1] + 1)
        first = np.flatnonzero(new)
        document = np.searchsorted(self.ends, inside[first], side="right")
        return document, inside[first], np.diff(np.append(first, len(inside))) - 1, own[first]


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys (first one first), the group of each ordered row, and the group sizes."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = reduce(np.logical_or, [k[order][1:] != k[order][:-1] for k in keys])
    group = np.cumsum(new) - 1
    return order, group, np.bincount(group) if len(order) else np.zeros(0, np.int64)


def settle_runs(gram: np.ndarray, stretch: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Decides what rows with equal anchors can decide among themselves.

    `flag` says what a row stands for: ALONE one run, SEVERAL runs of one stretch, MIXED runs of several
    stretches (whose own `stretch` means nothing). Returns, by row: settled (its windows repeat), open (its
    windows must be compared), and for one row per anchor `speaks`, with its new flag in `says`.
    """
    n = len(gram)
    settled, open_, speaks, says = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.uint8)
    if not n:
        return settled, open_, speaks, says
    stretch = np.where(flag == MIXED, _U(0), stretch)
    order, kind, size = _grouped(gram, stretch)
    g, mixed = gram[order], flag[order] == MIXED
    first_of_kind = np.ones(n, bool)
    first_of_kind[1:] = kind[1:] != kind[:-1]
    twice = (size > 1) | (np.bincount(kind, flag[order] == SEVERAL) > 0)
    new = np.ones(n, bool)
    new[1:] = g[1:] != g[:-1]
    anchor = np.cumsum(new) - 1
    kinds = np.bincount(anchor, first_of_kind)
    several = (kinds > 1) | (np.bincount(anchor, mixed) > 0)
    rows = np.bincount(anchor)
    settled[order] = twice[kind] & ~mixed
    # Beside other stretches: a run of its own, and the first one of each repeated stretch.
    open_[order] = several[anchor] & (rows[anchor] > 1) & ~mixed & (first_of_kind | ~twice[kind])
    speaks[order] = new
    says[order] = np.where(several[anchor], MIXED, np.where(twice[kind], SEVERAL, ALONE))
    return settled, open_, speaks, says


_ROWS = "bucket int, decided boolean, refs binary, of binary, starts binary, spans binary, first binary, second binary, flags binary"
_RUNS = "ref long, settled boolean, start int, span int"


def _row(bucket: int, refs: np.ndarray, of: np.ndarray, *columns: bytes, decided: bool = False) -> tuple:
    """One row of packed columns: the documents that occur, and for each item its place among them."""
    used, place = np.unique(of, return_inverse=True)
    return (bucket, decided, refs[used].astype("<i8").tobytes(), place.astype("<u4").tobytes(), *columns)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order, group, size = _grouped(bucket)
    for part in np.split(order, np.cumsum(size)[:-1]) if len(order) else ():
        yield int(bucket[part[0]]), part


def _byte_chunks(batches: Iterator[pa.RecordBatch], text_column: int) -> Iterator[tuple[list[list], list[bytes]]]:
    """Rows of the batches, regrouped to about CHUNK_BYTES of text: other columns as lists, and the bytes."""
    rows: list[list] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        others = [batch.column(i).to_pylist() for i in range(batch.num_columns) if i != text_column]
        for *own, text in zip(*others, batch.column(text_column).to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text)
            if texts and size + len(data) > CHUNK_BYTES:
                yield rows, texts
                rows, texts, size = [], [], 0
            rows.append(own)
            texts.append(data)
            size += len(data)
    if texts:
        yield rows, texts


def anchor_rows(docs: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """Rows for the rank at `gram` bytes, and the runs that their own task could decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _byte_chunks(batches, 1):
            refs, chunk = np.array([r[0] for r in rows], np.int64), Chunk(texts)
            document, start, span, anchor = chunk.runs(length, gram)
            low = _U((1 << 48) - 1)
            key = mix(chunk.raw(anchor, gram)) & low
            shape = ((anchor - start) << 32 | span).astype(_U)
            stretch = mix(chunk.raw(start, span + length) ^ mix(shape)) & low
            settled, open_, speaks, says = settle_runs(key, stretch, np.zeros(len(key), np.uint8))
            local = start - chunk.starts[document]
            out = []
            send = np.flatnonzero(speaks)
            bucket = ((mix(key[send]) >> _U(16)) % _U(buckets)).astype(np.int64)
            for which, part in _by_bucket(bucket):
                at = send[part]
                out.append(_row(
                    which, refs, document[at], local[at].astype("<i4").tobytes(), span[at].astype("<u2").tobytes(),
                    _short(key[at], 6), _short(stretch[at], 6), says[at].tobytes(),
                ))
            for what, flag in ((settled, 1), (open_, 0)):
                at = np.flatnonzero(what)
                if len(at):
                    out.append(_row(
                        int(refs[0] % buckets), refs, document[at], local[at].astype("<i4").tobytes(),
                        span[at].astype("<u2").tobytes(), b"", b"", np.full(len(at), flag, np.uint8).tobytes(), decided=True,
                    ))
            yield _batch(out, _ROWS)

    return docs.select("ref", "text").mapInArrow(tidy(run), _ROWS)


def _unpacked(rows: list[dict], sizes: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """ref, start, span, first key, second key and flag of all items of packed rows."""
    def joined(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(r[name] for r in rows), kind)

    refs = np.concatenate([np.frombuffer(r["refs"], "<i8")[np.frombuffer(r["of"], "<u4")] for r in rows])
    keys = [_long(b"".join(r[name] for r in rows), size) for name, size in zip(("first", "second"), sizes, strict=True)]
    return refs, joined("starts", "<i4"), joined("spans", "<u2"), *keys, joined("flags", "u1")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list[dict]]]:
    """Rows already decided as they come, all others bucket by bucket; the rows are sorted by bucket."""
    held, which = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if row["decided"]:
                yield True, [row]
                continue
            if held and row["bucket"] != which:
                yield False, held
                held = []
            which = row["bucket"]
            held.append(row)
    if held:
        yield False, held


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartition(max(buckets, partitions_of(rows.sparkSession)), "bucket").sortWithinPartitions("bucket")


def settled_runs(rows: DataFrame, buckets: int) -> DataFrame:
    """Runs by document: settled ones, and open ones whose windows must be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for decided, part in _buckets(batches):
            ref, start, span, key, stretch, flag = _unpacked(part, (6, 6))
            if decided:
                kinds = [(flag == 1, True), (flag == 0, False)]
            else:
                settled, open_, _, _ = settle_runs(key, stretch, flag)
                kinds = [(settled & (flag == ALONE), True), (open_, False)]
            for what, is_settled in kinds:
                if what.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ref[what]), pa.array(np.full(what.sum(), is_settled)), pa.array(start[what]), pa.array(span[what].astype(np.int32))],
                        ["ref", "settled", "start", "span"],
                    )

    return _dealt(rows, buckets).mapInArrow(tidy(run), _RUNS)


def window_rows(affected: DataFrame, buckets: int, length: int) -> DataFrame:
    """Rows for the rank at `length` bytes: the windows of open runs, keyed by the ranks of both halves."""
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _byte_chunks(batches, 2):
            refs, chunk = np.array([r[0] for r in rows], np.int64), Chunk(texts)
            runs = [(i, x["start"], x["span"]) for i, r in enumerate(rows) for x in r[1] if not x["settled"]]
            if not runs:
                continue
            document, start, span = np.array(runs, np.int64).T
            many = span + 1
            within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            document, local = np.repeat(document, many), np.repeat(start, many) + within
            at = chunk.starts[document] + local
            first = mix(chunk.raw(at, half))
            second = mix(chunk.raw(at + half, length - half)) & _U((1 << 32) - 1)
            order, group, size = _grouped(first, second)
            repeated, speaks = np.empty(len(at), bool), np.empty(len(at), bool)
            repeated[order] = size[group] > 1
            head = np.ones(len(order), bool)
            head[1:] = group[1:] != group[:-1]
            speaks[order] = head
            out = []
            send = np.flatnonzero(speaks)
            bucket = (mix(first[send] ^ _U(0x5851F42D4C957F2D)) % _U(buckets)).astype(np.int64)
            for which, part in _by_bucket(bucket):
                own = send[part]
                out.append(_row(
                    which, refs, document[own], local[own].astype("<i4").tobytes(), b"", _short(first[own], 8),
                    _short(second[own], 4), repeated[own].astype(np.uint8).tobytes(),
                ))
            done = np.flatnonzero(repeated)
            if len(done):
                out.append(_row(int(refs[0] % buckets), refs, document[done], local[done].astype("<i4").tobytes(), b"", b"", b"", b"", decided=True))
            yield _batch(out, _ROWS)

    return affected.select("ref", "runs", "text").mapInArrow(tidy(run), _ROWS)


_PLACES = "bucket int, refs binary, starts binary"


def repeated_windows(rows: DataFrame, buckets: int) -> DataFrame:
    """Places of windows that repeat, packed by buckets of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for decided, part in _buckets(batches):
            ref, start, _, first, second, flag = _unpacked(part, (8, 4))
            if not decided:
                order, group, size = _grouped(first, second)
                hit = order[(size[group] > 1) & (flag[order] == 0)]
                ref, start = ref[hit], start[hit]
            target = (mix(ref.view(_U)) % _U(buckets)).astype(np.int64)
            yield _batch([(which, ref[at].tobytes(), start[at].astype("<i4").tobytes()) for which, at in _by_bucket(target)], _PLACES)

    return _dealt(rows, buckets).mapInArrow(tidy(run), _PLACES)


def places_of_documents(packed: DataFrame, buckets: int) -> DataFrame:
    """One row per document: its places, packed."""

    def flush(rows: list[dict]) -> pa.RecordBatch:
        ref = np.frombuffer(b"".join(r["refs"] for r in rows), "<i8")
        start = np.frombuffer(b"".join(r["starts"] for r in rows), "<i4")
        out = [(int(ref[at[0]]), start[at].tobytes()) for _, at in _by_bucket(ref)]
        return _batch(out, "ref long, places binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["bucket"] != held[0]["bucket"]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return _dealt(packed, buckets).mapInArrow(tidy(run), "ref long, places binary")


def covered_spans(size: int, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered places among `size`."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(change)[:size] > 0).astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_CUT = "doc_id long, ref long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary"


def cut_documents(affected: DataFrame, windows: DataFrame, length: int) -> DataFrame:
    """Removed spans and remaining bytes of the documents that have runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                data = np.frombuffer(row["text"].encode("utf-8", "surrogatepass"), np.uint8)
                settled = np.array([(x["start"], x["start"] + x["span"]) for x in row["runs"] if x["settled"]], np.int64).reshape(-1, 2)
                single = np.frombuffer(row["places"] or b"", "<i4").astype(np.int64)
                begin, end = covered_spans(len(data), np.concatenate([settled[:, 0], single]), np.concatenate([settled[:, 1], single]) + length)
                keep = np.ones(len(data), bool)
                for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                    keep[b:e] = False
                out.append((row["doc_id"], row["ref"], len(data), len(data) - int(keep.sum()), begin.tolist(), end.tolist(), data[keep].tobytes()))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in _CUT.split(", ")])

    joined = affected.join(windows, "ref", "left").select("doc_id", "ref", "text", "runs", "places")
    return joined.mapInArrow(tidy(run), _CUT)


def repeated_spans(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM
) -> DataFrame:
    """Documents with repeated strings: their removed spans and what is left; others have no row."""
    spark = docs.sparkSession
    small_batches(spark, ROWS_AT_ONCE)
    own = referenced(docs, id_column, text_column).select(F.col("__id").alias("doc_id"), F.col("__ref").alias("ref"), F.col("__text").alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    runs = materialize(settled_runs(anchor_rows(own, buckets, length, gram), buckets), "runs")
    listed = runs.groupBy("ref").agg(F.collect_set(F.struct("settled", "start", "span")).alias("runs"))
    affected = materialize(own.join(listed, "ref"), "affected")
    packed = repeated_windows(window_rows(affected, buckets, length), buckets)
    windows = materialize(places_of_documents(packed, buckets), "windows")
    return cut_documents(affected, windows, length).where("n_removed > 0")


def referenced(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The rows with `__id`, `__text` (never null) and `__ref`."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    marked = docs.withColumn("__id", F.col(f"`{id_column}`").cast("long")).withColumn("__text", text)
    return marked.withColumn("__ref", reference(F.col("__id"), F.col("__text")))


def span_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the remaining bytes, of every row."""
    columns = {k: options[k] for k in ("id_column", "text_column") if k in options}
    cut = repeated_spans(docs, **options).select(
        "doc_id", "ref", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
    cut = materialize(cut, "cut")
    rows = referenced(docs, columns.get("id_column", "doc_id"), columns.get("text_column", "text")).select(
        F.col("__id").alias("doc_id"), F.col("__ref").alias("ref"), F.octet_length("__text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("__text", 256).alias("kept_sha256"),
    )
    return cut.unionByName(rows.join(cut.select("ref").distinct(), "ref", "left_anti")).drop("ref")


def without_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """All rows and columns, with repeated strings cut out of the texts.

    A character that a cut leaves in part goes as a whole.
    """
    own = numbered(docs)
    id_name, text_name = (own.columns[docs.columns.index(c)] for c in (id_column, text_column))
    cut = repeated_spans(own, id_column=id_name, text_column=text_name, **options)
    fixed = materialize(cut.select(F.col("ref").alias("__fixed"), F.col("kept").alias("__kept")).dropDuplicates(["__fixed"]), "fixed")
    joined = referenced(own, id_name, text_name).join(fixed, F.col("__ref") == F.col("__fixed"), "left")
    text = F.when(F.col("__kept").isNull(), F.col(text_name)).otherwise(_utf8(F.col("__kept")))
    return joined.withColumn(text_name, text).select(*own.columns).toDF(*docs.columns)


def _utf8(data: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else bytes(x).decode("utf-8", "ignore"))

    return run(data)
