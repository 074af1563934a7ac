"""Near-duplicates by consistent weighted sampling over TF-IDF shingles, banded and verified.

1. A count-min sketch over all texts gives the document frequency of every shingle, at most about one percent
   of the documents too high. The weight of a shingle is 1 + ln of its count, times
   idf = 1 + min(1, ln(N / df) / ln 8): shingles in under an eighth of the documents count double, those in all once.
2. Every text gets a signature of independent consistent weighted samples; bands of it are bucket keys.
3. Equal texts form a class first. Each bucket compares its classes with one of them, and buckets
   that then still hold several components do so again with other ones. What is left in several
   components is compared across them, in blocks. So a bucket loses no candidate pair, and a large
   group of copies costs a few comparisons per member and band.
4. A candidate pair whose signatures agree far too rarely for the threshold is dropped (`SLACK`
   standard deviations below it); all others are verified on their whole texts by weighted Jaccard.
5. Links form components; a document's class is the smallest id of its component.

Defined results: a null text is an empty one; texts without words are alike; a null id counts as the
smallest id; rows that repeat are in one class, all but one of them dropped by `without_near_copies`; an empty table
gives an empty result; other columns are kept by `without_near_copies` and ignored otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atalaya.llm.blocks import compare_open
from atalaya.llm.frames import chunks, documents, numbered, small_batches
from atalaya.llm.shingles import dart_samples, mix, shingle_hashes, weighted_terms
from atalaya.operators.graph import connected_components
from atalaya.runtime import discard, materialize

SIMILARITY = 0.8
BANDS, ROWS = 32, 6
#: Samples of a signature; the bands use the first ones, the estimate of a pair's similarity all of them.
SAMPLES = 384
SLACK = 4.0
#: Rounds in which each bucket that still holds several components compares them with one more of its members.
STAR_ROUNDS = 3
#: Members of a bucket that share one block of the last comparison, on either side.
BLOCK, CHUNK = 256, 2048
#: Cells of a sketch row and rows of the sketch; with S / N shingles a document, the expected
#: excess of a count is S / CELLS, which the idf's flat part swallows.
CELLS, DEPTH = 1 << 16, 4
#: Shingles in less than one document in this many have the full weight.
RARE = 8
#: Parts of each bucket in the join of its members with its smallest one.
SALTS = 8
_NULL_ID = -(1 << 63)
_SALT = [np.uint64(0x9E3779B97F4A7C15 * (2 * d + 3) & (2**64 - 1)) for d in range(DEPTH)]


def _terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return weighted_terms(*shingle_hashes(texts))


def term_weight(count: np.ndarray) -> np.ndarray:
    """1 + ln of the count, so that a line repeated all over a text doesn't stand for the text."""
    return 1 + np.log(count)


def _cells(term: np.ndarray, row: int) -> np.ndarray:
    return (mix(term ^ _SALT[row]) >> np.uint64(48)).astype(np.int64)


def frequency_sketch(docs: DataFrame) -> np.ndarray:
    """Count-min sketch (DEPTH x CELLS) of the shingles' document frequencies, over all texts.

    Each task adds up its own sketch, rows of the sketches are added up by cell block; the
    result has a fixed size.
    """
    blocks = 16
    size = CELLS // blocks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((DEPTH, CELLS), np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for low, high in chunks(texts):
                _, term, _ = _terms(texts[low:high])
                for d in range(DEPTH):
                    sketch[d] += np.bincount(_cells(term, d), minlength=CELLS)
        if sketch.any():
            parts = [sketch[d, b * size : (b + 1) * size].tobytes() for d in range(DEPTH) for b in range(blocks)]
            yield pa.RecordBatch.from_arrays([pa.array(range(DEPTH * blocks), pa.int32()), pa.array(parts, pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(counts, np.int64)
                sums[block] = sums[block] + own if block in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    summed = docs.select("text").mapInArrow(count, schema).repartition(DEPTH * blocks, "block").mapInArrow(add, schema)
    out = np.zeros((DEPTH, CELLS), np.int64)
    for row in summed.collect():  # DEPTH x CELLS numbers, whatever the input
        d, b = divmod(row["block"], blocks)
        out[d, b * size : (b + 1) * size] = np.frombuffer(row["counts"], np.int64)
    return out


class Idf:
    """Weights of shingles from the sketch: only cells that are frequent enough to matter are kept."""

    def __init__(self, sketch: np.ndarray, documents: int):
        self.documents = documents
        often = np.minimum(sketch, documents)
        self.rows = [(np.flatnonzero(r * RARE > documents), r[r * RARE > documents]) for r in often]

    def __call__(self, term: np.ndarray) -> np.ndarray:
        if not hasattr(self, "full"):
            self.full = []
            for cells, counts in self.rows:
                row = np.zeros(CELLS)
                row[cells] = counts
                self.full.append(row)
        count = self.full[0][_cells(term, 0)]
        for d in range(1, DEPTH):
            some = np.flatnonzero(count)
            count[some] = np.minimum(count[some], self.full[d][_cells(term[some], d)])
        out = np.full(len(term), 2.0)
        some = np.flatnonzero(count)
        out[some] = 1 + np.minimum(1, np.log(self.documents / count[some]) / math.log(RARE))
        return out

    def __getstate__(self) -> dict:
        return {"documents": self.documents, "rows": self.rows}


def signatures(docs: DataFrame, idf: Idf, bands: int, rows: int, samples: int, seed: int) -> DataFrame:
    """_id, digest of the text, 8 bits of every sample, and a hash per band."""
    odd = np.cumprod(np.full(rows, 0x9E3779B97F4A7C15, np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            marks, keys = [], []
            for low, high in chunks(texts):
                text, term, count = _terms(texts[low:high])
                found = dart_samples(text, term, term_weight(count) * idf(term), high - low, samples, seed)
                band = (found[:, : bands * rows].reshape(-1, bands, rows) * odd).sum(axis=2, dtype=np.uint64)
                keys.append(mix(band + np.arange(bands, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).view(np.int64))
                marks += [x.tobytes() for x in (found >> np.uint64(24)).astype(np.uint8)]
            flat = np.concatenate(keys).ravel() if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.binary()), lists], ["_id", "key", "marks", "bands"])

    return docs.select("_id", "key", "text").mapInArrow(run, "_id long, key binary, marks binary, bands array<long>")


def _marks(rows) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1), np.uint8)


def likely_pairs(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in a share of at least `least`, with their text digests."""
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("key").alias(f"key_{c}"), F.col("marks").alias(f"marks_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            left, right = (_marks(batch.column(names.index(f"marks_{c}")).to_pylist()) for c in "ab")
            yield batch.select(["a", "b", "key_a", "key_b"]).filter(pa.array((left == right).mean(axis=1) >= least))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "key_a", "key_b", "marks_a", "marks_b")
    return both.mapInArrow(run, "a long, b long, key_a binary, key_b binary")


def weighted_jaccard(left: list[str], right: list[str], idf: Idf) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts; texts without words are alike."""
    shift = np.uint64(48)
    sums = []
    keyed = []
    for texts in (left, right):
        text, term, count = _terms(texts)
        weight = term_weight(count) * idf(term)
        sums.append(np.bincount(text, weight, len(texts)))
        keyed.append(((text.astype(np.uint64) << shift) | term, count))
    _, i, j = np.intersect1d(keyed[0][0], keyed[1][0], assume_unique=True, return_indices=True)
    common = keyed[0][0][i]
    least = term_weight(np.minimum(keyed[0][1][i], keyed[1][1][j])) * idf(common & np.uint64((1 << 48) - 1))
    shared = np.bincount((common >> shift).astype(np.int64), least, len(left))
    union = sums[0] + sums[1] - shared
    return np.where(union > 0, shared / np.where(union > 0, union, 1), 1.0)


def verified_pairs(pairs: DataFrame, docs: DataFrame, idf: Idf, similarity: float) -> DataFrame:
    """The pairs whose whole texts reach the similarity, as edges (src, dst)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            alike = [weighted_jaccard(left[a:b], right[a:b], idf) for a, b in chunks(left, 2_000_000)]
            keep = np.concatenate(alike) >= similarity - 1e-12 if alike else np.zeros(0, bool)
            yield batch.select(["src", "dst"]).filter(pa.array(keep))

    side = lambda c: docs.select(F.col("_id").alias(c), F.col("key").alias(f"key_{c}"), F.col("text").alias(f"text_{c}"))
    texts = pairs.join(side("a"), ["a", "key_a"]).join(side("b"), ["b", "key_b"])
    ready = texts.select(F.col("a").alias("src"), F.col("b").alias("dst"), "text_a", "text_b")
    return ready.mapInArrow(run, "src long, dst long")


def _bucket_join(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """Members with what is known of their bucket; each bucket is cut into parts by member."""
    salted = members.withColumn("_salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)))
    spread = buckets.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, ["band", "_salt"]).drop("_salt")


def star_pairs(placed: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each bucket's pivot with its members of other components; a pivot is drawn by hash."""
    drawn = F.min(F.struct(F.xxhash64("rep", "band", F.lit(turn)).alias("_draw"), "rep", "component"))
    pivots = placed.groupBy("band").agg(
        drawn.alias("pivot"), F.min("component").alias("_low"), F.max("component").alias("_high")
    ).where("_low < _high").select("band", F.col("pivot.rep").alias("pivot"), F.col("pivot.component").alias("_own"))
    other = _bucket_join(placed, pivots).where(F.col("component") != F.col("_own"))
    return other.select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct()


_PAIR = "a long, b long, key_a binary, key_b binary"


def _across(open_: pd.DataFrame, members: pd.DataFrame, least: float) -> pd.DataFrame:
    """Pairs of open members with members of other components of their bucket, if their signatures agree."""
    if open_.empty:
        return pd.DataFrame({"a": [], "b": [], "key_a": [], "key_b": []})
    marks, bands, rows = _marks(members["marks"].tolist()), np.stack(members["bands"].to_numpy()), []
    band, component, rep, is_open = (members[c].to_numpy() for c in ("band", "component", "rep", "open"))
    key = members["key"].tolist()
    each = zip(*(open_[c] for c in ("band", "component", "rep", "key", "bands")), _marks(open_["marks"].tolist()), strict=True)
    for b, c, r, k, own_bands, own in each:
        # Two open members meet twice, once from each side.
        near = np.flatnonzero((band == b) & (component != c) & (~is_open | (rep < r)))
        # A pair that shares several buckets is taken in the first of them.
        near = near[np.asarray(own_bands)[(bands[near] == own_bands).argmax(axis=1)] == b]
        for j in near[(marks[near] == own).mean(axis=1) >= least].tolist():
            rows.append((rep[j], r, key[j], k) if rep[j] < r else (r, rep[j], k, key[j]))
    return pd.DataFrame(rows, columns=["a", "b", "key_a", "key_b"])


def pairs_across(placed: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Likely pairs between the components that still share a bucket, all of them.

    Members outside a bucket's largest component are open and meet all the others.
    """
    parts = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("band").agg(F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    inside = _bucket_join(placed, mixed.select("band", F.col("most.component").alias("main")))
    marked = inside.join(classes.select("rep", "key", "marks", "bands"), "rep")
    ready = materialize(marked.select("band", "rep", "component", "key", "marks", "bands", (F.col("component") != F.col("main")).alias("open")), "mixed")
    found = compare_open(ready, "band", "rep", lambda u, m: _across(u, m, least), _PAIR, block=BLOCK, chunk=CHUNK, rows=ready.count())
    return found.distinct()


def text_key(text: str = "text") -> Column:
    return F.unhex(F.md5(F.col(text)))


def near_classes(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    samples: int = SAMPLES,
    seed: int = 4,
) -> DataFrame:
    """One row per document: doc_id, its `_id` and text digest, and class_id, `_class` being never null."""
    small_batches(docs.sparkSession)
    own = documents(docs, id_column=id_column, text_column=text_column)
    own = own.select("doc_id", F.coalesce("doc_id", F.lit(_NULL_ID)).alias("_id"), text_key().alias("key"), "text")
    idf = Idf(frequency_sketch(own), own.count())
    signed = materialize(signatures(own, idf, bands, rows, samples, seed), "signatures")
    # Equal texts: one class under the smallest id. Signatures are equal then.
    lowest = signed.groupBy("key").agg(F.min(F.struct("_id", "marks", "bands")).alias("first"))
    classes = materialize(lowest.select("key", F.col("first._id").alias("rep"), "first.marks", "first.bands"), "classes")
    ids = classes.select(F.col("rep").alias("id"))
    members = classes.select("rep", F.explode("bands").alias("band"))
    counted = members.groupBy("band").agg(F.min("rep").alias("_first"), F.max("rep").alias("_last")).where("_first < _last")
    shared = materialize(_bucket_join(members, counted.select("band")), "shared")
    least = similarity - SLACK * math.sqrt(similarity * (1 - similarity) / samples)

    def check(likely: DataFrame) -> DataFrame:
        likely = materialize(likely, "likely")
        found = materialize(verified_pairs(likely, own, idf, similarity).distinct(), "verified")
        discard(likely)
        return found

    placed = shared.withColumn("component", F.col("rep"))
    tested = edges = found = None
    for turn in range(STAR_ROUNDS):
        fresh = star_pairs(placed, turn)
        fresh = materialize(fresh if tested is None else fresh.join(tested, ["a", "b"], "left_anti"), "star")
        tested = fresh if tested is None else tested.unionByName(fresh)
        links = check(likely_pairs(fresh, classes, least))
        edges = links if edges is None else edges.unionByName(links)
        found = materialize(connected_components(ids, edges), "components")
        placed = materialize(shared.join(found.select(F.col("id").alias("rep"), "component"), "rep"), "placed")
    rest = pairs_across(placed, classes, least).join(tested, ["a", "b"], "left_anti")
    final = connected_components(ids, edges.unionByName(check(rest)))
    named = classes.select("key", F.col("rep").alias("id")).join(final, "id").select("key", F.col("component").alias("_class"))
    # Only texts of classes are looked up; a text that many rows share is one key, so its rows are cut into parts.
    salted = signed.select("_id", "key").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)))
    spread = named.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    null = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return salted.join(spread, ["key", "_salt"]).select(
        null("_id").alias("doc_id"), null("_class").alias("class_id"), (F.col("_id") == F.col("_class")).alias("kept"),
        "_id", "_class", "key",
    )


def without_near_copies(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One document of each class, with all columns: the one of the smallest id."""
    own = numbered(docs)
    id_name, text_name = (own.columns[docs.columns.index(c)] for c in (id_column, text_column))
    classes = near_classes(own, id_column=id_name, text_column=text_name, **options)
    kept = classes.where("kept").select(F.col("_id").alias("__id"), F.col("key").alias("__key")).distinct()
    marked = own.withColumn("__own_id", F.coalesce(F.col(id_name).cast("long"), F.lit(_NULL_ID))).withColumn(
        "__own_key", F.unhex(F.md5(F.coalesce(F.col(text_name).cast("string"), F.lit(""))))
    )
    joined = marked.join(kept, (F.col("__own_id") == F.col("__id")) & (F.col("__own_key") == F.col("__key")), "left_semi")
    return joined.dropDuplicates(["__own_id", "__own_key"]).select(*own.columns).toDF(*docs.columns)
