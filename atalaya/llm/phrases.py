"""Phrases whose words keep company more than their counts suggest, by set-oriented mining of occurrence relations.

Texts are cut into pieces and words. A relation R1 of all word occurrences, sorted by place, is written in blocks of
bounded size; in a block a place is an index, and a gap separates pieces. Round by round R(k-1) is merged with itself at the
next place, which gives the phrases of k words; a block counts its own, Spark adds the counts of all blocks, and each
block gets back which of its phrases are frequent (semi-join). What is left is written as R(k). Only counts of distinct
phrases of a block are shuffled, so a phrase that is everywhere costs one row a block.

A phrase is the pair of its two phrases of one word less, by their ids. An id is the least (block, number in the block) that
has the phrase, so ids are unique among phrases of one length without any table of words beside the counts.

Defined results: a null text is an empty one, a null language is `und`; repeated rows count each; equal scores and counts
are ordered by phrase; a language without candidates gives no row; an empty table gives an empty result; other columns are
ignored. A piece is never cut, however long it is.
"""

from __future__ import annotations

import gc
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atalaya.llm.frames import give_back, small_batches, tidy
from atalaya.runtime import discard, materialize

# --- fixed values of the measure ---------------------------------------------------
LEAST, LONGEST = 30, 4
SCALE = 2_000_000
TOP = 2000
NO_LANGUAGE = "und"
# -----------------------------------------------------------------------------------

#: Occurrences in a block, beyond which it ends with the piece at hand; characters worked on at once.
BLOCK, SLICE_BYTES = 6_000_000, 1_000_000
#: Places of a block whose phrases are looked up at once.
CHUNK = 1_000_000
#: Rows of counts handed to Spark at once.
BATCH = 100_000
#: Candidates of a language that are ordered by one task in the first of two steps.
SORTED = 200_000

_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 46 if b in _BREAKS else b for b in range(256))
_BLANK = re.compile(rb"[ \t.]")


def word_slices(text: bytes, limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """Words in order, with a full stop wherever a piece ends, in lists of bounded size."""
    folded = text.translate(_FOLD)
    start = 0
    while start < len(folded):
        found = _BLANK.search(folded, start + limit)
        end = found.end() if found else len(folded)
        yield folded[start:end].replace(b".", b" . ").split()
        start = end


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, the four bytes of a number apart."""
    planes = np.ascontiguousarray(values.astype("<i4", copy=False).view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + pa.compress(pa.py_buffer(planes), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def counts_of(places: np.ndarray, numbers: int) -> np.ndarray:
    """How often each of the numbers 0..numbers-1 occurs; gaps are left out."""
    often = np.zeros(numbers + 1, np.int64)
    for i in range(0, len(places), CHUNK):
        often += np.bincount(places[i:i + CHUNK] + 1, minlength=numbers + 1)
    return often[1:]


class _Block:
    """Occurrences of one block: numbers of words in order, with a gap (-1) between pieces."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, defaultdict] = {}
        self.pieces: list[np.ndarray] = []
        self.size = 0
        # No method of the block: a block that held itself would stay until the collector of cycles runs.
        self.number = itertools.count().__next__

    def add(self, lang: bytes, words: list[bytes]) -> None:
        known = self.numbers.get(lang)
        if known is None:
            known = self.numbers[lang] = defaultdict(self.number)
            known[b"."] = -1
        self.pieces.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def end(self) -> None:
        self.pieces.append(np.full(1, -1, np.int32))

    def rows(self, block: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        places = np.concatenate(self.pieces) if self.pieces else np.zeros(0, np.int32)
        self.pieces.clear()
        often = counts_of(places, sum(len(known) - 1 for known in self.numbers.values()))
        for lang, known in self.numbers.items():
            words = [w for w in known if w != b"."]
            codes = np.fromiter((known[w] for w in words), np.int64, len(words))
            for i in range(0, len(words), BATCH):
                part = codes[i:i + BATCH]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(part), block)), pa.array((block << 32) + part), pa.array([lang] * len(part), pa.binary()),
                        pa.array(words[i:i + BATCH], pa.binary()), pa.array(often[part]), pa.nulls(len(part), pa.binary()),
                    ],
                    names,
                )
        none = [pa.nulls(1, kind) for kind in (pa.int64(), pa.binary(), pa.binary(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *none, pa.array([packed(places)], pa.binary())], names)


def occurrences(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of occurrences (`data`), and each block's words with their counts (`word`, `n`) in rows of their own."""
    schema = "block long, key long, lang binary, word binary, n long, data binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        if place >= 1 << 20:
            raise ValueError("more than a million partitions of documents")
        number, held = 0, _Block()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for words in word_slices(text):
                    while held.size + len(words) >= block:  # a full block ends with the piece at hand
                        try:
                            stop = words.index(b".", max(0, block - held.size - 1)) + 1
                        except ValueError:
                            break
                        held.add(lang, words[:stop])
                        words = words[stop:]
                        yield from held.rows(place << 11 | number, names)
                        number, held = number + 1, _Block()
                    held.add(lang, words)
                held.end()
            if held.size >= block:
                yield from held.rows(place << 11 | number, names)
                number, held = number + 1, _Block()
        if held.size:
            yield from held.rows(place << 11 | number, names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(run), schema)


def neighbours(places: np.ndarray, low: int = 0, high: int = 1 << 31) -> tuple[np.ndarray, np.ndarray]:
    """The relation merged with itself at the next place: each place's pair as one number, and which places have one.

    Only pairs whose first number lies in low..high-1.
    """
    both = (places[:-1] >= low) & (places[:-1] < high) & (places[1:] >= 0)
    pairs = places[:-1][both].astype(np.int64)
    pairs <<= 32
    pairs |= places[1:][both]
    return pairs, both


def sorted_neighbours(places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs in order, in slices by their first number, and where each distinct one starts in its slice.

    A slice holds about `CHUNK` pairs, or those of one number, so little is held beside the block.
    """
    upto = np.cumsum(counts_of(places, int(places.max(initial=-1)) + 1))
    cuts = np.searchsorted(upto, np.arange(CHUNK, upto[-1] if len(upto) else 0, CHUNK))
    edges = np.unique(np.concatenate([[0], cuts, [len(upto)]])).tolist()
    for low, high in itertools.pairwise(edges):
        pairs = neighbours(places, low, high)[0]
        pairs.sort()
        new = np.ones(len(pairs), bool)
        np.not_equal(pairs[1:], pairs[:-1], out=new[1:])
        yield pairs, np.flatnonzero(new)


def numbered_pairs(places: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """At each place the number, among `codes` in order, of its pair; -1 without one. A code is a place among the distinct pairs."""
    picked, base = [np.zeros(0, np.int64)], 0
    for pairs, starts in sorted_neighbours(places):
        own = codes[np.searchsorted(codes, base):np.searchsorted(codes, base + len(starts))]
        picked.append(pairs[starts[own - base]])
        base += len(starts)
    wanted = np.concatenate(picked)
    found = np.full(len(places), -1, np.int32)
    if len(wanted):
        for i in range(0, len(places) - 1, CHUNK):
            some, both = neighbours(places[i:i + CHUNK + 1])
            at = np.minimum(np.searchsorted(wanted, some), len(wanted) - 1)
            found[i:i + len(both)][both] = np.where(wanted[at] == some, at, -1)
    return found


def semi_join(codes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Occurrences of the given numbers only, numbered anew; gaps are one wide, and what has no neighbour goes."""
    table = np.full(max(int(codes.max(initial=-1)), int(frequent.max(initial=-1))) + 2, -1, np.int32)
    table[frequent] = np.arange(len(frequent), dtype=np.int32)
    places = table[codes]
    here = np.concatenate([[False], places >= 0, [False]])
    places = np.where(here[1:-1] & (here[:-2] | here[2:]), places, -1)
    return places[(places >= 0) | np.concatenate([[False], places[:-1] >= 0])] if len(places) else places


def next_relation(relation: DataFrame, frequent: DataFrame, first: bool) -> DataFrame:
    """R(k) of every block, with the ids of its phrases, from R(k-1) and the frequent phrases of k words."""
    schema = "block long, data binary, ids binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("key").to_numpy())
        codes = (right.column("key").to_numpy()[order] & 0xFFFFFFFF).astype(np.int64)
        ids = right.column("id").to_numpy()[order]
        blocks, data = [], []
        for block, content in zip(left.column("block").to_pylist(), left.column("data").to_pylist(), strict=True):
            places = unpacked(content)
            if not first:
                places = numbered_pairs(places, codes)
            blocks.append(block)
            data.append(packed(semi_join(places, codes if first else np.arange(len(codes)))))
            del places
        give_back()
        return pa.table([pa.array(blocks, pa.int64()), pa.array(data, pa.binary()), pa.array([ids.astype("<i8").tobytes()] * len(blocks), pa.binary())], names)

    answers = frequent.select(F.shiftright("key", 32).alias("block"), "key", "id")
    return relation.select("block", "data").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def pair_counts(relation: DataFrame) -> DataFrame:
    """Each block's distinct neighbours in the relation, by their ids, and how often they occur.

    These rows are most of what is shuffled. Rows come in the order of `a`, so what mostly stays the same from row to row stands
    first, and `b` has its bytes turned round (`turned`): the ones that differ then lie beside those of `key`, which saves a sixth of the compressed bytes.
    """
    schema = "n long, a long, b long, key long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                known, base = np.frombuffer(ids, "<i8"), block << 32
                for pairs, starts in sorted_neighbours(unpacked(data)):
                    for i in range(0, len(starts), BATCH):
                        edges = np.append(starts[i:i + BATCH + 1], [] if i + BATCH < len(starts) else [len(pairs)]).astype(np.int64)
                        part = pairs[edges[:-1]]
                        columns = [np.diff(edges), known[part >> 32], known[part & 0xFFFFFFFF].byteswap(), base + np.arange(len(part))]
                        base += len(part)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return relation.select("block", "data", "ids").mapInArrow(tidy(run), schema)


def turned(number: Column) -> Column:
    """The number whose bytes are those of the given one in reverse."""
    return F.java_method(F.lit("java.lang.Long"), F.lit("reverseBytes"), number).cast("bigint")


def frequent_only(counts: DataFrame, identity: list[str], least: int) -> DataFrame:
    """Rows of the blocks whose phrase occurs at least `least` times in all, with its id.

    What the phrase is and its count `f` stand in the one row that gives the id; the others need the id only.
    """
    same = Window.partitionBy(*identity)
    found = counts.withColumn("f", F.sum("n").over(same)).withColumn("id", F.min("key").over(same)).where(F.col("f") >= least)
    return found.select("key", "id", *[F.when(F.col("id") == F.col("key"), F.col(c)).alias(c) for c in (*identity, "f")])


def score(count: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * count / (left + right)); the product may need more than 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(8,0)") * wide(count), wide(left) + wide(right))


def with_words(frequent: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases from their two shorter ones: words, and the counts of all their beginnings (`heads`) and endings (`tails`)."""
    first = shorter.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("_phrase"), F.col("heads").alias("_heads"))
    second = shorter.select(F.col("id").alias("b"), "last", F.col("tails").alias("_tails"))
    return frequent.where("id = key").select("id", "a", turned(F.col("b")).alias("b"), "f").join(first, "a").join(second, "b").select(
        "id", "a", "b", "lang", F.concat_ws(" ", "_phrase", "last").alias("phrase"), "last", "f",
        F.concat("_heads", F.array("f")).alias("heads"), F.concat("_tails", F.array("f")).alias("tails"),
    )


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, which it does once the driver has dropped their plans as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def worst_cut(longest: int) -> Column:
    """Of all cuts of a phrase into two the one of the lowest score, ties to the shortest first part."""
    cuts = [
        F.when(F.size("heads") > k, F.struct(
            score(F.col("f"), F.get("heads", F.lit(k - 1)), F.get("tails", F.size("tails") - k - 1)).alias("score"), F.lit(k).alias("k"),
            F.get("heads", F.lit(k - 1)).alias("l"), F.get("tails", F.size("tails") - k - 1).alias("r"),
        ))
        for k in range(1, longest)
    ]
    return F.array_min(F.array_compact(F.array(*cuts)))


def first_per_language(rows: DataFrame, order: list[Column], top: int, parts: int) -> DataFrame:
    """The first rows of every language with their rank: of shares of a language first, then of the whole."""
    share = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    kept = rows.withColumn("_share", share)
    for keys in (["lang", "_share"], ["lang"]):
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return kept.drop("_share")


def collocations(
    docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, top: int = TOP, block: int = BLOCK, lang: str = "lang", text: str = "text"
) -> DataFrame:
    """The first phrases of every language by score, with their counts and those of the two parts of their worst cut."""
    source = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANGUAGE)).cast("binary").alias("lang"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    base = materialize(occurrences(source, block), "occurrences")
    words = base.where("data IS NULL").select("key", F.col("lang").cast("string").alias("lang"), F.col("word").cast("string").alias("word"), "n")
    totals = materialize(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    frequent = materialize(frequent_only(words, ["lang", "word"], least), "frequent")
    single = F.array("f")
    known = materialize(
        frequent.where("id = key").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", single.alias("heads"), single.alias("tails")),
        "phrases",
    )
    # Every relation, and what was frequent in it, goes as soon as the next one is written, so one of them and its counts are on disk at a time.
    relation, last, found = base.where("data IS NOT NULL"), base, []
    for k in range(2, longest + 1):
        relation = materialize(next_relation(relation, frequent, first=k == 2), "relation")
        discard(last)
        discard(frequent)
        last = relation
        release(docs.sparkSession)
        frequent = materialize(frequent_only(pair_counts(relation), ["a", "b"], least), "frequent")
        known = materialize(with_words(frequent, known), "phrases")
        found.append(known)
    discard(last)
    discard(frequent)
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    # Ids are unique among phrases of one length.
    candidates = candidates.withColumn("k", F.size("heads"))
    # A phrase that a longer one holds is held by one of one word more, which is at least as frequent.
    longer = candidates.select((F.col("k") - 1).alias("k"), F.explode(F.array("a", "b")).alias("id"), "f").groupBy("k", "id").agg(F.max("f").alias("_longer"))
    kept = candidates.join(longer, ["k", "id"], "left").where(F.col("_longer").isNull() | (5 * F.col("_longer") < 4 * F.col("f")))
    scored = kept.withColumn("_cut", worst_cut(longest)).select(
        "lang", "phrase", F.col("f").alias("a"), F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("_cut.score").alias("score")
    )
    parts = 1 + candidates.count() // SORTED
    ranked = first_per_language(scored, [F.desc("score"), F.desc("a"), F.col("phrase")], top, parts)
    result = ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    return result


def oracle() -> str:
    """The same as DuckDB SQL."""
    return rf"""
WITH d AS (
  SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?
-
]')) AS piece FROM d
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, (VALUES {", ".join(f"({k})" for k in range(1, LONGEST + 1))}) t(k)
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), t AS (
  SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT * FROM f WHERE k >= 2 AND f >= {LEAST}
), keys AS MATERIALIZED (
  SELECT lang, k, phrase, f AS a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS head, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c)
), cuts AS MATERIALIZED (
  SELECT keys.lang, keys.k, keys.phrase, a, j, x.f AS l, y.f AS r, {SCALE}::HUGEINT * a // (x.f + y.f) AS score
  FROM keys JOIN f x ON x.lang = keys.lang AND x.phrase = head JOIN f y ON y.lang = keys.lang AND y.phrase = tail
), best AS (
  SELECT lang, k, phrase, a, arg_min(l, (score, j)) AS l, arg_min(r, (score, j)) AS r, min(score) AS score FROM cuts GROUP BY ALL
), held AS (
  SELECT DISTINCT b.lang, b.phrase FROM c b JOIN c x ON x.lang = b.lang AND x.k > b.k
    AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * x.f >= 80 * b.f
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best ANTI JOIN held USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM r JOIN t USING (lang) WHERE rank <= {TOP}
"""
