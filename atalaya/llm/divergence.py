"""How far the term use of sources of one language lies apart, by Gustavson's row accumulation.

Terms are the runs of ASCII letters (A-Z lower-cased) and non-ASCII characters; a language keeps the terms of at
least `least_docs` of its documents. The kept counts are a sparse matrix of groups (language, source) by terms. Its
terms are dealt to blocks; a block holds the index from terms to groups for all groups of a language. Each group
walks its own terms through that index and adds what it shares with every peer to one dense accumulator, so pairs of
postings are never rows. A term that one or both groups lack has a share too (the zero baseline): what all terms
would give at zero counts, corrected by how often each count occurs in a group, and by the shared terms.

Defined results: null text, language and source are empty ones; a group of which no term is kept has the shares of
zero counts; a language without kept terms gives pairs of value 0; a language of one source has no pairs; repeated rows
are documents of their own; rows of equal value are ranked by item; an empty table gives an empty result; other columns
are ignored. Shares are whole billionths, and every sum is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atalaya.llm.frames import small_batches
from atalaya.runtime import discard, materialize

# --- fixed values of the measure ---------------------------------------------------
SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP_TERMS = 200
# -----------------------------------------------------------------------------------

#: Postings of a block at least and at most; in between it grows with the square of the sources, as its output does.
BLOCK, MOST_BLOCK = 200_000, 1_000_000
#: Distinct terms that a task counts before it hands them on, and bytes of a text worked on at once.
HELD_TERMS, SLICE_BYTES = 300_000, 4_000_000

#: Every byte that ends a term becomes a blank, and A-Z become a-z. Bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_slices(text: bytes, limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The terms of a text in lists of bounded size."""
    folded = text.translate(_FOLD)
    start = 0
    while len(folded) - start > limit:
        end = folded.rfind(b" ", start + 1, start + limit)
        if end < 0:  # one term longer than the limit
            end = folded.find(b" ", start + limit)
            end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end
    yield folded[start:].split()


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences and documents of each term per group, counted inside tasks; an empty term marks that a group occurs.

    Rows of one group and term come from several tasks and have still to be added up.
    """
    schema = "lang string, source string, term binary, n long, docs long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, seen) in counts.items():
                terms = [b"", *n]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()),
                        pa.array([0, *n.values()], pa.int64()), pa.array([0, *(seen[t] for t in n)], pa.int64()),
                    ],
                    names,
                )
            counts.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n, seen = counts.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for terms in term_slices(text):
                    n.update(terms)
                    own.update(terms)
                seen.update(own)
            if sum(len(n) for n, _ in counts.values()) > HELD_TERMS:
                yield from flush()
        yield from flush()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def groups_of(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Language, source and text under fixed names, nulls as empty texts."""
    filled = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    return docs.select(filled(lang).alias("lang"), filled(source).alias("source"), filled(text).cast("binary").alias("text"))


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / totals) by long division, so that nothing passes 64 bits."""
    whole, rest = np.divmod(counts, totals)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, totals)
        whole = whole * 1000 + digits
    return whole + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def accumulate(group: np.ndarray, term: np.ndarray, count: np.ndarray, sizes: np.ndarray, terms: int, first: bool) -> Iterator[np.ndarray]:
    """Per group the dense sums over the peers of what the postings of a block give; the first block adds the baseline of all terms.

    `sizes` are the groups' totals plus the number of kept terms. Sums are exact modulo 2^64, and the whole result fits.
    """
    p, zero = shares(count + 1, sizes[group]), shares(np.ones_like(sizes), sizes)
    by_term = np.argsort(term, kind="stable")
    peers, peer_p = group[by_term], p[by_term]
    ends = np.cumsum(np.bincount(term, minlength=int(term.max()) + 1 if len(term) else 0))
    by_group = np.argsort(group, kind="stable")
    rows = np.searchsorted(group[by_group], np.arange(len(sizes) + 1))
    # How often each count occurs in each group.
    marks, often = np.unique(np.stack([group, p]), axis=1, return_counts=True) if len(group) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
    parts = np.searchsorted(marks[0], np.arange(len(sizes) + 1))
    for g in range(len(sizes)):
        both_zero = distance(zero[g], zero)
        total = both_zero * terms if first else np.zeros(len(sizes), np.int64)
        np.add.at(total, marks[0], often * (distance(zero[g], marks[1]) - both_zero[marks[0]]))
        for own, n in zip(marks[1][parts[g]:parts[g + 1]], often[parts[g]:parts[g + 1]], strict=True):
            total += n * (distance(own, zero) - both_zero)
        mine = by_group[rows[g]:rows[g + 1]]
        stops = ends[term[mine]]
        lengths = stops - np.concatenate([[0], ends])[term[mine]]
        at = np.repeat(stops - np.cumsum(lengths), lengths) + np.arange(lengths.sum())
        h, theirs, ours = peers[at], peer_p[at], np.repeat(p[mine], lengths)
        np.add.at(total, h, distance(ours, theirs) - distance(zero[g], theirs) - distance(ours, zero[h]) + both_zero[h])
        yield total


def telling_terms(group: np.ndarray, term: np.ndarray, count: np.ndarray, sizes: np.ndarray, whole: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Postings whose share lies above the language's, the first `top` of each group, and their values.

    Terms are numbered in their order; a block's first ones hold all that can be among the first of a group.
    """
    p = shares(count + 1, sizes[group])
    in_lang = np.zeros(int(term.max()) + 1 if len(term) else 0, np.int64)
    np.add.at(in_lang, term, count)
    q = shares(in_lang + 1, np.full_like(in_lang, whole))[term]
    at = np.flatnonzero(p > q)
    value = distance(p[at], q[at])
    order = np.lexsort((term[at], -value, group[at]))
    at, value = at[order], value[order]
    place = np.arange(len(at)) - np.searchsorted(group[at], group[at])
    return at[place < top], value[place < top]


def _block_result(key: tuple, part: pd.DataFrame, top: int) -> pd.DataFrame:
    lang, block = key
    groups = part[part["term"].isna()].sort_values("source")
    rows = part[part["term"].notna()]
    sources = pd.Index(groups["source"])
    terms = int(groups["terms"].iloc[0])
    group = sources.get_indexer(rows["source"]).astype(np.int64)
    term, words = pd.factorize(rows["term"], sort=True)
    count = rows["n"].to_numpy(np.int64)
    sizes = np.maximum(groups["n"].to_numpy(np.int64) + terms, 1)
    names = sources.to_numpy()
    sums = np.array(list(accumulate(group, term, count, sizes, terms, block == 0))).reshape(len(names), len(names))
    left, right = np.nonzero(~np.eye(len(names), dtype=bool))
    at, value = telling_terms(group, term, count, sizes, int(groups["n"].sum()) + terms, top)
    return pd.concat(
        [
            pd.DataFrame({"lang": lang, "source": names[left], "part": "pair", "item": names[right], "value": sums[left, right]}),
            pd.DataFrame({"lang": lang, "source": names[group[at]], "part": "term", "item": np.asarray(words, object)[term[at]], "value": value}),
        ]
    )


def ranked(rows: DataFrame, columns: Column) -> DataFrame:
    return rows.withColumn("rank", columns.over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def source_divergence(docs: DataFrame, *, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, block: int = BLOCK) -> DataFrame:
    """Every ordered pair of sources of a language, and the telling terms of every source, with values and ranks."""
    added = term_counts(groups_of(docs)).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = (
        added.withColumn("_docs", F.sum("docs").over(of_term))
        .withColumn("_first", (F.min("source").over(of_term) == F.col("source")).cast("long"))
        .where((F.col("_docs") >= least_docs) | (F.length("term") == 0))
    )
    # Written once: sizes, the number of blocks and the blocks read it.
    postings = materialize(kept.select("lang", "source", F.col("term").cast("string").alias("term"), "n", "_first"), "postings")
    present = F.col("term") != ""
    groups = postings.groupBy("lang", "source").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(present, F.col("_first"))), F.lit(0)).alias("_first")
    ).withColumn("terms", F.sum("_first").over(Window.partitionBy("lang"))).drop("_first")
    groups = materialize(groups, "groups")
    widest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    size = max(block, min(MOST_BLOCK, widest * widest // 16))
    blocks = 1 + postings.count() // size
    everywhere = groups.select(
        "lang", "source", F.lit(None).cast("string").alias("term"), "n", "terms", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    )
    dealt = postings.where(present).select(
        "lang", "source", "term", "n", F.lit(0).cast("long").alias("terms"), F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block")
    )
    schema = "lang string, source string, part string, item string, value long"
    results = materialize(
        everywhere.unionByName(dealt).groupBy("lang", "block").applyInPandas(lambda key, part: _block_result(key, part, top), schema), "results"
    )
    discard(postings)
    discard(groups)
    pairs = results.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value")
    )
    terms = ranked(results.where("part = 'term'"), F.row_number()).where(F.col("rank") <= top)
    return ranked(pairs, F.row_number()).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def oracle() -> str:
    """The same as DuckDB SQL."""
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term
), v AS (
  SELECT l.lang, count(term) AS terms, coalesce(sum(total), 0) AS n FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept USING (lang) GROUP BY l.lang
), g AS (
  SELECT lang, source, terms, coalesce(sum(c.n), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY lang, source, terms
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + terms)::HUGEINT AS p,
    1 + {SCALE}::HUGEINT * (total + 1) // (SELECT v.n + v.terms FROM v WHERE v.lang = g.lang)::HUGEINT AS q
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
