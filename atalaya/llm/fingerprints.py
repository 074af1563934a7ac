"""Document fingerprints by consistent weighted sampling, and their likeness.

A text's terms are its five-word shingles, weighted by how often they occur. The fingerprint
has one 16-bit number per sample, as hexadecimal text; the share of equal numbers of two fingerprints
estimates the generalised Jaccard similarity of the texts (sum of minima over sum of maxima).

Defined results: a null text is an empty one; empty texts have the fingerprint of zeros, so two of
them are alike (1.0); a null id counts as the smallest; rows of one id are ordered by their texts and
each gives a row; a single row follows itself; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from atalaya.llm.frames import chunks, documents, partitions_of, small_batches
from atalaya.llm.shingles import batch_signatures

SAMPLES = 128
_NULL_ID = -(1 << 63)


def fingerprint_rows(texts: list[str], samples: int = SAMPLES, seed: int = 6) -> np.ndarray:
    """One row of 16-bit numbers per text."""
    parts = [batch_signatures(texts[a:b], samples, seed) for a, b in chunks(texts)]
    return (np.concatenate(parts) >> np.uint64(24)).astype(">u2") if parts else np.zeros((0, samples), ">u2")


def fingerprint(text: Column, samples: int = SAMPLES, seed: int = 6) -> Column:
    """Fingerprint of a text column."""

    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([row.tobytes().hex() for row in fingerprint_rows(texts.fillna("").tolist(), samples, seed)])

    return run(text)


def likeness(left: Column, right: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprint columns."""
    same = [(F.substring(left, 4 * i + 1, 4) == F.substring(right, 4 * i + 1, 4)).cast("int") for i in range(samples)]
    return sum(same[1:], same[0]) / F.lit(samples)


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first ones of another text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def with_next(docs: DataFrame, per_partition: int = 4) -> tuple[DataFrame, int]:
    """Rows dealt so that each task sees documents in descending id order, each before its next one.

    Ids are cut into ranges at values that occur; a range's first document goes to the range
    above it too, as a guest, and the very first one to the lowest range. One shuffle of the texts.
    """
    order = F.coalesce("doc_id", F.lit(_NULL_ID))
    number = per_partition * partitions_of(docs.sparkSession)
    found = docs.agg(
        F.percentile_approx(order, [(i + 1) / number for i in range(number)], 100 * number).alias("cuts"), F.max(order).alias("top")
    ).first()
    cuts, top = np.unique(np.array(found["cuts"] or [], np.int64)), found["top"]

    @pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        values = ids.to_numpy()
        own = np.searchsorted(cuts, values)
        guest = (own < len(cuts)) & (cuts[np.minimum(own, len(cuts) - 1)] == values)
        out = []
        for i in range(len(values)):
            row = [own[i]]
            if guest[i]:
                row.append(-(own[i] + 1) - 1)
            if values[i] == top:
                row.append(-1)
            out.append(row)
        return pd.Series(out)

    dealt = docs.withColumn("_order", order).withColumn("_place", F.explode(places("_order")))
    dealt = dealt.select(
        "doc_id", "text", "_order", F.when(F.col("_place") < 0, -F.col("_place") - 1).otherwise(F.col("_place")).alias("_part"),
        (F.col("_place") < 0).alias("_guest"),
    )
    return dealt, number


def fingerprint_pairs(docs: DataFrame, samples: int = SAMPLES, seed: int = 6) -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likeness."""
    small_batches(docs.sparkSession)
    dealt, number = with_next(documents(docs))
    ready = dealt.repartition(number // 4, "_part").sortWithinPartitions("_part", "_guest", F.desc("_order"), "text")
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            ids, texts, guests = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist()
            prints = fingerprint_rows(texts, samples, seed)
            if held is not None:
                ids, texts, guests = [held[0], *ids], [held[1], *texts], [held[2], *guests]
                prints = np.concatenate([held[3], prints])
            held = (ids[-1], texts[-1], guests[-1], prints[-1:])
            own = [i for i in range(len(ids) - 1) if not guests[i]]
            edited = [edited_text(texts[i], texts[i + 1]) for i in own]
            changed = fingerprint_rows(edited, samples, seed)
            at = np.array(own, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in own], pa.int64()),
                    pa.array([len(texts[i]) for i in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                    pa.array([prints[i].tobytes().hex() for i in own], pa.string()),
                    pa.array([row.tobytes().hex() for row in changed], pa.string()),
                    pa.array((prints[at] == changed).mean(axis=1) if own else [], pa.float64()),
                    pa.array((prints[at] == prints[at + 1]).mean(axis=1) if own else [], pa.float64()),
                ],
                [f.split()[0] for f in schema.split(", ")],
            )

    return ready.mapInArrow(run, schema)
