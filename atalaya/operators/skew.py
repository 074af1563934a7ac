"""Lookup joins that split hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atalaya.runtime import discard, materialize

ROWS_PER_SPLIT = 2_000_000
#: Rows of a key that one task may hold, and the share of rows that tells which keys have more.
ROWS_IN_TASK, SEEN_ONE_IN = 500_000, 64


def same_key(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equality of key columns in which null equals null."""
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def hot_keys(
    counts: DataFrame, on: Sequence[str], count_column: str, rows_per_split: int = ROWS_PER_SPLIT
) -> DataFrame:
    """Keys with more than `rows_per_split` rows and into how many parts to split them.

    Each of them stands for that many rows, so there are few; the optimiser decides how to join them.
    """
    splits = F.ceil(F.col(count_column) / F.lit(rows_per_split)).cast("int")
    return counts.where(F.col(count_column) > rows_per_split).select(*on, splits.alias("_splits"))


def crowded_keys(df: DataFrame, on: Sequence[str], seen_one_in: int = SEEN_ONE_IN, rows_in_task: int = ROWS_IN_TASK) -> DataFrame | None:
    """Keys with more rows than one task may hold, as a small table, or None; by the counts in a share of all rows.

    A caller must get the same results for a key on either side, so the share decides about tasks only.
    """
    counts = df.select(*on).sample(1 / seen_one_in, 7).groupBy(*on).agg(F.count(F.lit(1)).alias("_seen"))
    found = materialize(counts.where(F.col("_seen") * seen_one_in > rows_in_task).select(*on), "crowded")
    if not found.isEmpty():
        return found
    discard(found)
    return None


def divide(df: DataFrame, on: Sequence[str], keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the given keys, and all other rows; null keys are keys."""
    renamed = {c: f"_crowded_{c}" for c in on}
    same = same_key(list(on), list(renamed.values()))
    return tuple(df.join(keys.withColumnsRenamed(renamed), same, how) for how in ("left_semi", "left_anti"))


def _with_splits(df: DataFrame, on: Sequence[str], hot: DataFrame) -> DataFrame:
    renamed = {c: f"_hot_{c}" for c in on}
    joined = df.join(
        hot.withColumnsRenamed(renamed), same_key(list(on), list(renamed.values())), "left"
    )
    return joined.drop(*renamed.values()).withColumn("_splits", F.coalesce("_splits", F.lit(1)).cast("bigint"))


def salt_rows(facts: DataFrame, on: Sequence[str], hot: DataFrame) -> DataFrame:
    """Adds `_salt`: which part of its key a row belongs to, by a hash of the row."""
    spread = [c for c in facts.columns if c not in on] or list(on)
    part = F.when(F.col("_splits") > 1, F.pmod(F.xxhash64(*spread), F.col("_splits"))).otherwise(0)
    return _with_splits(facts, on, hot).withColumn("_salt", part.cast("bigint")).drop("_splits")


def repeat_rows(lookup: DataFrame, on: Sequence[str], hot: DataFrame) -> DataFrame:
    """Repeats the row of each split key once per part, with its `_salt`."""
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_splits") - 1))
    return _with_splits(lookup, on, hot).withColumn("_salt", parts).drop("_splits")


def join_salted(salted: DataFrame, repeated: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of salted facts with repeated lookup rows; the salt is dropped."""
    keys = [*on, "_salt"]
    renamed = {c: f"_lookup_{c}" for c in keys}
    joined = salted.join(
        repeated.withColumnsRenamed(renamed), same_key(keys, list(renamed.values())), how
    )
    return joined.drop("_salt", *renamed.values())


def hot_split_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    counts: DataFrame,
    count_column: str,
    how: str = "inner",
    *,
    rows_per_split: int = ROWS_PER_SPLIT,
    total_rows: int | None = None,
) -> DataFrame:
    """Join facts to a lookup that is unique on `on`, with frequent keys split.

    `counts` has the number of fact rows per key. When the facts have `total_rows` and
    those fit one part, no key can be too frequent. Without frequent keys the join is a plain one.
    """
    on = list(on)
    hot = None
    if total_rows is None or total_rows > rows_per_split:
        # Written first: a plan over all counts would shuffle every fact, with all its columns, to look for its key among them.
        hot = materialize(hot_keys(counts, on, count_column, rows_per_split), "hot")
        if hot.isEmpty():
            discard(hot)
            hot = None
    if hot is None:
        renamed = {c: f"_lookup_{c}" for c in on}
        joined = facts.join(lookup.withColumnsRenamed(renamed), same_key(on, list(renamed.values())), how)
        return joined.drop(*renamed.values())
    return join_salted(salt_rows(facts, on, hot), repeat_rows(lookup, on, hot), on, how)
