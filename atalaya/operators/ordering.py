"""Ranks, running totals and exact quantiles without one task per group.

`percentile`, `median` and `row_number` over a large group hold or sort the group
in one task. Here a double is a whole number of 64 bits in the same order, and is read in three parts of
about 21 bits. The counts of all values of one part, under the parts before it, are at most four million
rows, however dense the values lie; only those are put in order together. Ranks that are wanted
are followed from part to part, so the rest is left out early. Results are the exact ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atalaya.runtime import materialize

#: Bits that lie below the first and below the second of the three parts of a value.
PART_SHIFTS = (43, 22)
HASH_PREFIX = 4  # hexadecimal digits of an md5: 65,536 even slices
_ROW_BITS = 33  # low bits of monotonically_increasing_id that count rows


def ordered_bits(value: Column) -> Column:
    """A whole number in the order of a double: its bits, those below the sign turned round for negative values."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def _match(left: str, right: str, columns: Sequence[str]) -> Column:
    return reduce(and_, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def value_counts(
    df: DataFrame, value: str, groups: Sequence[str] = (), counts: dict[str, Column] | None = None
) -> DataFrame:
    """One row per group and distinct value with its counts and the leading parts of its bits."""
    counts = counts or {"n": F.count(F.lit(1))}
    counted = (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .select(*groups, F.col(value).cast("double").alias("value"), *[
            c for c in df.columns if c not in {*groups, value}
        ])
        .groupBy(*groups, "value")
        .agg(*[expr.alias(name) for name, expr in counts.items()])
    )
    bits = counted.withColumn("_bits", ordered_bits(F.col("value")))
    return bits.withColumns({f"_part{i}": F.shiftright("_bits", shift) for i, shift in enumerate(PART_SHIFTS)}).drop("_bits")


def running_counts(
    counted: DataFrame,
    groups: Sequence[str] = (),
    columns: Sequence[str] = ("n",),
    wanted: Callable[[Column, Column, Column], Column] | None = None,
) -> DataFrame:
    """Adds to each distinct value the counts of all smaller values (`<c>_before`) and of all values (`<c>_total`).

    `wanted(first, last, total)` says of ranks (from 0, by the first of the columns) whether they are asked for; other
    values may be left out.
    """
    groups, sums = list(groups), lambda cs: [F.sum(c).alias(c) for c in cs]
    keys = ["_part0", "_part1", "value"]
    second = counted.groupBy(*groups, *keys[:2]).agg(*sums(columns))
    levels = [second.groupBy(*groups, keys[0]).agg(*sums(columns)), second, counted]
    whole = Window.partitionBy(*groups)
    known = None
    for i, (level, key) in enumerate(zip(levels, keys)):
        if known is None:
            rows = level.withColumns({f"{c}_total": F.sum(c).over(whole) for c in columns}).withColumns({f"_{c}_lower": F.lit(0) for c in columns})
            inside = whole
        else:
            parent = keys[i - 1]
            rows = level.alias("v").join(known.alias("o"), _match("v", "o", [*groups, parent]), "inner").select(
                *[F.col(f"v.{c}") for c in level.columns], *[F.col(f"o.{name}") for c in columns for name in (f"{c}_total", f"_{c}_lower")]
            )
            inside = Window.partitionBy(*groups, parent)
        before = inside.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns({f"{c}_before": F.col(f"_{c}_lower") + F.coalesce(F.sum(c).over(before), F.lit(0)) for c in columns})
        if wanted is not None:
            c = columns[0]
            rows = rows.where(wanted(F.col(f"{c}_before"), F.col(f"{c}_before") + F.col(c) - 1, F.col(f"{c}_total")))
        known = rows.select(*groups, key, *[F.col(f"{c}_total") for c in columns], *[F.col(f"{c}_before").alias(f"_{c}_lower") for c in columns])
    return rows.select(*groups, "value", *columns, *[f"{c}_before" for c in columns], *[f"{c}_total" for c in columns])


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    groups: Sequence[str] = (),
    *,
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per named probability.

    Null values are left out. A group without values gives no row; without groups
    an input without values gives no row. With a `weight` column each row stands for
    that many equal values.
    """
    groups = list(groups)
    total = F.col("n_total")
    ranks = {}
    for name, p in probabilities.items():
        position = (total - 1) * F.lit(float(p))
        ranks[name] = (position, F.floor(position), F.ceil(position))

    number = F.count(F.lit(1)) if weight is None else F.sum(weight)
    used = df.select(*groups, value, *([] if weight is None else [weight]))

    def wanted(first: Column, last: Column, total: Column) -> Column:
        asked = [edge((total - 1) * F.lit(float(p))) for p in probabilities.values() for edge in (F.floor, F.ceil)]
        return reduce(or_, [(first <= rank) & (rank <= last) for rank in asked])

    ordered = running_counts(value_counts(used, value, groups, {"n": number}), groups, wanted=wanted)

    def at(rank: Column) -> Column:
        start = F.col("n_before")
        return F.max(F.when((start <= rank) & (rank < start + F.col("n")), F.col("value")))

    picked = ordered.groupBy(*groups).agg(
        F.max("n_total").alias("n_total"),
        *[at(low).alias(f"{name}__low") for name, (_, low, _) in ranks.items()],
        *[at(high).alias(f"{name}__high") for name, (_, _, high) in ranks.items()],
    ).where(F.col("n_total").isNotNull())
    return picked.select(
        *groups,
        *[
            (
                F.col(f"{name}__low")
                + (F.col(f"{name}__high") - F.col(f"{name}__low")) * (position - low)
            ).alias(name)
            for name, (position, low, _) in ranks.items()
        ],
    )


def approximate_quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    groups: Sequence[str] = (),
    *,
    weight: str | None = None,
    accuracy: int = 10_000,
) -> DataFrame:
    """Same columns from one bounded sketch per group; each value is an observed one.

    Sketches know no weights: with a `weight` column the values are the observed ones at the
    exact ranks, from the counts.
    """
    if weight is not None:
        return _observed_quantiles(df, value, probabilities, list(groups), weight)
    usable = df.where(F.col(value).isNotNull())
    columns = [
        F.percentile_approx(F.col(value).cast("double"), float(p), accuracy).alias(name)
        for name, p in probabilities.items()
    ]
    result = usable.groupBy(*groups).agg(*columns)
    first = next(iter(probabilities))
    return result if groups else result.where(F.col(first).isNotNull())


def _observed_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], groups: list[str], weight: str
) -> DataFrame:
    """Smallest value whose running weight reaches each share of the total."""
    ordered = running_counts(value_counts(df.select(*groups, value, weight), value, groups, {"n": F.sum(weight)}), groups)
    upto = F.col("n_before") + F.col("n")
    reached = [F.min(F.when(upto >= F.col("n_total") * F.lit(float(p)), F.col("value"))).alias(name) for name, p in probabilities.items()]
    result = ordered.groupBy(*groups).agg(*reached)
    return result if groups else result.where(F.col(next(iter(probabilities))).isNotNull())


def hash_row_number(
    df: DataFrame, partition: Sequence[str], hash_column: str, ties: Sequence[str], name: str
) -> DataFrame:
    """`row_number()` per partition in the order of an md5 text, starting at 0.

    The first hexadecimal digits split each partition into even buckets.
    """
    keys = [*partition, "_slice"]
    sliced = df.withColumn("_slice", F.substring(hash_column, 1, HASH_PREFIX))
    lower = Window.partitionBy(*partition).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*[F.col(f"r.{k}") for k in keys]).orderBy(
        *[F.col(f"r.{c}") for c in [hash_column, *ties]]
    )
    return (
        sliced.alias("r")
        .join(starts.alias("s"), _match("r", "s", keys), "inner")
        .select(
            *[F.col(f"r.{c}") for c in df.columns],
            (F.col("s._start") + F.row_number().over(inside) - 1).alias(name),
        )
    )


def global_row_number(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """`row_number()` over the whole input, starting at 1, from a distributed sort.

    Rows are range-partitioned and sorted, then written once with their place in
    the partition. The rows in earlier partitions come from one count per partition.
    """
    placed = materialize(
        df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "sorted"
    )
    part = F.shiftright("_place", _ROW_BITS)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    row = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # One row per sort partition: the number of shuffle partitions bounds this side.
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part", "inner")
        .select(*df.columns, (F.col("_start") + row + 1).alias(name))
    )


def quantile_edges(bins: int) -> dict[str, float]:
    """Names and probabilities of the inner edges of `bins` equal-share bins."""
    if bins < 2 or not math.isfinite(bins):
        raise ValueError("bins must be at least 2")
    return {f"edge_{i}": i / bins for i in range(1, bins)}
