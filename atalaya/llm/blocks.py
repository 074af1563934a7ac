"""Comparing the open members of groups with all members, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_open(
    members: DataFrame, group: str, name: str, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
    *, block: int, chunk: int, rows: int,
) -> DataFrame:
    """`compare(open, members)` over blocks that bring each open member of a group to all its members.

    `members` has a boolean column `open`. A block holds at most about `block` open members and
    `chunk` members; small groups share a block, so `compare` must look at the group column. `rows` is
    the number of members, for the number of shared blocks.
    """
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("_size"), F.sum(F.col("open").cast("long")).alias("_open"))
    small = (F.col("_size") <= chunk) & (F.col("_open") <= block)
    shared = F.pmod(F.xxhash64(group), F.lit(max(1, rows // chunk)))
    shape = sizes.where(F.col("_open") > 0).select(
        group, small.alias("_small"), F.when(small, shared).otherwise(F.xxhash64(group)).alias("_place"),
        F.when(small, 1).otherwise(F.ceil(F.col("_open") / block)).cast("long").alias("_blocks"),
        F.when(small, 1).otherwise(F.ceil(F.col("_size") / chunk)).cast("long").alias("_chunks"),
    )
    dealt = members.join(shape, group)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64(name), F.col(n))
    columns = [*members.columns, "_small", "_place"]
    left = dealt.where("open").select(*columns, own("_blocks").alias("_block"), every("_chunks").alias("_chunk"), F.lit(False).alias("_member"))
    right = dealt.select(*columns, every("_blocks").alias("_block"), own("_chunks").alias("_chunk"), F.lit(True).alias("_member"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return compare(part[~part["_member"]], part[part["_member"]])

    return left.unionByName(right).groupBy("_small", "_place", "_block", "_chunk").applyInPandas(run, schema)
