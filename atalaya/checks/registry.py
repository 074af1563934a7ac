"""The list of checked queries: a Spark function and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atalaya.checks.proxies import Tables, with_views
from atalaya.runtime import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def check(name: str, query: str | None = None, views: str = "") -> Callable:
    """Register a function of `Tables` under a name, with its SQL over the named views."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(tune(spark), folder))

        run.__name__ = name
        QUERIES[name] = run
        if query is not None:
            SQL[name] = with_views(views, query) if views else query
        return build

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def day(df: DataFrame, *columns: str) -> DataFrame:
    """Dates as text, equal in any engine."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns})
