"""Preprocessing that is learned on training data and applied frozen at scoring time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya.errors import ContractError
from atalaya.functions.amounts import cap_amount, modality_flags
from atalaya.operators.ordering import approximate_quantiles, exact_quantiles
from atalaya.runtime import discard, materialize, new_location

# --- fixed values -----------------------------------------------------------
STATE_VERSION = 1
NO_OFFICIAL = "__NO_DISPONIBLE__"
EXACT, APPROXIMATE = "exact", "percentile_approx_accuracy_10000"
# ----------------------------------------------------------------------------

#: Values of a column that get columns of their own at most, and the name of the column of all others.
MOST_VALUES, OTHER_VALUES = 100, "otros"
MEDIANS_SCHEMA = "objeto string, monto_mediana double"
#: Parts of each object in the join of rows with object medians.
PARTS = 4


def _quantiles(exact: bool):
    return exact_quantiles if exact else approximate_quantiles


def object_medians(df: DataFrame, exact: bool = True) -> DataFrame:
    """Median amount per object and the number of rows it holds for, nulls left out."""
    typed = df.select(F.col("objeto").cast("string").alias("objeto"), F.col("monto").cast("double").alias("monto"))
    usable = typed.where(F.col("objeto").isNotNull())
    return _quantiles(exact)(usable, "monto", {"monto_mediana": 0.5}, ["objeto"])


def join_medians(df: DataFrame, medians: DataFrame) -> DataFrame:
    """Adds `mediana_objeto`. Only rows without an amount ever look a median up.

    Whether the table is broadcast is left to the optimiser, which knows its bytes. In a join by shuffle,
    rows that need no median are spread over keys that match nothing, and each object is cut into `PARTS`.
    """
    part = F.pmod(F.xxhash64(*df.columns), F.lit(PARTS)) if df.columns else F.lit(0)
    table = medians.select(
        F.col("objeto").cast("string").alias("_objeto"), F.col("monto_mediana").cast("double").alias("mediana_objeto"),
        F.explode(F.array(*[F.lit(i).cast("long") for i in range(PARTS)])).alias("_of"),
    )
    needs = F.col("monto").isNull() & F.col("objeto").isNotNull()
    keyed = df.withColumns({
        "_key": F.when(needs, F.col("objeto").cast("string")).otherwise(F.xxhash64(*df.columns).cast("string")),
        # A part below zero has no partner.
        "_part": F.when(needs, part).otherwise(-1),
    })
    return keyed.join(table, (F.col("_key") == F.col("_objeto")) & (F.col("_part") == F.col("_of")), "left").drop(
        "_key", "_part", "_objeto", "_of"
    )


def counted_values(df: DataFrame) -> DataFrame:
    """Rows per object, amount and modality: all that fitting needs, from one read of the rows."""
    typed = df.select(
        F.col("objeto").cast("string").alias("objeto"), F.col("monto").cast("double").alias("monto"),
        F.col("modalidad").cast("string").alias("modalidad") if "modalidad" in df.columns else F.lit(None).cast("string").alias("modalidad"),
    )
    return typed.groupBy("objeto", "monto", "modalidad").agg(F.count(F.lit(1)).alias("n"))


def counted_medians(counted: DataFrame, exact: bool = True) -> DataFrame:
    usable = counted.where(F.col("objeto").isNotNull())
    return _quantiles(exact)(usable, "monto", {"monto_mediana": 0.5}, ["objeto"], weight="n")


def imputed_amounts(counted: DataFrame, medians: DataFrame) -> DataFrame:
    """Distinct amounts with their row counts, after nulls took the median of their object.

    Rows that still have no amount are counted under null.
    """
    filled = join_medians(counted, medians).select(F.coalesce("monto", "mediana_objeto").alias("monto"), "n")
    return filled.groupBy("monto").agg(F.sum("n").alias("n"))


def global_median(df: DataFrame, medians: DataFrame, exact: bool = True) -> DataFrame:
    """Median of the amounts after nulls took the median of their object."""
    return _overall_median(imputed_amounts(counted_values(df), medians), exact)


def _overall_median(amounts: DataFrame, exact: bool) -> DataFrame:
    return _quantiles(exact)(amounts, "monto", {"mediana_global": 0.5}, weight="n")


def amount_p99(df: DataFrame, medians: DataFrame, overall: float, exact: bool = True) -> DataFrame:
    """99th percentile of the amounts after both imputations."""
    return _p99(imputed_amounts(counted_values(df), medians), overall, exact)


def _p99(amounts: DataFrame, overall: float, exact: bool) -> DataFrame:
    filled = amounts.fillna({"monto": float(overall)})
    return _quantiles(exact)(filled, "monto", {"monto_p99": 0.99}, weight="n")


def mode_values(df: DataFrame, columns: list[str], *, weight: str | None = None) -> DataFrame:
    """Most frequent value of each column, ties to the smallest text (one pass for all).

    A column without values gives no row. With a `weight` column each row stands for that many rows.
    """
    number = F.lit(1).cast("long") if weight is None else F.col(weight)
    pairs = F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).cast("string").alias("valor")) for c in columns])
    counted = (
        df.select(F.inline(pairs), number.alias("_n"))
        .where(F.col("valor").isNotNull())
        .groupBy("campo", "valor")
        .agg(F.sum("_n").alias("n"))
    )
    return counted.groupBy("campo").agg(
        F.min_by("valor", F.struct(-F.col("n"), F.col("valor"))).alias("valor"), F.max("n").alias("n")
    )


def mode_value(df: DataFrame, column: str) -> DataFrame:
    return mode_values(df, [column])


def fit_preprocessor(df: DataFrame, *, medians_path: str | None = None, exact: bool = True) -> dict:
    """Learn medians, modes and the cap from training rows; returns the versioned state.

    The object medians are a Parquet table: at `medians_path`, or in the shared folder. The
    rows are read once, to count (object, amount, modality); every statistic comes from these counts.
    """
    missing = sorted({"monto", "objeto", "modalidad"} - set(df.columns))
    if missing:
        raise ContractError(f"fitting needs columns {missing}")
    spark = df.sparkSession
    counted = materialize(counted_values(df), "counted")
    location = medians_path or new_location(spark, "medians")
    counted_medians(counted, exact).write.mode("overwrite").parquet(location)
    medians = spark.read.schema(MEDIANS_SCHEMA).parquet(location)
    amounts = materialize(imputed_amounts(counted, medians), "amounts")
    middle = _overall_median(amounts, exact).first()
    if middle is None:
        raise ContractError("fitting needs at least one valid amount")
    overall = float(middle["mediana_global"])
    cap = _p99(amounts, overall, exact).first()["monto_p99"]
    modes = {r["campo"]: r["valor"] for r in mode_values(counted, ["modalidad", "objeto"], weight="n").collect()}
    discard(amounts)
    discard(counted)
    for column in ("modalidad", "objeto"):
        if column not in modes:
            raise ContractError(f"fitting needs at least one value of {column}")
    return {
        "schema_version": STATE_VERSION,
        "fit_engine": "spark",
        "quantile_method": EXACT if exact else APPROXIMATE,
        "monto_mediana_por_objeto": {},
        "monto_mediana_por_objeto_external": True,
        "monto_mediana_por_objeto_location": location,
        "monto_mediana_global": overall,
        "modalidad_moda": modes["modalidad"],
        "objeto_moda": modes["objeto"],
        "monto_p99": float(cap),
        "object_medians_count": medians.count(),
    }


def _state_medians(df: DataFrame, state: dict, medians: DataFrame | None) -> DataFrame:
    if state.get("monto_mediana_por_objeto_external", False):
        location = state.get("monto_mediana_por_objeto_location")
        if medians is None and location is None:
            raise ContractError("the state keeps its object medians in a table, and none was given")
        if medians is None:
            medians = df.sparkSession.read.schema(MEDIANS_SCHEMA).parquet(location)
        missing = sorted({"objeto", "monto_mediana"} - set(medians.columns))
        if missing:
            raise ContractError(f"the table of object medians lacks {missing}")
        return medians
    # A state that another program wrote may carry its medians itself.
    rows = [(str(k), float(v)) for k, v in state.get("monto_mediana_por_objeto", {}).items()]
    return df.sparkSession.createDataFrame(rows, MEDIANS_SCHEMA)


def apply_preprocessor(df: DataFrame, state: dict, medians: DataFrame | None = None) -> DataFrame:
    """Fill and cap with frozen statistics. Nothing is learned from `df`.

    An observed amount always wins, then the median of its object, then the overall
    median.
    """
    if state.get("schema_version") != STATE_VERSION:
        raise ContractError(f"state version {state.get('schema_version')!r} is not {STATE_VERSION}")
    table = _state_medians(df, state, medians)
    joined = join_medians(df, table)
    official = F.col("id_funcionario").cast("string") if "id_funcionario" in df.columns else F.lit(None).cast("string")
    filled = joined.withColumns(
        {
            "monto": F.coalesce(
                F.col("monto").cast("double"), "mediana_objeto", F.lit(float(state["monto_mediana_global"]))
            ),
            "modalidad": F.coalesce(F.col("modalidad").cast("string"), F.lit(state["modalidad_moda"])),
            "objeto": F.coalesce(F.col("objeto").cast("string"), F.lit(state["objeto_moda"])),
            "id_funcionario": F.coalesce(official, F.lit(NO_OFFICIAL)),
        }
    ).drop("mediana_objeto")
    return filled.withColumns(
        {"monto_capped": cap_amount(F.col("monto"), state["monto_p99"]), **modality_flags(F.col("modalidad"))}
    )


def impute_in_batch(df: DataFrame) -> DataFrame:
    """Exploration only: fill and cap a batch with its own statistics.

    Here the overall median is that of the amounts after the fill by object.
    """
    return apply_preprocessor(df, fit_preprocessor(df)).select(*df.columns, "monto_capped")


def standardize_column(df: DataFrame, column: str, output: str, *, sample: bool = False) -> DataFrame:
    """Zero mean and unit variance, by population or sample deviation."""
    deviation = F.stddev_samp(column) if sample else F.stddev_pop(column)
    stats = df.agg(F.avg(column).alias("mean"), deviation.alias("sd")).first()
    scale = stats["sd"] if stats["sd"] else 1.0
    return df.withColumn(output, (F.col(column) - F.lit(stats["mean"])) / F.lit(scale))


def one_hot_values(df: DataFrame, column: str, most: int = MOST_VALUES) -> list[str]:
    """The `most` most frequent values of a column, ties by text, in order of the text; part of a frozen state."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return sorted(r["v"] for r in counted.orderBy(F.desc("n"), "v").limit(most).collect())


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """One 0/1 column per given value and one for all other values; a null has zeros everywhere.

    The values come from a frozen state (`one_hot_values`), so every batch gets the same columns.
    """
    own = F.col(column).cast("string")
    coded = {f"{column}_{v}": F.coalesce((own == v).cast("double"), F.lit(0.0)) for v in values}
    other = F.coalesce((~own.isin(*values)).cast("double"), F.lit(0.0))
    return df.withColumns({**coded, f"{column}_{OTHER_VALUES}": other})
