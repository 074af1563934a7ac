"""Open contracting data: contracts, their award and the one supplier identity of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atalaya.errors import ContractError, GateError
from atalaya.functions.text import categorize_text, consortium_flag, role_contains
from atalaya.operators.quality import key_metrics

# --- fixed values -----------------------------------------------------------
BUYER_ROLES = ["buyer", "procuringEntity"]
MULTIPLE = "MULTISUPPLIER:"
DIGEST_LENGTH = 16
KEY_SEPARATOR = "::"
# ----------------------------------------------------------------------------


def require(df: DataFrame, columns: Sequence[str], name: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"{name} lacks columns {missing}")


def _with_optional(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else df


def dedupe_first(df: DataFrame, key: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One whole row per key: the first in the given order, by default of all other columns.

    An aggregate with map-side combine, so copies of a key never meet in one sort.
    """
    others = [c for c in df.columns if c not in key]
    ranked = list(order) if order is not None else others
    if not others:
        return df.distinct()
    ranked += [c for c in others if c not in ranked]
    # The rank holds all columns, so the row is read from it and not carried beside it.
    rank = F.struct(*[part for i, c in enumerate(ranked) for part in (F.col(c).isNull().alias(f"absent{i}"), F.col(c).alias(f"value{i}"))])
    kept = df.groupBy(*key).agg(F.min(rank).alias("_row"))
    return kept.select(*[F.col(c) if c in key else F.col(f"_row.value{ranked.index(c)}").alias(c) for c in df.columns])


def buyer_entities(parties: DataFrame) -> DataFrame:
    """Buying entities with contact data; absent columns are null."""
    wanted = {
        "id": "id_entidad", "name": "nombre_entidad", "address_streetAddress": "direccion",
        "contactPoint_telephone": "telefono", "address_department": "address_department",
    }
    complete = _with_optional(parties, [*wanted, "roles"])
    is_buyer = role_contains(F.col("roles"), BUYER_ROLES[0])
    for role in BUYER_ROLES[1:]:
        is_buyer = is_buyer | role_contains(F.col("roles"), role)
    return dedupe_first(complete.where(is_buyer).select(*wanted), ["id"]).withColumnsRenamed(wanted)


def supplier_enrichment(parties: DataFrame, awards_suppliers: DataFrame) -> DataFrame:
    """Catalogue of awarded suppliers; contact data comes from parties where present."""
    require(awards_suppliers, ["id", "name"], "awards_suppliers")
    awarded = dedupe_first(
        awards_suppliers.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id_proveedor"), "name"),
        ["id_proveedor"],
    )
    contact = _with_optional(parties, ["id", "identifier_id", "address_streetAddress", "contactPoint_telephone"])
    contact = dedupe_first(
        contact.where(F.col("id").isNotNull()).select(
            F.col("id").cast("string").alias("id_proveedor"),
            F.col("identifier_id").alias("ruc"),
            F.col("address_streetAddress").alias("direccion"),
            F.col("contactPoint_telephone").alias("telefono"),
        ),
        ["id_proveedor"],
    )
    return awarded.join(contact, "id_proveedor", "left").select(
        "id_proveedor",
        "ruc",
        F.col("name").alias("razon_social"),
        "direccion",
        "telefono",
        consortium_flag(F.col("name")).alias("es_consorcio"),
    )


def award_supplier_identity(awards_suppliers: DataFrame) -> DataFrame:
    """Exactly one supplier identity per award.

    A single supplier keeps its id. Several are named after a digest of their sorted
    ids. The suppliers of one award are what the digest is made of, so they meet in
    one row; they are made distinct before that.
    """
    require(awards_suppliers, ["main_ocid", "awards_id", "id", "name"], "awards_suppliers")
    award = ["main_ocid", "award_id"]
    listed = awards_suppliers.select(
        F.col("main_ocid").cast("string").alias("main_ocid"),
        F.col("awards_id").cast("string").alias("award_id"),
        F.col("id").cast("string").alias("supplier_id"),
        F.col("name").cast("string").alias("supplier_name"),
    ).dropna(subset=[*award, "supplier_id"])
    per_supplier = dedupe_first(listed, [*award, "supplier_id"])
    grouped = per_supplier.groupBy(*award).agg(
        F.array_sort(F.collect_set("supplier_id")).alias("_ids"),
        F.array_sort(F.collect_set("supplier_name")).alias("_names"),
    )
    several = F.size("_ids") > 1
    names = F.nullif(F.array_join("_names", " / "), F.lit(""))
    digest = F.substring(F.sha2(F.array_join("_ids", "|"), 256), 1, DIGEST_LENGTH)
    return grouped.select(
        *award,
        F.when(several, F.concat(F.lit(MULTIPLE), digest)).otherwise(F.col("_ids")[0]).alias("id_proveedor"),
        names.alias("razon_social_adjudicada"),
        (several | consortium_flag(names)).alias("es_consorcio"),
        F.when(several, F.size("_ids")).alias("n_integrantes_consorcio"),
        F.when(several, F.array_join("_ids", ";")).alias("integrantes_consorcio"),
    )


def composite_contract_id(ocid: Column, contract_id: Column) -> Column:
    """Contract key that is unique across processes."""
    return F.concat(ocid.cast("string"), F.lit(KEY_SEPARATOR), contract_id.cast("string"))


def require_unique(df: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """Gate before a many-to-one join: the right side has each key once."""
    if key_metrics(df, key).first()["claves_duplicadas"]:
        raise GateError(f"{name}: {list(key)} is not unique")
    return df


def ocds_contract_award_supplier(
    main: DataFrame, contracts: DataFrame, awards: DataFrame, awards_suppliers: DataFrame
) -> DataFrame:
    """All contracts with buyer, award and the supplier of their own award.

    An award or supplier that cannot be resolved stays null; nothing is borrowed from
    other awards of the process. The right sides are unique by construction.
    """
    require(main, ["ocid", "buyer_id"], "main")
    require(contracts, ["main_ocid", "id", "awardID", "value_amount", "dateSigned"], "contracts")
    require(awards, ["main_ocid", "id"], "awards")
    process_columns = ["buyer_id", "tender_procurementMethodDetails", "tender_mainProcurementCategory"]
    process = dedupe_first(
        _with_optional(main, process_columns).select(F.col("ocid").cast("string").alias("main_ocid"), *process_columns),
        ["main_ocid"],
    )
    known_awards = awards.select(
        F.col("main_ocid").cast("string").alias("main_ocid"), F.col("id").cast("string").alias("award_id")
    ).distinct()
    # One lookup per award: known awards with their supplier, if there is one.
    lookup = known_awards.join(award_supplier_identity(awards_suppliers), ["main_ocid", "award_id"], "left")
    facts = _with_optional(contracts, ["description"]).select(
        F.col("main_ocid").cast("string").alias("main_ocid"),
        F.col("id").cast("string").alias("id_contrato_fuente"),
        F.col("awardID").cast("string").alias("_award"),
        "value_amount",
        "dateSigned",
        "description",
    )
    resolved = facts.join(
        lookup.withColumnRenamed("main_ocid", "_ocid"),
        (F.col("main_ocid") == F.col("_ocid")) & (F.col("_award") == F.col("award_id")),
        "left",
    ).drop("_ocid", "_award")
    return resolved.join(process, "main_ocid", "left").select(
        composite_contract_id(F.col("main_ocid"), F.col("id_contrato_fuente")).alias("id_contrato"),
        "id_contrato_fuente",
        F.col("main_ocid").alias("ocid"),
        "award_id",
        "id_proveedor",
        "razon_social_adjudicada",
        "es_consorcio",
        "n_integrantes_consorcio",
        "integrantes_consorcio",
        F.col("buyer_id").alias("id_entidad"),
        F.col("tender_procurementMethodDetails").alias("modalidad"),
        F.col("tender_mainProcurementCategory").alias("categoria_principal"),
        F.col("description").alias("descripcion_contrato"),
        categorize_text(F.col("description")).alias("objeto"),
        F.col("value_amount").cast("string").try_cast("double").alias("monto"),
        F.col("dateSigned").cast("string").try_cast("timestamp").alias("fecha_contrato"),
    )


def unresolved_counts(resolved: DataFrame) -> DataFrame:
    """How many contracts have no award, and how many no supplier."""
    return resolved.agg(
        F.count(F.lit(1)).alias("contratos"),
        F.count_if(F.col("award_id").isNull()).alias("sin_adjudicacion"),
        F.count_if(F.col("id_proveedor").isNull()).alias("sin_proveedor"),
    )


def ocds_valid_contracts(resolved: DataFrame) -> DataFrame:
    """Contracts fit for analysis: complete, with a positive amount, one row per key."""
    complete = resolved.dropna(subset=["monto", "fecha_contrato", "id_entidad", "id_proveedor", "award_id"])
    return dedupe_first(complete.where(F.col("monto") > 0), ["id_contrato"])


def org_link_join(contracts: DataFrame, suppliers: DataFrame, entities: DataFrame) -> DataFrame:
    """Supplier-entity pairs that share a telephone or an address."""
    pairs = contracts.groupBy("id_proveedor", "id_entidad").agg(
        F.count("id_contrato").alias("n_contratos"), F.sum("monto").alias("monto_total")
    )
    of_supplier = suppliers.select("id_proveedor", F.trim("telefono").alias("_t1"), F.trim("direccion").alias("_d1"))
    of_entity = entities.select("id_entidad", F.trim("telefono").alias("_t2"), F.trim("direccion").alias("_d2"))
    same = {
        "comparte_telefono": F.coalesce(F.col("_t1") == F.col("_t2"), F.lit(False)),
        "comparte_direccion": F.coalesce(F.col("_d1") == F.col("_d2"), F.lit(False)),
    }
    joined = pairs.join(of_supplier, "id_proveedor", "left").join(of_entity, "id_entidad", "left").withColumns(same)
    return joined.drop("_t1", "_d1", "_t2", "_d2").withColumn(
        "senal_organizacional", F.col("comparte_telefono") | F.col("comparte_direccion")
    )
