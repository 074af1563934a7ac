"""The canonical contract: five domains, mapping onto them, typed casts and their report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atalaya.errors import ContractError
from atalaya.functions.amounts import cast_boolean

CONTRACT_VERSION = 1
MODES = ("inference", "training")
_TYPES = {
    "string": T.StringType(),
    "number": T.DoubleType(),
    "datetime": T.TimestampType(),
    "boolean": T.BooleanType(),
}

# --- fixed values: (column, kind, presence) of each domain; presence is key (required,
# no nulls), required, optional, or label (required without nulls in training) ---
_FIELDS = {
    "contracts": [
        ("id_contrato", "string", "key"),
        ("id_proveedor", "string", "key"),
        ("id_entidad", "string", "key"),
        ("id_funcionario", "string", "optional"),
        ("monto", "number", "required"),
        ("fecha_contrato", "datetime", "key"),
        ("modalidad", "string", "required"),
        ("objeto", "string", "required"),
        ("categoria_principal", "string", "required"),
        ("fecha_actualizacion", "datetime", "optional"),
        ("label_favoritismo", "boolean", "label"),
        ("label_fraccionamiento", "boolean", "label"),
    ],
    "suppliers": [
        ("id_proveedor", "string", "key"),
        ("nombre_proveedor", "string", "optional"),
        ("ruc", "string", "optional"),
    ],
    "entities": [
        ("id_entidad", "string", "key"),
        ("nombre_entidad", "string", "optional"),
    ],
    "officials": [
        ("id_funcionario", "string", "key"),
        ("id_entidad", "string", "optional"),
        ("nombre_funcionario", "string", "optional"),
        ("email", "string", "optional"),
        ("telefono", "string", "optional"),
    ],
    "payments": [
        ("id_pago", "string", "key"),
        ("id_contrato", "string", "key"),
        ("fecha_devengado", "datetime", "optional"),
        ("fecha_girado", "datetime", "optional"),
        ("fecha_pagado", "datetime", "optional"),
        ("monto_devengado", "number", "optional"),
        ("monto_pagado", "number", "optional"),
        ("estado", "string", "optional"),
    ],
}
PRIMARY_KEYS = {
    "contracts": ["id_contrato"],
    "suppliers": ["id_proveedor"],
    "entities": ["id_entidad"],
    "officials": ["id_funcionario"],
    "payments": ["id_pago"],
}
FOREIGN_KEYS = [
    ("contracts", "id_proveedor", "suppliers", "id_proveedor"),
    ("contracts", "id_entidad", "entities", "id_entidad"),
    ("contracts", "id_funcionario", "officials", "id_funcionario"),
    ("payments", "id_contrato", "contracts", "id_contrato"),
]
ID_COLUMNS = ["id_contrato", "id_proveedor", "id_entidad", "id_funcionario", "id_pago"]
LABELS = ["label_favoritismo", "label_fraccionamiento"]
# ------------------------------------------------------------------------------


def _required_in(presence: str) -> list[str]:
    return {"key": list(MODES), "required": list(MODES), "label": ["training"]}.get(presence, [])


def _field(name: str, kind: str, presence: str) -> T.StructField:
    about = {"kind": kind, "required_in": _required_in(presence), "nullable": presence not in ("key", "label")}
    return T.StructField(name, _TYPES[kind], True, about)


DOMAINS: dict[str, T.StructType] = {
    domain: T.StructType([_field(*field) for field in fields]) for domain, fields in _FIELDS.items()
}


def domain_schema(domain: str) -> T.StructType:
    if domain not in DOMAINS:
        raise ContractError(f"unknown domain {domain!r}; known: {sorted(DOMAINS)}")
    return DOMAINS[domain]


def required_columns(domain: str, mode: str, *, without_nulls: bool = False) -> list[str]:
    """Columns that `mode` requires, optionally only those that may hold no null."""
    if mode not in MODES:
        raise ContractError(f"mode must be one of {MODES}: {mode!r}")
    return [
        field.name
        for field in domain_schema(domain)
        if mode in field.metadata["required_in"] and not (without_nulls and field.metadata["nullable"])
    ]


def map_canonical(df: DataFrame, domain: str, mapping: dict[str, str]) -> DataFrame:
    """Select the mapped physical columns under their canonical names; the rest is dropped."""
    schema = domain_schema(domain)
    if not isinstance(mapping, dict) or not mapping:
        raise ContractError(f"mapping of {domain!r} is empty")
    physical = list(mapping.values())
    problems = {
        "unknown canonical columns": sorted(set(mapping) - set(schema.names)),
        "physical columns used more than once": sorted({p for p in physical if physical.count(p) > 1}),
        "physical columns absent from the source": sorted(set(physical) - set(df.columns)),
    }
    for problem, columns in problems.items():
        if columns:
            raise ContractError(f"{domain}: {problem}: {columns}")
    return df.select(*[F.col(f"`{source}`").alias(target) for target, source in mapping.items()])


def typed_value(raw: Column, field: T.StructField) -> Column:
    """Cast of one column; null for a value that does not fit its kind."""
    kind = field.metadata["kind"]
    if kind == "boolean":
        return cast_boolean(raw)
    return raw.cast(field.dataType) if kind == "string" else raw.try_cast(field.dataType)


@dataclass(frozen=True)
class TypedDomain:
    """A domain with typed columns, and the raw rows its markers look at."""

    domain: str
    mode: str
    raw: DataFrame
    data: DataFrame

    def markers(self) -> dict[str, Column]:
        """Per-row flags over `raw`: `invalid:<column>` and `null:<column>`."""
        strict = set(required_columns(self.domain, self.mode, without_nulls=True))
        flags: dict[str, Column] = {}
        for field in DOMAINS[self.domain]:
            if field.name not in self.raw.columns:
                continue
            raw = F.col(field.name)
            value = typed_value(raw, field)
            if field.metadata["kind"] != "string":
                flags[f"invalid:{field.name}"] = raw.isNotNull() & value.isNull()
            if field.name in strict:
                flags[f"null:{field.name}"] = value.isNull()
        return flags

    def flagged(self) -> tuple[DataFrame, dict[str, Column]]:
        """Typed rows with one column per marker, and the markers as references to them."""
        markers = self.markers()
        columns = {f"_marker_{i}": name for i, name in enumerate(markers)}
        schema = DOMAINS[self.domain]
        rows = self.raw.select(
            *[typed_value(F.col(c), schema[c]).alias(c) for c in self.raw.columns],
            *[markers[name].alias(column) for column, name in columns.items()],
        )
        return rows, {name: F.col(column) for column, name in columns.items()}


def cast_canonical(df: DataFrame, domain: str, mode: str = "inference") -> TypedDomain:
    """Typed columns of a mapped domain. No job runs; see `contract_report`."""
    schema = domain_schema(domain)
    missing = sorted(set(required_columns(domain, mode)) - set(df.columns))
    if missing:
        raise ContractError(f"{domain} ({mode}): missing columns {missing}")
    unknown = sorted(set(df.columns) - set(schema.names))
    if unknown:
        raise ContractError(f"{domain}: columns outside the contract {unknown}")
    typed = df.select(*[typed_value(F.col(c), schema[c]).alias(c) for c in df.columns])
    return TypedDomain(domain, mode, df, typed)


def count_flag(flag: Column) -> Column:
    return F.sum(F.when(flag, 1).otherwise(0))


def long_counts(one_row: DataFrame, names: dict[str, str]) -> DataFrame:
    """Turn one row of counts into rows (rule, columna, n); `names` maps column to rule:column."""
    entries = F.array(*[
        F.struct(
            F.lit(name.split(":", 1)[0]).alias("regla"),
            F.lit(name.split(":", 1)[1]).alias("columna"),
            F.coalesce(F.col(column), F.lit(0)).cast("bigint").alias("n"),
        )
        for column, name in names.items()
    ])
    return one_row.select(F.inline(entries))


def contract_report(typed: TypedDomain, rules: tuple[str, ...] = ("invalid", "null")) -> DataFrame:
    """Counts of invalid values and forbidden nulls, all from one aggregate."""
    flags = {k: v for k, v in typed.markers().items() if k.split(":")[0] in rules}
    names = {f"c{i}": name for i, name in enumerate(flags)}
    counted = typed.raw.agg(*[count_flag(flags[name]).alias(column) for column, name in names.items()])
    return long_counts(counted, names)


def null_contract(df: DataFrame, domain: str, mode: str = "inference") -> DataFrame:
    """Null counts of the columns that may hold none."""
    return contract_report(cast_canonical(df, domain, mode), ("null",))


def raise_on_contract(domain: str, mode: str, counts: dict[str, int]) -> None:
    """Fail on any counted `invalid:` or `null:` marker."""
    for rule, text in (("invalid", "invalid values"), ("null", "nulls where none are allowed")):
        found = {
            name.split(":", 1)[1]: n for name, n in counts.items() if name.startswith(f"{rule}:") and n
        }
        if found:
            raise ContractError(f"{domain} ({mode}): {text} {found}")


def validate(df: DataFrame, domain: str, mode: str = "inference") -> DataFrame:
    """Typed domain after its contract report came back clean (one job)."""
    typed = cast_canonical(df, domain, mode)
    counts = {f"{r['regla']}:{r['columna']}": r["n"] for r in contract_report(typed).collect()}
    raise_on_contract(domain, mode, counts)
    return typed.data
