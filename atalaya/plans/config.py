"""Job configuration: where domains live and how they map onto the contract."""

from __future__ import annotations

import json
from pathlib import Path

from atalaya.errors import ContractError
from atalaya.operators.contract import CONTRACT_VERSION, DOMAINS, MODES, required_columns
from atalaya.sources.readers import SOURCE_TYPES


def load_config(path: str | Path) -> dict:
    """Read a JSON or YAML configuration and check it."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        config = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as missing:
            raise ContractError("a YAML configuration needs PyYAML; JSON always works") from missing
        config = yaml.safe_load(text)
    return check_config(config)


def _texts(value: object) -> bool:
    return isinstance(value, dict) and bool(value) and all(
        isinstance(k, str) and isinstance(v, str) and k.strip() and v.strip() for k, v in value.items()
    )


def check_config(config: dict) -> dict:
    """Refuse a configuration that could only fail later, at the first read."""
    if not isinstance(config, dict):
        raise ContractError("the configuration must be an object")
    version = config.get("contract_schema_version", CONTRACT_VERSION)
    if type(version) is not int or version != CONTRACT_VERSION:
        raise ContractError(f"contract version {version!r} is not {CONTRACT_VERSION}")
    mode = config.get("mode", "inference")
    if mode not in MODES:
        raise ContractError(f"mode must be one of {MODES}: {mode!r}")
    source = config.get("source")
    if not isinstance(source, dict) or source.get("type") not in SOURCE_TYPES:
        raise ContractError(f"source.type must be one of {SOURCE_TYPES}")
    place = "datasets" if source["type"] == "local_csv" else "tables"
    locations, mapping = source.get(place), config.get("mapping")
    if not _texts(locations) or "contracts" not in locations:
        raise ContractError(f"source.{place}.contracts is required")
    if not isinstance(mapping, dict) or "contracts" not in mapping:
        raise ContractError("mapping.contracts is required")
    for group, names in (("mapping", mapping), (f"source.{place}", locations)):
        unknown = sorted(set(names) - set(DOMAINS))
        if unknown:
            raise ContractError(f"{group} has unknown domains {unknown}")
    without_source = sorted(set(mapping) - set(locations))
    if without_source:
        raise ContractError(f"domains with a mapping but no source: {without_source}")
    for domain, columns in mapping.items():
        if not _texts(columns):
            raise ContractError(f"mapping.{domain} must map column names to column names")
        unknown = sorted(set(columns) - set(DOMAINS[domain].names))
        missing = sorted(set(required_columns(domain, mode)) - set(columns))
        repeated = len(set(columns.values())) < len(columns)
        if unknown or missing or repeated:
            raise ContractError(
                f"mapping.{domain}: unknown {unknown}, missing {missing}, reused physical column: {repeated}"
            )
    return config
