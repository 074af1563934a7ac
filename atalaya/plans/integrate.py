"""Integration: read, map, cast and gate every configured domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atalaya.operators.contract import DOMAINS, cast_canonical, map_canonical
from atalaya.operators.quality import gate_domain, gate_relations
from atalaya.plans.config import check_config
from atalaya.sources.readers import open_source
from atalaya.sources.sinks import sink_csv_domains


def integrate_domains(
    config: dict, spark: SparkSession, output: str | None = None
) -> tuple[dict[str, DataFrame], dict]:
    """Typed and gated domains, and a summary with the row counts the gates found.

    One aggregate per domain checks casts, nulls, keys, blanks and amounts; the
    relations are anti-joins of distinct keys. Only counts come to the driver.
    """
    check_config(config)
    mode = config.get("mode", "inference")
    source = open_source(spark, config)
    datasets: dict[str, DataFrame] = {}
    summary = {
        "source_type": source.kind,
        "mode": mode,
        "engine": "spark",
        "domains": {},
        "skipped": sorted(set(DOMAINS) - set(config["mapping"])),
    }
    for domain, mapping in config["mapping"].items():
        raw = source.read(domain, list(mapping.values()))
        typed = cast_canonical(map_canonical(raw, domain, mapping), domain, mode)
        counts = gate_domain(typed)
        datasets[domain] = typed.data
        summary["domains"][domain] = {"rows": counts["filas"], "columns": list(typed.data.columns)}
    summary["foreign_keys"] = gate_relations(datasets)
    summary["status"] = "ok"
    if output is not None:
        sink_csv_domains(datasets, summary, output)
    return datasets, summary
