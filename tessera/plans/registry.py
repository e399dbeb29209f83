"""All queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import (
    analysis, evaluated, evidence, extracted, grounded, guarding, handed, linked, localised, meetings, offlined, proposed, recalled, recapped, reduced, routed, selected, temporal, titled, trained,
)

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (meetings, analysis, evidence, guarding, extracted, proposed, temporal, evaluated, routed, selected, reduced, handed, offlined, localised, linked, recapped, recalled, trained, grounded, titled)

ALL = {name: query for module in MODULES for name, query in module.QUERIES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meetings.flagship(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
