"""All queries of the engine's own operators, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import box_queries, candidate_queries, catalog_queries, evidence_queries, field_queries, record_queries, role_queries, spine_queries, text_queries, title_queries, work_queries

MODULES = (text_queries, box_queries, candidate_queries, catalog_queries, evidence_queries, field_queries, record_queries, role_queries, spine_queries, title_queries, work_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch fuzzy search of misspelt titles."""
    return catalog_queries.QUERIES["search_many"](spark, sf_dir)
