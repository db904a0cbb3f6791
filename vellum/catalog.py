"""All registered queries of the library's own operators, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.plans import layout_queries, paper_queries, reference_queries, review_queries, store_queries, stream_queries, structure_queries, text_queries, zone_queries

PARTS = (text_queries, paper_queries, reference_queries, layout_queries, structure_queries, store_queries, stream_queries, zone_queries, review_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each query by name; a query takes (spark, folder of tables)."""
    return {k: v for part in PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by name, for the queries that SQL can express."""
    return {k: v for part in PARTS for k, v in part.SQL.items()}
