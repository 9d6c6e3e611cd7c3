"""All queries of the library, by name, with the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from . import catalog
from .plans import sql_surface

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for _name in sql_surface.STATEMENTS:
    QUERIES[_name] = partial(catalog.sql, text=sql_surface.spark_text(_name))
    ORACLE_SQL[_name] = sql_surface.duckdb_text(_name)

from .plans import cypher_queries, engine_queries, finance_queries, graph_queries, graphql_queries, library, ontology_queries, pipe_queries, promql_queries, sparql_queries  # noqa: E402, F401  the others add to library

QUERIES |= library.QUERIES
ORACLE_SQL |= library.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of the highest orders: scan, filter, traverse, rank by total value, limit."""
    from pyspark.sql import functions as F

    from .operators.graph import traverse

    big = catalog.nodes(spark, sf_dir).where("label = 'order' AND value > 200000").select("id")
    reached = traverse(catalog.edges(spark, sf_dir, "PLACED_BY").select("src", "dst"), big, 1, 1)
    spent = catalog.table(spark, sf_dir, "orders").groupBy(catalog.node_id("customer", "o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("score"))
    return reached.join(spent, "id").select("id", F.round("score", 2).alias("score")).orderBy(F.desc("score"), "id").limit(10)
