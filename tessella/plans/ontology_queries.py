"""Ontology reasoning over the data folder's places, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import edges, nodes
from ..operators import ontology as O
from .library import query


def _facts(spark, sf_dir) -> DataFrame:
    """Places as triples: types, located_in and part_of, and a small schema over them."""
    n = nodes(spark, sf_dir).where("label IN ('customer', 'supplier', 'nation', 'region')")
    types = n.select(F.col("id").alias("s"), F.lit(O.TYPE).alias("p"), F.initcap("label").alias("o"))
    links = edges(spark, sf_dir, "LOCATED_IN", "PART_OF").select(F.col("src").alias("s"), F.lower("rel").alias("p"), F.col("dst").alias("o"))
    schema = [
        ("Customer", O.SUBCLASS, "Party"), ("Supplier", O.SUBCLASS, "Party"), ("Party", O.SUBCLASS, "Agent"), ("located_in", O.SUBPROPERTY, "within"), ("part_of", O.SUBPROPERTY, "within"),
        ("within", O.TYPE, O.TRANSITIVE), ("within", O.RANGE, "Place"), ("part_of", O.DOMAIN, "Country"), ("within", O.INVERSE, "holds"), ("Country", O.EQUIVALENT, "State"),
    ]
    return types.unionByName(links).unionByName(spark.createDataFrame(schema, "s string, p string, o string"))


_IN = "SELECT 'customer:' || c_custkey AS s, 'nation:' || c_nationkey AS o FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier"


@query(
    f"""WITH l AS ({_IN}), w AS (SELECT s, o FROM l UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation UNION ALL SELECT s, 'region:' || n_regionkey FROM l JOIN nation ON o = 'nation:' || n_nationkey),
    t AS (SELECT split_part(s, ':', 1) AS k, s FROM l UNION ALL SELECT 'nation', 'nation:' || n_nationkey FROM nation)
    SELECT p, count(*) AS n FROM (SELECT 'within' AS p, s, o FROM w UNION ALL SELECT 'holds', o, s FROM w UNION ALL SELECT 'Place', o, '' FROM (SELECT DISTINCT o FROM w) UNION ALL SELECT 'Party', s, '' FROM l UNION ALL SELECT 'Agent', s, '' FROM l
    UNION ALL SELECT 'Country', s, '' FROM t WHERE k = 'nation' UNION ALL SELECT 'State', s, '' FROM t WHERE k = 'nation') GROUP BY 1"""
)
def owl_rules(spark, sf_dir):
    """How many facts each class and property has that nobody stated."""
    found = O.materialise_rl(_facts(spark, sf_dir)).where("rule IS NOT NULL")
    return found.where(F.col("p").isin("within", "holds", O.TYPE)).groupBy(F.when(F.col("p") == O.TYPE, F.col("o")).otherwise(F.col("p")).alias("p")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT 'supplier:' || s_suppkey AS id, 'supplier:' || (SELECT min(k) FROM (SELECT CAST(b.s_suppkey AS VARCHAR) AS k FROM supplier b WHERE b.s_nationkey = supplier.s_nationkey)) AS same FROM supplier"""
)
def same_as_groups(spark, sf_dir):
    """Suppliers named by the one of their nation: an inverse functional property makes those of one nation equal."""
    s = edges(spark, sf_dir, "LOCATED_IN").where("src LIKE 'supplier:%'").select(F.col("src").alias("s"), F.lit("sole_of").alias("p"), F.col("dst").alias("o"))
    t = s.unionByName(spark.createDataFrame([("sole_of", O.TYPE, O.INVERSE_FUNCTIONAL)], "s string, p string, o string"))
    alone = s.select(F.col("s").alias("id"))
    return alone.join(O.same_individuals(t), "id", "left").select("id", F.coalesce("same", "id").alias("same"))


@query("SELECT 'customer:' || c_custkey AS id, 'disjoint' AS kind, 'Debtor Rich' AS what FROM customer WHERE c_acctbal < 0 AND c_nationkey < 5")
def ontology_clashes(spark, sf_dir):
    c = nodes(spark, sf_dir).where("label = 'customer'").join(edges(spark, sf_dir, "LOCATED_IN").select(F.col("src").alias("id"), "dst"), "id")
    debt = c.where("value < 0").select(F.col("id").alias("s"), F.lit(O.TYPE).alias("p"), F.lit("Debtor").alias("o"))
    rich = c.where(F.col("dst").isin([f"nation:{i}" for i in range(5)])).select(F.col("id").alias("s"), F.lit(O.TYPE).alias("p"), F.lit("Rich").alias("o"))
    return O.clashes(debt.unionByName(rich).unionByName(spark.createDataFrame([("Debtor", O.DISJOINT, "Rich")], "s string, p string, o string")))
