"""Cypher queries over the data folder's property graph, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import edges, nodes
from ..operators import graph as G
from .cypher import Graph
from .library import query

_N = """nodes AS (SELECT 'customer:' || c_custkey AS id, 'customer' AS label, c_acctbal::DOUBLE AS value FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_acctbal FROM supplier
    UNION ALL SELECT 'part:' || p_partkey, 'part', p_retailprice FROM part UNION ALL SELECT 'order:' || o_orderkey, 'order', o_totalprice FROM orders
    UNION ALL SELECT 'nation:' || n_nationkey, 'nation', NULL FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'region', NULL FROM region)"""
_E = """edges AS (SELECT 'order:' || o_orderkey AS src, 'customer:' || o_custkey AS dst, 'PLACED_BY' AS rel FROM orders UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'CONTAINS' FROM lineitem
    UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'SUPPLIED_BY' FROM lineitem UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'LOCATED_IN' FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'LOCATED_IN' FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'PART_OF' FROM nation)"""


def _labels(g: Graph):
    return g.nodes.select("label").distinct()


def _types(g: Graph):
    return g.edges.select(F.col("rel").alias("relationshipType")).distinct()


def _scores(column: str, out: str = "score"):
    return lambda df: df.select(F.col("id").alias("nodeId"), F.col(column).alias(out))


def _of(g: Graph, rel: str | None):
    return g.edges.where(F.col("rel") == rel) if rel else g.edges


PROCEDURES = {
    "db.labels": _labels,
    "db.relationshipTypes": _types,
    "apoc.meta.stats": lambda g: g.nodes.groupBy("label").agg(F.count(F.lit(1)).alias("count")).withColumn("kind", F.lit("node")).unionByName(g.edges.groupBy(F.col("rel").alias("label")).agg(F.count(F.lit(1)).alias("count")).withColumn("kind", F.lit("relationship"))),
    "gds.degree": lambda g, rel=None: _scores("score")(G.degrees(_of(g, rel)).withColumn("score", F.col("out_degree"))),
    "gds.wcc": lambda g, rel=None: _scores("component", "componentId")(G.components(_of(g, rel))),
    "gds.pageRank": lambda g, rel=None: _scores("rank")(G.pagerank(_of(g, rel))),
    "gds.labelPropagation": lambda g, rel=None: _scores("label", "communityId")(G.label_propagation(_of(g, rel))),
    "gds.triangleCount": lambda g, rel=None: _scores("triangles", "triangleCount")(G.triangles(_of(g, rel))),
    "gds.kcore": lambda g, rel=None: _scores("coreness", "coreValue")(G.k_core(_of(g, rel))),
}


def _graph(spark, sf_dir, *relations) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir, *relations), PROCEDURES)


def cypher(name: str, text: str, oracle: str, relations: tuple[str, ...] = (), params: dict | None = None) -> None:
    """Register a Cypher query under a name; relations narrow the edges that it can meet."""

    def run(spark, sf_dir):
        return _graph(spark, sf_dir, *relations).query(text, params)

    run.__name__ = name
    query(oracle)(run)


cypher(
    "cypher_variable_length",
    "MATCH (o:order)-[r*1..3]->(x) WHERE o.value > 400000 RETURN o.id AS o, x.id AS x, size(r) AS hops",
    f"""WITH RECURSIVE {_E}, w(o, x, hops) AS (SELECT 'order:' || o_orderkey, 'order:' || o_orderkey, 0 FROM orders WHERE o_totalprice > 400000
    UNION ALL SELECT o, dst, hops + 1 FROM w JOIN edges ON src = x WHERE hops < 3 AND rel IN ('PLACED_BY', 'LOCATED_IN', 'PART_OF')) SELECT o, x, hops FROM w WHERE hops > 0""",
    ("PLACED_BY", "LOCATED_IN", "PART_OF"),
)
cypher(
    "cypher_unbounded_path",
    "MATCH (c:customer {id: 'customer:7'})-[*]->(x) RETURN x.id AS x, labels(x)[0] AS label",
    "SELECT 'nation:' || c_nationkey AS x, 'nation' AS label FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'region:' || n_regionkey, 'region' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7",
    ("LOCATED_IN", "PART_OF"),
)
cypher(
    "cypher_undirected",
    "MATCH (n:nation)-[:LOCATED_IN|PART_OF]-(x) RETURN n.id AS n, labels(x)[0] AS kind, count(*) AS links",
    """SELECT n, kind, count(*) AS links FROM (SELECT 'nation:' || c_nationkey AS n, 'customer' AS kind FROM customer UNION ALL SELECT 'nation:' || s_nationkey, 'supplier' FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region' FROM nation) GROUP BY 1, 2""",
    ("LOCATED_IN", "PART_OF"),
)
cypher(
    "cypher_property_map",
    "MATCH (c:customer)-[:LOCATED_IN]->(n:nation {id: $nation}) WHERE NOT c.value < 0 RETURN c.id AS c, c.value AS v",
    "SELECT 'customer:' || c_custkey AS c, c_acctbal AS v FROM customer WHERE c_nationkey = 3 AND NOT c_acctbal < 0",
    ("LOCATED_IN",),
    {"nation": "nation:3"},
)
cypher(
    "cypher_optional_where",
    "MATCH (c:customer) OPTIONAL MATCH (o:order)-[:PLACED_BY]->(c) WHERE o.value > 350000 RETURN c.id AS c, count(o) AS n, max(o.value) AS top",
    "SELECT 'customer:' || c_custkey AS c, count(o_orderkey) AS n, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 350000 GROUP BY 1",
    ("PLACED_BY",),
)
cypher(
    "cypher_repeated_name",
    "MATCH (a:nation)-[:PART_OF]->(r:region)<-[:PART_OF]-(b:nation), (c:customer)-[:LOCATED_IN]->(a), (s:supplier)-[:LOCATED_IN]->(b) WHERE c.value > 8000 AND s.value > 0 AND a <> b RETURN a.id AS a, b.id AS b, count(*) AS n",
    """SELECT 'nation:' || a.n_nationkey AS a, 'nation:' || b.n_nationkey AS b, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey
    JOIN customer ON c_nationkey = a.n_nationkey AND c_acctbal > 8000 JOIN supplier ON s_nationkey = b.n_nationkey AND s_acctbal > 0 GROUP BY 1, 2""",
    ("LOCATED_IN", "PART_OF"),
)
cypher(
    "cypher_cycle",
    "MATCH (o:order)-[:CONTAINS]->(p:part)<-[:CONTAINS]-(q:order)-[:PLACED_BY]->(c:customer)<-[:PLACED_BY]-(o) RETURN c.id AS c, count(DISTINCT p) AS parts",
    """SELECT 'customer:' || a.o_custkey AS c, count(DISTINCT l.l_partkey) AS parts FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey
    JOIN lineitem l ON l.l_orderkey = a.o_orderkey JOIN lineitem m ON m.l_orderkey = b.o_orderkey AND m.l_partkey = l.l_partkey GROUP BY 1""",
    ("CONTAINS", "PLACED_BY"),
)
cypher(
    "cypher_with_having",
    "MATCH (o:order)-[:PLACED_BY]->(c:customer) WITH c, count(*) AS orders, avg(o.value) AS mean WHERE orders > 12 MATCH (c)-[:LOCATED_IN]->(n) RETURN c.id AS c, n.id AS n, orders, round(mean * 100) / 100 AS mean ORDER BY orders DESC",
    """SELECT 'customer:' || c_custkey AS c, 'nation:' || c_nationkey AS n, orders, round(mean * 100) / 100 AS mean FROM (SELECT o_custkey, count(*) AS orders, avg(o_totalprice) AS mean FROM orders GROUP BY 1 HAVING count(*) > 12) JOIN customer ON c_custkey = o_custkey""",
    ("PLACED_BY", "LOCATED_IN"),
)
cypher(
    "cypher_unwind",
    "UNWIND ['nation:1', 'nation:4', 'none'] AS wanted MATCH (n:nation) WHERE n.id = wanted MATCH (n)-[:PART_OF]->(r) RETURN wanted, r.id AS r, CASE WHEN r.id = 'region:1' THEN 'one' ELSE 'other' END AS which",
    "SELECT 'nation:' || n_nationkey AS wanted, 'region:' || n_regionkey AS r, CASE WHEN n_regionkey = 1 THEN 'one' ELSE 'other' END AS which FROM nation WHERE n_nationkey IN (1, 4)",
    ("PART_OF",),
)
cypher(
    "cypher_relationship_variable",
    "MATCH (x)-[r:LOCATED_IN|PART_OF]->(y) RETURN type(r) AS kind, count(DISTINCT r.src) AS sources, count(*) AS n",
    f"WITH {_E} SELECT rel AS kind, count(DISTINCT src) AS sources, count(*) AS n FROM edges WHERE rel IN ('LOCATED_IN', 'PART_OF') GROUP BY 1",
    ("LOCATED_IN", "PART_OF"),
)
cypher(
    "cypher_quantified_path",
    "MATCH (o:order {id: 'order:5'}) ((a)-[:PLACED_BY|LOCATED_IN|PART_OF]->(b)){2,3} (x) RETURN o.id AS o, x.id AS x",
    "SELECT 'order:5' AS o, 'nation:' || c_nationkey AS x FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = 5 UNION ALL SELECT 'order:5', 'region:' || n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = 5",
    ("PLACED_BY", "LOCATED_IN", "PART_OF"),
)
cypher(
    "cypher_call_subquery",
    "MATCH (n:nation) CALL { WITH n MATCH (c:customer)-[:LOCATED_IN]->(n) RETURN count(*) AS customers, max(c.value) AS best } RETURN n.id AS n, customers, best",
    "SELECT 'nation:' || c_nationkey AS n, count(*) AS customers, max(c_acctbal) AS best FROM customer GROUP BY 1",
    ("LOCATED_IN",),
)
cypher(
    "cypher_procedure",
    "CALL gds.degree('LOCATED_IN') YIELD nodeId, score WHERE nodeId STARTS WITH 'supplier' RETURN nodeId AS id, score",
    "SELECT 'supplier:' || s_suppkey AS id, CAST(1 AS BIGINT) AS score FROM supplier",
    ("LOCATED_IN",),
)
cypher(
    "cypher_meta_stats",
    "CALL apoc.meta.stats() YIELD kind, label, count RETURN kind, label, count",
    f"WITH {_N}, {_E} SELECT 'node' AS kind, label, count(*) AS count FROM nodes GROUP BY 2 UNION ALL SELECT 'relationship', rel, count(*) FROM edges GROUP BY 2",
)
cypher("cypher_labels", "CALL db.labels() YIELD label RETURN label AS name UNION ALL CALL db.relationshipTypes() YIELD relationshipType RETURN relationshipType AS name", f"WITH {_N}, {_E} SELECT DISTINCT label AS name FROM nodes UNION ALL SELECT DISTINCT rel FROM edges")
cypher(
    "cypher_collections",
    "MATCH (c:customer)-[:LOCATED_IN]->(n:nation) WITH n, collect(c.value) AS values RETURN n.id AS n, round(apoc.coll.sum(values) * 100) / 100 AS total, apoc.coll.max(values) AS most, apoc.coll.min(values) AS least, size([v IN values WHERE v > 0 | v * 2]) AS positive",
    "SELECT 'nation:' || c_nationkey AS n, round(sum(c_acctbal) * 100) / 100 AS total, max(c_acctbal) AS most, min(c_acctbal) AS least, CAST(count(*) FILTER (WHERE c_acctbal > 0) AS INTEGER) AS positive FROM customer GROUP BY 1",
    ("LOCATED_IN",),
)
cypher(
    "cypher_union",
    "MATCH (c:customer)-[:LOCATED_IN]->(n) RETURN n.id AS id UNION MATCH (s:supplier)-[:LOCATED_IN]->(n) RETURN n.id AS id",
    "SELECT 'nation:' || c_nationkey AS id FROM customer UNION SELECT 'nation:' || s_nationkey FROM supplier",
    ("LOCATED_IN",),
)
cypher(
    "cypher_distinct_order",
    "MATCH (o:order)-[:PLACED_BY]->(c) RETURN o.id AS placed, c.id AS buyer ORDER BY o.value DESC, o.id SKIP 2 LIMIT 8",
    "SELECT 'order:' || o_orderkey AS placed, 'customer:' || o_custkey AS buyer FROM orders ORDER BY o_totalprice DESC, 'order:' || o_orderkey LIMIT 8 OFFSET 2",
    ("PLACED_BY",),
)


@query(
    """SELECT id, label, round(value, 2) AS value FROM (SELECT 'customer:' || c_custkey AS id, 'customer' AS label, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS value FROM customer WHERE NOT (c_acctbal > 9900)
    UNION ALL SELECT 'nation:' || n_nationkey, 'nation', (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) FROM nation
    UNION ALL SELECT 'region:' || r_regionkey, 'region', NULL FROM region UNION ALL SELECT 'nation:new', 'nation', 7)"""
)
def cypher_write_nodes(spark, sf_dir):
    g = _graph(spark, sf_dir, "LOCATED_IN", "PART_OF")
    g = Graph(g.nodes.where("label IN ('customer', 'nation', 'region')"), g.edges.where("src NOT LIKE 'supplier:%'"))
    g = g.write("MATCH (c:customer)-[:LOCATED_IN]->(n:nation) WITH n, count(*) AS customers SET n.value = customers")
    g = g.write("MATCH (c:customer) WHERE c.value > 9900 DETACH DELETE c").write("MATCH (c:customer) WHERE c.value < 0 SET c.value = 0")
    g = g.write("CREATE (n:nation {id: 'nation:new', value: 7})")
    return g.nodes.select("id", "label", F.round("value", 2).alias("value"))


@query(
    """SELECT src, dst, rel FROM (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'PART_OF' AS rel FROM nation WHERE n_regionkey <> 2 UNION ALL
    SELECT DISTINCT 'nation:' || c_nationkey, 'region:' || n_regionkey, 'SERVES' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000)"""
)
def cypher_write_edges(spark, sf_dir):
    g = _graph(spark, sf_dir, "LOCATED_IN", "PART_OF")
    g = g.write("MATCH (c:customer)-[:LOCATED_IN]->(n:nation)-[:PART_OF]->(r:region) WHERE c.value > 5000 MERGE (n)-[:SERVES]->(r)")
    g = g.write("MATCH (n:nation)-[p:PART_OF]->(r:region {id: 'region:2'}) DELETE p").write("MATCH (n:nation)-[s:SERVES]->(r:region) MERGE (n)-[:SERVES]->(r)")
    return g.edges.where("rel <> 'LOCATED_IN'").select("src", "dst", "rel")
