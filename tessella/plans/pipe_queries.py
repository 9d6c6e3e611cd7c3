"""Pipe-language queries over the data folder's graph, vectors and texts, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import edges, nodes, table
from . import pipes
from .library import _rounded, _vector, query


def _graph(spark, sf_dir):
    return nodes(spark, sf_dir), edges(spark, sf_dir)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("vec:"), F.col("vec_id").cast("string")).alias("id"), F.lit("vec").alias("label"), "embedding", F.col("label").alias("kind"))


_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7))"


@query(f"SELECT 'vec:' || vec_id AS id, round({_COS}, 6) AS score FROM embeddings WHERE label <> 3 ORDER BY {_COS} DESC, 'vec:' || vec_id LIMIT 12")
def pipe_rank_embedding(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _rounded(pipes.run("MATCH (:vec) WHERE kind <> 3 |> RANK BY EMBEDDING $q |> LIMIT 12", v, edges(spark, sf_dir), {"q": _vector(spark, sf_dir, 7)}).select("id", "score"))


@query("SELECT 'nation:' || n_nationkey AS id, 2.0::DOUBLE AS score FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 4) AND n_nationkey <> 4 UNION ALL SELECT 'nation:4', 0.0")
def pipe_rank_distance(spark, sf_dir):
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir, "PART_OF")
    return pipes.run("MATCH (:nation) |> RANK BY DISTANCE TO 'nation:4'", n, e).select("id", "score")


@query("SELECT 'nation:' || n_nationkey AS id, CAST(coalesce(c, 0) + coalesce(s, 0) AS DOUBLE) AS score FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def pipe_rank_mentions(spark, sf_dir):
    return pipes.run("MATCH (:nation) |> RANK BY MENTIONS LOCATED_IN", nodes(spark, sf_dir), edges(spark, sf_dir, "LOCATED_IN")).select("id", "score")


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_acctbal > 9000 UNION SELECT 'nation:' || c_nationkey FROM customer WHERE c_acctbal > 9000")
def pipe_expand(spark, sf_dir):
    return pipes.run("MATCH (:customer) WHERE value > 9000 |> EXPAND -[:LOCATED_IN]-> |> RETURN id", *_graph(spark, sf_dir)).select("id")


@query(
    """WITH s AS (SELECT 'customer:' || c_custkey AS id, c_nationkey, c_acctbal / 10000 AS p FROM customer WHERE c_acctbal > 9000), n AS (SELECT 'nation:' || c_nationkey AS id, c_nationkey AS k, max(p) * 0.5 AS p FROM s GROUP BY 1, 2)
    SELECT id, round(p * 10000, 4) AS score FROM (SELECT id, p FROM s UNION ALL SELECT id, p FROM n UNION ALL SELECT 'region:' || n_regionkey, max(p) * 0.5 FROM n JOIN nation ON k = n_nationkey GROUP BY 1)"""
)
def pipe_cascade(spark, sf_dir):
    e = edges(spark, sf_dir, "LOCATED_IN", "PART_OF").where("src NOT LIKE 'supplier:%'")
    text = "MATCH (:customer) WHERE value > 9000 |> RANK BY value |> PROPAGATE CASCADE -[:*]-> WEIGHT 0.5 HOPS 3"
    return pipes.run(text, nodes(spark, sf_dir), e).select("id", F.round("score", 4).alias("score"))


@query(
    """WITH a AS (SELECT 'customer:' || c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, 'customer:' || c_custkey) - 1 AS rank FROM customer QUALIFY rank < 40), b AS (SELECT 'customer:' || c_custkey AS id, row_number() OVER (ORDER BY c_acctbal, 'customer:' || c_custkey) - 1 AS rank FROM customer WHERE c_acctbal > 5000 QUALIFY rank < 60)
    SELECT id, round(sum(1 / (60.0 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id"""
)
def pipe_fuse(spark, sf_dir):
    text = "LET rich = MATCH (:customer) |> RANK BY value DESC |> LIMIT 40; LET least = MATCH (:customer) WHERE value > 5000 |> RANK BY value ASC |> LIMIT 60; FUSE rich, least"
    return pipes.run(text, *_graph(spark, sf_dir)).select("id", F.round("score", 9).alias("score"))


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, len(t) AS l, len(list_filter(t, lambda x: x = 'license')) AS f FROM w), s AS (SELECT count(*) AS n, avg(l) AS a, sum((f > 0)::INT) AS d FROM c)
    SELECT 'doc:' || doc_id AS id, round(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a)), 6) AS score FROM c, s WHERE f > 0"""
)
def pipe_rank_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.lit("doc").alias("label"), "text")
    return _rounded(pipes.run("MATCH (:doc) |> RANK BY TEXT 'license'", d, edges(spark, sf_dir)).select("id", "score"))


@query("SELECT true AS pushed, 'MATCH (:customer) |> WHERE value > 9000 |> LIMIT 3' AS query")
def pipe_explain(spark, sf_dir):
    """EXPLAIN shows the canonical text, and that the filter reached the scan."""
    found = pipes.run("EXPLAIN MATCH (:customer) WHERE value > 9000 |> LIMIT 3", *_graph(spark, sf_dir))
    return found.select(F.col("plan").rlike("PushedFilters: \\[[^\\]]*GreaterThan\\(c_acctbal").alias("pushed"), "query")


@query()
def pipe_diversify(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return pipes.run("MATCH (:vec) |> RANK BY EMBEDDING $q |> MMR 10 LAMBDA 0.7", v, edges(spark, sf_dir), {"q": _vector(spark, sf_dir, 7)}).select("id")
