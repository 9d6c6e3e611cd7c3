"""Statements and functions of the SQL session, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import scratch
from .engine import Engine
from .library import ORACLE_SQL, _longs, _rounded, query


def _engine(spark, sf_dir) -> Engine:
    return Engine(spark, sf_dir, scratch(spark))


def statement(name: str, text: str, oracle: str, before: tuple[str, ...] = ()) -> None:
    """Register one statement, run after others in a session of its own."""

    def run(spark, sf_dir):
        e = _engine(spark, sf_dir)
        for b in before:
            e.sql(b)
        return e.sql(text)

    run.__name__ = name
    query(oracle)(run)


# --- functions
statement(
    "range_types",
    "SELECT o_orderkey, range_contains(numrange(1000, 50000), o_totalprice) AS inside, range_overlaps(numrange(o_totalprice, o_totalprice + 100), numrange(40000, NULL)) AS overlaps, range_contains_range(numrange(NULL, 90000), numrange(o_totalprice, o_totalprice + 10)) AS covers, range_intersection(numrange(20000, o_totalprice), numrange(0, 80000)).hi AS top, range_adjacent(numrange(0, 5), numrange(5, 9)) AS touch FROM orders",
    "SELECT o_orderkey, o_totalprice >= 1000 AND o_totalprice < 50000 AS inside, 40000 < o_totalprice + 100 AS overlaps, o_totalprice + 10 <= 90000 AS covers, least(o_totalprice, 80000.0) AS top, true AS touch FROM orders",
)
statement(
    "decay_function", "SELECT event_id, round(epistemic_decay(value, event_id - 100, 30), 9) AS decayed FROM events",
    "SELECT event_id, round(value * CASE WHEN event_id - 100 <= 0 THEN 1.0 ELSE exp(-ln(2.0) * (event_id - 100) / 30.0) END, 9) AS decayed FROM events",
)
statement(
    "bucket_function", "SELECT CAST(unix_seconds(bucket_seconds(900, CAST(ts AS TIMESTAMP))) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1",
    "SELECT CAST(epoch_us(ts) // 900000000 * 900 AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1",
)
statement(
    "json_functions", "SELECT event_id, json_i64(props, 'k') AS k, json_f64(props, 'k') / 2 AS half, json_text(props, 'none') AS none FROM events",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 2 AS half, json_extract_string(props, '$.none') AS none FROM events",
)
statement(
    "array_containment", "SELECT vec_id, array_has_all(array(1, 2, CAST(label AS BIGINT)), array(2, 3)) AS every, array_has_any(array(CAST(label AS BIGINT)), array(4, 5)) AS some, array_length(array(CAST(label AS BIGINT), 7), 1) AS n, array_length(array(1), 2) AS none FROM embeddings",
    "SELECT vec_id, list_has_all([1, 2, label], [2, 3]) AS every, list_has_any([label], [4, 5]) AS some, CAST(2 AS INTEGER) AS n, CAST(NULL AS INTEGER) AS none FROM embeddings",
)
statement(
    "vector_functions",
    "SELECT vec_id, round(vec_l2(e, q), 6) AS l2, round(cosine_sim(e, q), 6) AS cosine, round(-vec_dot(e, q), 6) AS negative_dot, round(get(l2_normalize(e), 0), 6) AS first FROM (SELECT vec_id, CAST(embedding AS ARRAY<DOUBLE>) AS e, (SELECT CAST(first(embedding) AS ARRAY<DOUBLE>) FROM embeddings WHERE vec_id = 3) AS q FROM embeddings)",
    "SELECT vec_id, round(list_distance(e, q), 6) AS l2, round(list_cosine_similarity(e, q), 6) AS cosine, round(-list_inner_product(e, q), 6) AS negative_dot, round(e[1] / sqrt(list_inner_product(e, e)), 6) AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3) AS q FROM embeddings)",
)
statement(
    "scalar_sql_function", "SELECT l_returnflag, round(sum(net(l_extendedprice, l_discount)), 2) AS net, max(grade(l_quantity)) AS top FROM lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, max(CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END) AS top FROM lineitem GROUP BY l_returnflag",
    ("CREATE TEMPORARY FUNCTION net(p DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN p * (1 - d)", "CREATE TEMPORARY FUNCTION grade(q DOUBLE) RETURNS STRING RETURN CASE WHEN q > 25 THEN 'many' ELSE 'few' END"),
)
statement(
    "table_sql_function", "SELECT n_name, t.c_custkey, t.c_acctbal FROM nation, LATERAL richest(n_nationkey, 9000) t",
    "SELECT n_name, c_custkey, c_acctbal FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9000",
    ("SELECT 1 FROM customer", "CREATE TEMPORARY FUNCTION richest(nation INT, least DOUBLE) RETURNS TABLE (c_custkey BIGINT, c_acctbal DOUBLE) RETURN SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = nation AND c_acctbal > least"),
)
statement(
    "procedural_function", "SELECT s_suppkey, steps(s_suppkey) AS steps FROM supplier",
    "WITH RECURSIVE w(k, x, n) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier UNION ALL SELECT k, x // 2, n + 1 FROM w WHERE x > 1) SELECT k AS s_suppkey, CAST(max(n) AS INTEGER) AS steps FROM w GROUP BY 1",
    ("CREATE TEMPORARY FUNCTION steps(k BIGINT) RETURNS INT RETURN aggregate(sequence(1, 62), named_struct('x', k, 'n', 0), (s, i) -> CASE WHEN s.x > 1 THEN named_struct('x', s.x DIV 2, 'n', s.n + 1) ELSE s END, s -> s.n)",),
)


@query("SELECT CAST(sum(n) AS BIGINT) AS total, CAST(count(*) AS INTEGER) AS steps FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1)")
def sql_script(spark, sf_dir):
    """A script with variables and a loop over the regions, kept as a named query."""
    e = _engine(spark, sf_dir)
    e.sql("SELECT 1 FROM nation")
    e.session.conf.set("spark.sql.scripting.enabled", "true")
    return e.session.sql(
        """BEGIN
        DECLARE total BIGINT DEFAULT 0; DECLARE k INT DEFAULT 0; DECLARE most INT;
        SET most = (SELECT CAST(count(DISTINCT n_regionkey) AS INT) FROM nation);
        WHILE k < most DO
            SET total = total + (SELECT count(*) FROM nation WHERE n_regionkey = k);
            SET k = k + 1;
        END WHILE;
        SELECT total, k AS steps;
        END"""
    )


# --- approximate aggregates: each beside the exact value that bounds its error
statement(
    "approx_distinct_bound", "SELECT event_type, count(DISTINCT user_id) AS exact, abs(approx_count_distinct(user_id, 0.01) - count(DISTINCT user_id)) <= 0.05 * count(DISTINCT user_id) AS near FROM events GROUP BY event_type",
    "SELECT event_type, count(DISTINCT user_id) AS exact, true AS near FROM events GROUP BY event_type",
)


@query(ORACLE_SQL["approx_distinct_bound"])
def approx_distinct_bound(spark, sf_dir):
    """The statement above, planned by hand: Spark would carry a sketch for each user beside the exact count, here there is one for each type."""
    from ..catalog import table

    e = table(spark, sf_dir, "events")
    sketch = e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("some"))
    exact = e.select(F.col("event_type").alias("type"), "user_id").distinct().groupBy("type").agg(F.count("user_id").alias("exact"))
    both = sketch.join(exact, F.col("event_type").eqNullSafe(F.col("type")))
    return both.select("event_type", "exact", (F.abs(F.col("some") - F.col("exact")) <= 0.05 * F.col("exact")).alias("near"))


statement(
    "approx_percentile_exact", "SELECT l_returnflag, CAST(approx_percentile(l_quantity, 0.5, 1000000) AS DOUBLE) AS median, CAST(approx_percentile(l_quantity, 0.95, 1000000) AS DOUBLE) AS p95 FROM lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, CAST(quantile_disc(l_quantity, 0.5) AS DOUBLE) AS median, CAST(quantile_disc(l_quantity, 0.95) AS DOUBLE) AS p95 FROM lineitem GROUP BY l_returnflag",
)
statement(
    "zscore_column", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS z FROM customer",
    "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS z FROM customer",
)


@query("SELECT event_type AS item, count(*) AS exact, true AS bounded FROM events GROUP BY 1")
def approx_frequency(spark, sf_dir):
    """Counts from a count-min sketch, which are never below the exact ones and at most eps * n above."""
    from ..operators.sketches import count_min, estimate
    from ..catalog import table

    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("item"))
    exact = e.groupBy("item").agg(F.count(F.lit(1)).alias("exact"))
    n = e.count()
    found = estimate(count_min(e, "item", 5, 2048), exact, "item")
    return found.select("item", "exact", ((F.col("estimate") >= F.col("exact")) & (F.col("estimate") <= F.col("exact") + 0.01 * n)).alias("bounded"))


@query(
    """WITH w AS (SELECT doc_id, list_distinct(string_split_regex(lower(text), '\\s+')) AS w FROM documents WHERE length(text) > 0), p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS j FROM w a JOIN w b ON b.doc_id = a.doc_id + 1)
    SELECT a, b, round(j, 6) AS jaccard, true AS near FROM p"""
)
def minhash_estimate(spark, sf_dir):
    """MinHash similarities of neighbouring documents, within five deviations of the Jaccard similarity."""
    e = _engine(spark, sf_dir)
    return e.sql(
        r"""WITH w AS (SELECT doc_id, array_distinct(split(lower(text), '\\s+')) AS w FROM documents WHERE length(text) > 0), s AS (SELECT doc_id, w, minhash_signature(w, 64) AS s FROM w),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, size(array_intersect(a.w, b.w)) / size(array_union(a.w, b.w)) AS j, minhash_similarity(a.s, b.s) AS m FROM s a JOIN s b ON b.doc_id = a.doc_id + 1)
        SELECT a, b, round(j, 6) AS jaccard, abs(m - j) <= 5 * sqrt(j * (1 - j) / 64) + 0.05 AS near FROM p"""
    )


# --- statements
@query(
    """SELECT n_nationkey AS k, CASE WHEN n_regionkey = 2 THEN 'two' ELSE n_name END AS name, CASE WHEN n_nationkey = 1 THEN 99.0 ELSE CAST(n_regionkey AS DOUBLE) END AS v, CAST(NULL AS VARCHAR) AS note FROM nation WHERE n_regionkey <> 4
    UNION ALL SELECT 100, 'new', 1.5, NULL"""
)
def table_changes(spark, sf_dir):
    e = _engine(spark, sf_dir)
    e.sql("CREATE TABLE places AS SELECT n_nationkey AS k, n_name AS name, CAST(n_regionkey AS DOUBLE) AS v FROM nation")
    e.sql("INSERT INTO places VALUES (100, 'new', 1.5), (101, 'gone', NULL)")
    e.sql("INSERT INTO places VALUES (1, 'ignored', 0.0) ON CONFLICT (k) DO NOTHING")
    e.sql("INSERT INTO places SELECT k, name, 99.0D FROM places WHERE k = 1 ON CONFLICT (k) DO UPDATE")
    e.sql("UPDATE places SET name = 'two' WHERE v = 2 AND k < 100")
    e.sql("DELETE FROM places WHERE v = 4 OR name = 'gone'")
    e.sql("ALTER TABLE places ADD COLUMN note STRING")
    return e.sql("SELECT k, name, v, note FROM places")


@query("SELECT CAST(n_regionkey AS BIGINT) AS r, count(*) AS n FROM nation WHERE n_nationkey <> 0 GROUP BY 1 UNION ALL SELECT -1, (SELECT count(*) FROM nation)")
def materialised_view(spark, sf_dir):
    """The view as refreshed, and the count that it still showed before."""
    e = _engine(spark, sf_dir)
    e.sql("CREATE TABLE places AS SELECT * FROM nation")
    e.sql("CREATE MATERIALIZED VIEW per_region AS SELECT n_regionkey AS r, count(*) AS n FROM places GROUP BY 1")
    e.sql("DELETE FROM places WHERE n_nationkey = 0")
    stale = e.sql("SELECT -1 AS r, sum(n) AS n FROM per_region")
    e.sql("REFRESH MATERIALIZED VIEW per_region")
    return _longs(e.sql("SELECT r, n FROM per_region").unionByName(stale), "r", "n")


@query("SELECT CAST(r_regionkey AS BIGINT) AS k FROM region UNION ALL SELECT 50")
def transaction(spark, sf_dir):
    e = _engine(spark, sf_dir)
    for s in ("CREATE TABLE t AS SELECT r_regionkey AS k FROM region", "BEGIN", "DELETE FROM t WHERE k < 3", "CREATE TABLE u AS SELECT 1 AS x", "ROLLBACK", "BEGIN", "INSERT INTO t VALUES (50)", "COMMIT"):
        e.sql(s)
    return _longs(e.sql("SELECT k FROM t"), "k")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def copy_both_ways(spark, sf_dir):
    e = _engine(spark, sf_dir)
    path = f"{scratch(spark)}/copy"
    for s in ("CREATE TABLE t AS SELECT n_nationkey AS k, n_name AS name FROM nation", f"COPY t TO '{path}' WITH (FORMAT csv, DELIMITER '|', HEADER true)", f"COPY t FROM '{path}' WITH (FORMAT csv, DELIMITER '|', HEADER true)"):
        e.sql(s)
    return e.sql("SELECT k, name FROM t")


@query("SELECT 'supplier:' || s_suppkey AS s, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 5000")
def graph_table(spark, sf_dir):
    e = _engine(spark, sf_dir)
    e.sql(
        """CREATE PROPERTY GRAPH places VERTEX TABLES (supplier KEY (s_suppkey) LABEL supplier, nation KEY (n_nationkey) LABEL nation, region KEY (r_regionkey) LABEL region)
        EDGE TABLES (supplier SOURCE KEY (s_suppkey) REFERENCES supplier DESTINATION KEY (s_nationkey) REFERENCES nation LABEL IN_NATION, nation SOURCE KEY (n_nationkey) REFERENCES nation DESTINATION KEY (n_regionkey) REFERENCES region LABEL IN_REGION)"""
    )
    return e.sql("SELECT s, region FROM GRAPH_TABLE (places MATCH (s:supplier)-[:IN_NATION]->(n:nation)-[:IN_REGION]->(r:region) WHERE s.s_acctbal > 5000 COLUMNS (s.id AS s, r.r_name AS region))")


statement(
    "graph_table_function", "SELECT id, CAST(out_degree AS BIGINT) AS o, CAST(in_degree AS BIGINT) AS i FROM degrees('PART_OF') WHERE id LIKE 'region:%'",
    "SELECT 'region:' || n_regionkey AS id, CAST(0 AS BIGINT) AS o, count(*) AS i FROM nation GROUP BY 1",
)
statement(
    "information_schema", "SELECT table_name, column_name, ordinal_position FROM information_schema.columns WHERE table_name IN ('nation', 'region')",
    "SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS ordinal_position FROM information_schema.columns WHERE table_name IN ('nation', 'region')",
)


@query("SELECT true AS pruned, true AS pushed, true AS aggregated")
def explain_plan(spark, sf_dir):
    """What EXPLAIN says of a query: columns pruned, filter in the scan, partial aggregation."""
    plan = F.col("plan")
    e = _engine(spark, sf_dir)
    e.sql("SELECT 1 FROM lineitem")
    return e.sql("EXPLAIN FORMATTED SELECT l_returnflag, sum(l_quantity) FROM lineitem WHERE l_tax > 0.05 GROUP BY 1").select(
        (~plan.rlike("ReadSchema: [^\\n]*l_comment") & plan.contains("l_quantity")).alias("pruned"), plan.rlike("PushedFilters: [^\\n]*GreaterThan\\(l_tax").alias("pushed"), plan.contains("partial_sum").alias("aggregated")
    )
