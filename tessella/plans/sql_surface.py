"""The SQL surface: statements that run unchanged here and in DuckDB, and pairs where dialects differ.

Keys are query names. Values are one text for both, or (Spark's, DuckDB's).
"""

from __future__ import annotations

STATEMENTS: dict[str, str | tuple[str, str]] = {
    # relational operators
    "scan_filter_project": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'",
    "multi_join_star": "SELECT n_name, r_name, CAST(count(*) AS BIGINT) AS n_items, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name",
    "left_outer_join": "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY c_custkey",
    "right_outer_join": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 300000",
    "full_outer_join": "SELECT c_nationkey AS c, s_suppkey AS s FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 5000) a FULL OUTER JOIN (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 0) b ON c_nationkey = s_nationkey",
    "cross_join": "SELECT r_name, c_mktsegment FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s",
    "theta_join": "SELECT a.n_name AS lo, b.n_name AS hi FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "semi_join": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "in_subquery": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)",
    "correlated_subquery": "SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE t > 1000000) SELECT c_name, round(t, 2) AS t FROM top JOIN customer ON c_custkey = o_custkey",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "group_by_having": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10",
    "distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "count_distinct": "SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS users, CAST(sum(DISTINCT user_id) AS BIGINT) AS ids FROM events GROUP BY event_type",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "cube": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rollup": "SELECT n_regionkey, n_name, CAST(count(*) AS BIGINT) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)",
    "order_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    "values_table": "SELECT t.k, t.v, n_name FROM (VALUES (1, 'a'), (3, 'b'), (99, 'c')) AS t(k, v) LEFT JOIN nation ON n_nationkey = t.k",
    "generate_series": ("SELECT explode(sequence(1, 19, 3)) AS v", "SELECT CAST(unnest(generate_series(1, 19, 3)) AS INTEGER) AS v"),
    "unnest": ("SELECT n_nationkey, x FROM nation LATERAL VIEW explode(split(n_name, 'A')) t AS x", "SELECT n_nationkey, unnest(string_split(n_name, 'A')) AS x FROM nation"),
    "recursive_cte_walk": "WITH RECURSIVE walk(k, depth) AS (SELECT 1, 0 UNION ALL SELECT k * 2, depth + 1 FROM walk WHERE depth < 8) SELECT k, depth FROM walk",
    "pivot_case": "SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS views FROM events GROUP BY user_id",
    "interval_join": "SELECT o_orderkey, CAST(count(*) AS BIGINT) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL '30' DAY GROUP BY o_orderkey",
    # window functions
    "row_number_rank_dense": "SELECT c_custkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER v AS BIGINT) AS rk, CAST(dense_rank() OVER v AS BIGINT) AS dr FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey), v AS (PARTITION BY c_mktsegment ORDER BY c_nationkey)",
    "ntile_percent_cume": "SELECT c_custkey, CAST(ntile(4) OVER w AS BIGINT) AS q, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)",
    "lag_lead": "SELECT event_id, lag(value, 1, -1.0) OVER w AS prev, lead(value, 2) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "first_last_nth": "SELECT event_id, first_value(event_type) OVER w AS f, last_value(event_type) OVER w AS l, nth_value(event_type, 2) OVER w AS n2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "agg_over_partition": "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders",
    "rows_frame": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS m5 FROM events",
    "default_frame": "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate), 2) AS q FROM lineitem",
    "range_frame": "SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS BIGINT) AS near FROM orders",
    "topk_per_group": "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders) t WHERE rn <= 3",
    # scalar functions
    "string_functions": "SELECT c_custkey, upper(substr(c_name, 1, 4)) AS a, CAST(length(c_name) AS BIGINT) AS n, replace(c_name, 'Customer', 'C') AS r, concat(c_mktsegment, '-', c_name) AS j, trim('  x ') AS t, lower(c_mktsegment) AS l, reverse(c_name) AS v FROM customer",
    "split_part": "SELECT c_custkey, split_part(c_name, '#', 1) AS a, split_part(c_name, '#', 2) AS b FROM customer",
    "regexp_functions": ("SELECT page_id, regexp_replace(url, '^https?://', '') AS u, regexp_extract(url, '([0-9]+)', 1) AS n FROM pages", "SELECT page_id, regexp_replace(url, '^https?://', '') AS u, regexp_extract(url, '([0-9]+)', 1) AS n FROM pages"),
    "like_filter": "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'S%'",
    "date_functions": ("SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS t FROM orders", "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS t FROM orders"),
    "to_char": ("SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd') AS d FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders"),
    "to_timestamp": ("SELECT event_id, CAST(timestamp_seconds(event_id * 86400) AS TIMESTAMP_NTZ) AS t FROM events", "SELECT event_id, CAST(make_timestamp(event_id * 86400 * 1000000) AS TIMESTAMP) AS t FROM events"),
    "time_bucket": ("SELECT CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 3600000000) AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1", "SELECT CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS bucket, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1"),
    "coalesce_nullif": "SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS t FROM events",
    "greatest_least": "SELECT l_orderkey, l_linenumber, greatest(l_quantity, 10.0, l_tax) AS g, least(l_quantity, 10.0, l_discount) AS l FROM lineitem",
    "math_functions": "SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS s, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, round(ln(abs(c_acctbal) + 1), 6) AS l, round(power(c_acctbal / 1000, 2), 6) AS p, CAST(sign(c_acctbal) AS DOUBLE) AS g FROM customer",
    "json_get": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, get_json_object(props, '$.none') AS z FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS z FROM events"),
    "json_path_filter": ("SELECT event_id FROM events WHERE try_variant_get(try_parse_json(props), '$.k', 'bigint') > 50", "SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) > 50"),
    "array_functions": ("SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, round(CAST(element_at(embedding, 1) AS DOUBLE), 5) AS a, array_contains(array(1, label), 1) AS has, arrays_overlap(array(label), array(2, 3)) AS any23, CAST(size(concat(array(label), array(1, 2))) AS BIGINT) AS c FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, round(CAST(embedding[1] AS DOUBLE), 5) AS a, list_contains([1, label], 1) AS has, list_has_any([label], [2, 3]) AS any23, CAST(len(list_concat([label], [1, 2])) AS BIGINT) AS c FROM embeddings"),
    "array_agg": ("SELECT o_custkey, array_join(transform(array_sort(collect_list(o_orderkey)), x -> CAST(x AS STRING)), ',') AS keys FROM orders GROUP BY o_custkey", "SELECT o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') AS keys FROM orders GROUP BY o_custkey"),
    "string_agg": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "range_functions": "SELECT o_orderkey, (o_totalprice >= 1000 AND o_totalprice < 50000) AS inside, (o_totalprice < 90000 AND 40000 < o_totalprice + 100) AS overlaps FROM orders",
    "epistemic_decay": "SELECT event_id, round(value * CASE WHEN event_id <= 0 THEN 1.0 ELSE exp(-ln(2.0) * event_id / 30.0) END, 9) AS decayed FROM events",
    # aggregates
    "basic_aggregates": "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS s, round(avg(value), 6) AS a, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type",
    "corr_covar": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_samp(l_quantity, l_discount), 6) AS cs, round(covar_pop(l_quantity, l_discount), 6) AS cp FROM lineitem GROUP BY l_returnflag",
    "stddev_var": "SELECT event_type, round(var_samp(value), 4) AS v, round(var_pop(value), 4) AS vp, round(stddev_samp(value), 6) AS s, round(stddev_pop(value), 6) AS sp FROM events GROUP BY event_type",
    "median_percentile": ("SELECT event_type, round(median(value), 6) AS m, round(percentile(value, 0.9), 6) AS p90 FROM events GROUP BY event_type", "SELECT event_type, round(median(value), 6) AS m, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type"),
    "regression": "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS icpt, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag",
    "agg_filter": "SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors, round(avg(value) FILTER (WHERE value > 50), 6) AS high FROM events GROUP BY user_id",
    "bool_aggregates": "SELECT o_custkey, bool_and(o_totalprice > 1000) AS every_big, bool_or(o_orderstatus = 'F') AS some_f FROM orders GROUP BY o_custkey",
    "tpch_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "tpch_forecast_revenue": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.04 AND 0.07 AND l_quantity < 24",
}


def spark_text(name: str) -> str:
    found = STATEMENTS[name]
    return found if isinstance(found, str) else found[0]


def duckdb_text(name: str) -> str:
    found = STATEMENTS[name]
    return found if isinstance(found, str) else found[1]
