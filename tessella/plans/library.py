"""Queries that apply the library's operators to the data folder, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import edges, nodes, scratch, table
from ..functions import series as S
from .sql_surface import duckdb_text
from ..operators import finance, graph, patterns, retrieval, rules, spatial, statistics, timeseries, uncertainty

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE_SQL[fn.__name__] = oracle
        return fn

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c).cast("double"), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_type").alias("type"), (timeseries.micros(F.col("ts")) / 1e6).alias("t"), F.col("event_id").alias("id"), "value", "ts")


# --- series kernels
_W = "PARTITION BY user_id ORDER BY ts, event_id"


def _full(value: str, w: int) -> str:
    return f"CASE WHEN count(*) OVER (w{w}) = {w} THEN {value} END"


@query(
    f"""SELECT event_id, round(value - lag(value, 2) OVER w, 6) AS diff2, round(CASE WHEN lag(value) OVER w <> 0 THEN value / lag(value) OVER w - 1 END, 6) AS ret1,
    round(CASE WHEN value > 0 AND lag(value) OVER w > 0 THEN ln(value / lag(value) OVER w) END, 6) AS logret1, greatest(least(value, 80.0), 20.0) AS clipped
    FROM events WHERE value IS NOT NULL WINDOW w AS ({_W})"""
)
def series_differences(spark, sf_dir):
    k = S.Series(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    x = F.col("value")
    return _rounded(table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", k.diff(x, 2).alias("diff2"), k.ret(x).alias("ret1"), k.logret(x).alias("logret1"), S.clip(x, 20.0, 80.0).alias("clipped")))


@query(
    f"""SELECT event_id, round({_full('avg(value) OVER w5', 5)}, 6) AS rmean, round({_full('sum(value) OVER w5', 5)}, 4) AS rsum, round({_full('stddev_pop(value) OVER w5', 5)}, 5) AS rstd,
    {_full('min(value) OVER w5', 5)} AS rmin, {_full('max(value) OVER w5', 5)} AS rmax
    FROM events WHERE value IS NOT NULL WINDOW w5 AS ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""".replace("OVER (w5)", "OVER w5")
)
def series_rolling(spark, sf_dir):
    k = S.Series(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    x = F.col("value")
    return table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", F.round(k.rmean(x, 5), 6).alias("rmean"), F.round(k.rsum(x, 5), 4).alias("rsum"), F.round(k.rstd(x, 5), 5).alias("rstd"), k.rmin(x, 5).alias("rmin"), k.rmax(x, 5).alias("rmax"))


@query(
    f"""SELECT event_id, round(CASE WHEN count(*) OVER w = 8 THEN CASE WHEN stddev_pop(value) OVER w <= 1e-12 THEN 0.0 ELSE (value - avg(value) OVER w) / stddev_pop(value) OVER w END END, 5) AS z
    FROM events WHERE value IS NOT NULL WINDOW w AS ({_W} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"""
)
def series_zscore(spark, sf_dir):
    k = S.Series(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", F.round(k.zscore(F.col("value"), 8), 5).alias("z"))


@query(
    f"""SELECT event_id, CASE WHEN len(h) = 6 THEN len(list_filter(h, lambda v: v < value)) + (len(list_filter(h, lambda v: v = value)) + 1) / 2.0 END AS r
    FROM (SELECT event_id, value, list(value) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS h FROM events WHERE value IS NOT NULL)"""
)
def series_rank(spark, sf_dir):
    k = S.Series(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", k.rrank(F.col("value"), 6).alias("r"))


@query(
    f"""SELECT l_orderkey, l_linenumber, round(CASE WHEN count(*) OVER w = 10 THEN corr(l_quantity, l_extendedprice) OVER w END, 5) AS c, round(CASE WHEN count(*) OVER w = 10 THEN sum(l_quantity * l_extendedprice) OVER w / sum(l_quantity) OVER w END + 0.0000123, 3) AS vwap
    FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""
)
def series_rcorr(spark, sf_dir):
    k = S.Series(Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber"))
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(k.rcorr(q, p, 10), 5).alias("c"), F.round(k.wsum(p, q, 10) / k.rsum(q, 10) + 0.0000123, 3).alias("vwap"))


@query(
    """SELECT event_id, round(list_reduce(h, lambda y, v: v * 0.2 + y * 0.8), 6) AS y
    FROM (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 511 PRECEDING AND CURRENT ROW) AS h FROM events WHERE value IS NOT NULL)"""
)
def series_ewma(spark, sf_dir):
    k = S.Series(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", F.round(k.ewma(F.col("value"), 9), 6).alias("y"))


# --- time series
_DAY = "CAST(epoch_us(ts) // 86400000000 AS BIGINT) * 86400"


@query(
    f"""SELECT event_type AS series, {_DAY} AS bucket, count(*) AS n, round(avg(value), 6) AS mean, round(sum(value), 4) AS sum, min(value) AS low, max(value) AS high,
    first(value ORDER BY ts, event_id) AS open, last(value ORDER BY ts, event_id) AS close FROM events GROUP BY 1, 2"""
)
def ohlc_bars(spark, sf_dir):
    b = timeseries.bucketed(table(spark, sf_dir, "events").withColumnRenamed("event_id", "id"), "event_type", "ts", "value", 86400)
    return b.withColumn("mean", F.round("mean", 6)).withColumn("sum", F.round("sum", 4))


_ASOF = """SELECT l.event_id AS id, l.user_id, l.ts, {v} AS value FROM (SELECT * FROM events WHERE event_type = 'purchase') l
    ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) r ON l.user_id = r.user_id AND l.ts >= r.ts"""


def _asof(spark, sf_dir, tolerance=None):
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return timeseries.asof_join(e.where("event_type = 'purchase'").withColumnRenamed("event_id", "id"), views, "user_id", "ts", "value", tolerance)


@query(_ASOF.format(v="r.value"))
def asof_join(spark, sf_dir):
    return _asof(spark, sf_dir)


@query(_ASOF.format(v="CASE WHEN epoch_us(l.ts) - epoch_us(r.ts) <= 3600000000 THEN r.value END"))
def asof_join_tolerance(spark, sf_dir):
    return _asof(spark, sf_dir, 3_600_000_000)


@query(
    """WITH b AS (SELECT user_id AS series, CAST(epoch_us(ts) // 3600000000 AS BIGINT) * 3600 AS bucket, round(avg(value), 6) AS value FROM events GROUP BY 1, 2),
    g AS (SELECT series, unnest(range(min(bucket), max(bucket) + 1, 3600)) AS bucket FROM b GROUP BY series)
    SELECT g.series, g.bucket, last_value(b.value IGNORE NULLS) OVER (PARTITION BY g.series ORDER BY g.bucket ROWS UNBOUNDED PRECEDING) AS value, b.value IS NULL AS filled
    FROM g LEFT JOIN b ON g.series = b.series AND g.bucket = b.bucket"""
)
def gap_fill_locf(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    b = e.groupBy(F.col("user_id").alias("series"), timeseries.bucket_start(F.col("ts"), 3600).alias("bucket")).agg(F.round(F.avg("value"), 6).alias("value"))
    return timeseries.gap_filled(b, 3600)


@query(
    """SELECT user_id AS series, round(sum(w * value) / sum(w), 6) AS mean FROM (SELECT user_id, value, power(0.5, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1e6 / 604800.0) AS w, ts FROM events)
    WHERE ts <= TIMESTAMP '2024-02-01' GROUP BY 1"""
)
def decay_mean(spark, sf_dir):
    return _rounded(timeseries.decay_mean(table(spark, sf_dir, "events"), "user_id", "ts", "value", "2024-02-01", 604800.0))


@query()
def cusum_change_points(spark, sf_dir):
    return timeseries.cusum(table(spark, sf_dir, "events"), "event_type", "value", ["ts", "event_id"], 50.0, 5.0, 200.0)


@query(
    """WITH p AS (SELECT CAST(user_id AS VARCHAR) AS series, epoch_us(ts) // 1000000 AS t, max(value) AS value FROM events GROUP BY 1, 2),
    g AS (SELECT series, unnest(range(CAST(min(t) // 86400 AS BIGINT) * 86400, CAST(max(t) AS BIGINT) + 86400, 86400)) AS t FROM p GROUP BY series)
    SELECT g.series, g.t, p.value FROM g ASOF LEFT JOIN p ON g.series = p.series AND g.t >= p.t"""
)
def resample_hold(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p = e.groupBy(F.col("user_id").cast("string").alias("series"), F.floor(timeseries.micros(F.col("ts")) / 1_000_000).alias("t")).agg(F.max("value").alias("value"))
    day = F.lit(86400).cast("long")
    g = p.groupBy("series").agg(F.min("t").alias("a"), F.max("t").alias("b")).select("series", F.explode(F.sequence(F.floor(F.col("a") / 86400) * day, F.col("b") + 86399, day)).alias("t"))
    return timeseries.resample(p, g, "hold")


# --- graph
_CN = "SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst FROM customer"
_NR = "SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation"
_OC = "SELECT 'order:' || o_orderkey AS src, 'customer:' || o_custkey AS dst FROM orders"


@query(
    f"""WITH RECURSIVE e AS ({_CN} UNION ALL {_NR} UNION ALL {_OC}), w(id, depth) AS (SELECT 'order:' || o_orderkey, 0 FROM orders WHERE o_totalprice > 400000 UNION SELECT e.dst, depth + 1 FROM w JOIN e ON e.src = w.id WHERE depth < 3)
    SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY id HAVING min(depth) >= 1"""
)
def traverse_khop(spark, sf_dir):
    seeds = nodes(spark, sf_dir).where("label = 'order' AND value > 400000").select("id")
    return graph.traverse(edges(spark, sf_dir, "LOCATED_IN", "PART_OF", "PLACED_BY").select("src", "dst"), seeds, 1, 3)


@query(
    f"""WITH e AS ({_OC} UNION ALL {_CN}) SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY id"""
)
def degree_centrality(spark, sf_dir):
    e = edges(spark, sf_dir, "PLACED_BY").unionByName(edges(spark, sf_dir, "LOCATED_IN").where("src LIKE 'customer:%'"))
    return _longs(graph.degrees(e), "out_degree", "in_degree")


_SUP = "SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey WHERE a.l_quantity > {q} AND b.l_quantity > {q}"


def _suppliers(spark, sf_dir, q=None):
    """Suppliers that fill the same order, with items of more than q where a query's SQL has it so."""
    items = table(spark, sf_dir, "lineitem")
    big = (items if q is None else items.where(F.col("l_quantity") > q)).select("l_orderkey", "l_suppkey").distinct()
    parts = graph.parts_of(items)
    big = big.repartition(parts, "l_orderkey")
    a, b = big.withColumnRenamed("l_suppkey", "src"), big.withColumnRenamed("l_suppkey", "dst")
    return a.join(b, "l_orderkey").where("src < dst").select("src", "dst").repartition(parts, "src", "dst").distinct()


@query(
    f"""WITH p AS ({_SUP.format(q=40)}), u AS (SELECT src AS x, dst AS y FROM p UNION ALL SELECT dst, src FROM p), d AS (SELECT x, count(*) AS d FROM u GROUP BY x),
    t AS (SELECT a.x, count(*) / 2 AS t FROM u a JOIN u b ON a.y = b.x JOIN u c ON b.y = c.x AND c.y = a.x GROUP BY a.x)
    SELECT d.x AS id, CAST(coalesce(t, 0) AS BIGINT) AS triangles, round(CASE WHEN d < 2 THEN 0.0 ELSE 2.0 * coalesce(t, 0) / (d * (d - 1)) END, 6) AS coefficient FROM d LEFT JOIN t ON d.x = t.x"""
)
def triangle_count(spark, sf_dir):
    return _rounded(graph.triangles(_suppliers(spark, sf_dir, 40)))


@query(
    f"""WITH RECURSIVE p AS ({_SUP.format(q=49)}), u AS (SELECT src AS x, dst AS y FROM p UNION ALL SELECT dst, src FROM p), w(id, r) AS (SELECT x, x FROM u UNION SELECT w.id, u.y FROM w JOIN u ON u.x = w.r)
    SELECT id, min(r) AS component FROM w GROUP BY id"""
)
def connected_components(spark, sf_dir):
    return graph.components(_suppliers(spark, sf_dir, 49))


@query()
def pagerank(spark, sf_dir):
    return _rounded(graph.pagerank(edges(spark, sf_dir, "PLACED_BY", "LOCATED_IN", "PART_OF"), tol=1e-6, most=30), 5)


@query()
def personalized_pagerank(spark, sf_dir):
    seeds = spark.createDataFrame([("customer:1",)], "id string")
    return _rounded(graph.pagerank(edges(spark, sf_dir, "PLACED_BY", "LOCATED_IN", "PART_OF"), tol=1e-6, most=30, seeds=seeds), 5)


@query()
def label_propagation(spark, sf_dir):
    return graph.label_propagation(_suppliers(spark, sf_dir), 5)


@query()
def k_core(spark, sf_dir):
    return _longs(graph.k_core(_suppliers(spark, sf_dir)), "coreness")


_BUY = "SELECT DISTINCT o_custkey AS src, l_partkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey"


def _bought(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


@query(
    f"""WITH e AS ({_BUY}), n AS (SELECT src, count(*) AS n FROM e GROUP BY src), c AS (SELECT p.src AS a, q.src AS b, count(*) AS c FROM e p JOIN e q ON p.dst = q.dst AND p.src < q.src GROUP BY 1, 2)
    SELECT a, b, round(c / (x.n + y.n - c), 6) AS score FROM c JOIN n x ON a = x.src JOIN n y ON b = y.src WHERE c / (x.n + y.n - c) > 0.05"""
)
def jaccard_similarity(spark, sf_dir):
    return _rounded(graph.similarity(_bought(spark, sf_dir), "jaccard", 0.05))


@query(
    f"""WITH p AS ({_SUP.format(q=47)}), u AS (SELECT src AS x, dst AS y FROM p UNION ALL SELECT dst, src FROM p), d AS (SELECT x, count(*) AS d FROM u GROUP BY x)
    SELECT p.x AS a, q.x AS b, count(*) AS common, round(count(*) / (any_value(da.d) + any_value(db.d) - count(*)), 6) AS jaccard, round(sum(1 / ln(m.d)), 6) AS adamic_adar, any_value(da.d) * any_value(db.d) AS attachment
    FROM u p JOIN u q ON p.y = q.y AND p.x < q.x JOIN d m ON m.x = p.y JOIN d da ON da.x = p.x JOIN d db ON db.x = q.x GROUP BY 1, 2"""
)
def link_features(spark, sf_dir):
    return _rounded(graph.link_features(_suppliers(spark, sf_dir, 47)))


@query(
    """WITH p AS (SELECT 'customer:' || c_custkey AS id, 0.3 AS p FROM customer WHERE c_acctbal > 9000), n AS (SELECT 'nation:' || c_nationkey AS id, 1 - product(1 - 0.1 * 0.3) AS p FROM customer WHERE c_acctbal > 9000 GROUP BY 1),
    r AS (SELECT 'region:' || n_regionkey AS id, 1 - product(1 - 0.1 * p) AS p FROM n JOIN nation ON n.id = 'nation:' || n_nationkey GROUP BY 1)
    SELECT id, round(p, 6) AS p FROM (SELECT * FROM p UNION ALL SELECT * FROM n UNION ALL SELECT * FROM r)"""
)
def noisy_or_propagation(spark, sf_dir):
    e = edges(spark, sf_dir, "LOCATED_IN", "PART_OF").where("src NOT LIKE 'supplier:%'").withColumn("w", F.lit(0.1))
    seeds = nodes(spark, sf_dir).where("label = 'customer' AND value > 9000").select("id", F.lit(0.3).alias("prior"))
    return _rounded(graph.noisy_or(e, seeds, 3))


@query()
def shortest_paths(spark, sf_dir):
    e = graph.held(_suppliers(spark, sf_dir)).withColumn("w", F.abs(F.col("src") - F.col("dst")).cast("double"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return graph.shortest_paths(both, both.agg(F.min("src").alias("id")))


# --- retrieval
_COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 7) AS DOUBLE[]))"


def _vector(spark, sf_dir, vec_id):
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 20")
def vector_topk_cosine(spark, sf_dir):
    return _rounded(retrieval.top_k(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 7), 20))


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings WHERE label IN (1, 3) ORDER BY {_COS} DESC, vec_id LIMIT 20")
def vector_filtered_topk(spark, sf_dir):
    return _rounded(retrieval.top_k(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 7), 20, where=F.col("label").isin(1, 3)))


@query(
    """SELECT query, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS query, v.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) DESC, v.vec_id) AS rank
    FROM (SELECT * FROM embeddings WHERE label = 2) q CROSS JOIN embeddings v) WHERE rank <= 3"""
)
def knn_join(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return _rounded(retrieval.knn_join(v, v.where("label = 2").select(F.col("vec_id").alias("query"), "embedding"), 3))


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS t FROM documents), c AS (SELECT doc_id, len(t) AS l, len(list_filter(t, lambda x: x = 'mit')) AS f, len(list_filter(t, lambda x: x = 'license')) AS g FROM w),
    s AS (SELECT count(*) AS n, avg(l) AS a, sum((f > 0)::INT) AS df, sum((g > 0)::INT) AS dg FROM c)
    SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a)) + ln(1 + (n - dg + 0.5) / (dg + 0.5)) * g * 2.2 / (g + 1.2 * (0.25 + 0.75 * l / a)) AS score FROM c, s) WHERE score > 0"""
)
def bm25_search(spark, sf_dir):
    return _rounded(retrieval.bm25(table(spark, sf_dir, "documents"), ["mit", "license"]))


@query(
    """WITH a AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS rank FROM customer QUALIFY rank < 50),
    b AS (SELECT o_custkey AS id, row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_custkey) - 1 AS rank FROM orders GROUP BY o_custkey QUALIFY rank < 50)
    SELECT id, round(sum(1 / (60.0 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id"""
)
def rrf_fusion(spark, sf_dir):
    def ranked(df, *order):
        top = df.orderBy(*order).limit(50)
        return top.select("id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"))

    a = ranked(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), F.desc("c_acctbal"), "id")
    b = ranked(table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("t")), F.desc("t"), "id")
    return _rounded(retrieval.rrf([a, b]), 9)


@query(
    r"""SELECT doc_id, text[greatest(p - 40, 1):p - 1] || '<' || w || '>' || text[p + len(w):p + len(w) + 39] AS snippet FROM (SELECT doc_id, text, regexp_extract(text, '(?is)^(.*?)(?:^|[^\p{L}\p{N}])(license)(?:$|[^\p{L}\p{N}])', 2) AS w,
    len(regexp_extract(text, '(?is)^(.*?(?:^|[^\p{L}\p{N}]))(license)(?:$|[^\p{L}\p{N}])', 1)) + 1 AS p FROM documents) WHERE w <> ''"""
)
def text_snippets(spark, sf_dir):
    return retrieval.snippets(table(spark, sf_dir, "documents"), ["license"])


@query()
def rerank_mmr(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in _vector(spark, sf_dir, 7)])
    return retrieval.mmr(v.select("vec_id", "embedding", retrieval.cosine(F.col("embedding"), q).alias("score")), 0.7, 20)


# --- event patterns, mining
_E = "SELECT user_id AS key, event_type AS type, epoch_us(ts) / 1e6 AS t, event_id AS id FROM events"


@query(
    f"""WITH e AS ({_E}) SELECT a.key, a.id, round(min(c.t), 3) AS "end" FROM e a JOIN e b ON a.key = b.key AND b.type = 'click' AND (b.t, b.id) > (a.t, a.id) JOIN e c ON c.key = a.key AND c.type = 'purchase' AND (c.t, c.id) > (b.t, b.id)
    WHERE a.type = 'view' GROUP BY a.key, a.id, a.t HAVING min(c.t) - a.t <= 86400"""
)
def cep_sequence(spark, sf_dir):
    return patterns.sequence(_events(spark, sf_dir), ["view", "click", "purchase"], 86400).withColumn("end", F.round("end", 3))


@query(f"WITH e AS ({_E}) SELECT key, id FROM e a WHERE type = 'error' AND NOT EXISTS (SELECT 1 FROM e b WHERE b.key = a.key AND b.type = 'purchase' AND (b.t, b.id) > (a.t, a.id) AND b.t - a.t <= 7200)")
def cep_absence(spark, sf_dir):
    return patterns.absence(_events(spark, sf_dir), "error", "purchase", 7200)


@query(
    f"""WITH e AS ({_E}), g AS (SELECT *, CAST(coalesce(t - lag(t) OVER w > 3600, FALSE) AS BIGINT) AS new FROM e WINDOW w AS (PARTITION BY key ORDER BY t, id)), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY key ORDER BY t, id) AS BIGINT) AS session FROM g)
    SELECT key, session, round(min(t), 3) AS start, round(max(t), 3) AS "end", count(*) AS n FROM s GROUP BY key, session"""
)
def session_windows(spark, sf_dir):
    return patterns.sessions(_events(spark, sf_dir), 3600).withColumn("start", F.round("start", 3)).withColumn("end", F.round("end", 3))


@query(f"SELECT type AS a, b, count(*) AS n FROM (SELECT type, lead(type) OVER (PARTITION BY key ORDER BY t, id) AS b FROM ({_E})) WHERE b IS NOT NULL GROUP BY 1, 2")
def dfg_mining(spark, sf_dir):
    return patterns.directly_follows(_events(spark, sf_dir))


@query()
def alpha_footprint(spark, sf_dir):
    return patterns.footprint(patterns.directly_follows(_events(spark, sf_dir)))


@query(
    """WITH i AS (SELECT DISTINCT l_orderkey AS basket, l_suppkey AS item FROM lineitem), t AS (SELECT count(DISTINCT basket) AS t FROM i), c AS (SELECT item, count(*) AS c FROM i GROUP BY item HAVING count(*) >= 20),
    p AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM i x JOIN i y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 20)
    SELECT a, b, n, round(n / t, 6) AS support, round(n / ca.c, 6) AS confidence, round(n * t / (ca.c * cb.c), 6) AS lift FROM p, t, c ca, c cb WHERE ca.item = a AND cb.item = b"""
)
def association_pairs(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_suppkey").alias("item")).distinct()
    return _rounded(patterns.association(i, 20))


@query(
    """WITH m AS (SELECT avg(y) FILTER (t AND p) AS tp, avg(y) FILTER (t AND NOT p) AS tb, avg(y) FILTER (NOT t AND p) AS cp, avg(y) FILTER (NOT t AND NOT p) AS cb FROM (SELECT value AS y, user_id % 2 = 0 AS t, ts >= TIMESTAMP '2024-01-15' AS p FROM events))
    SELECT round(tp, 6) AS tp, round(tb, 6) AS tb, round(cp, 6) AS cp, round(cb, 6) AS cb, round(tp - tb - (cp - cb), 6) AS effect, round((tp - tb - (cp - cb)) / tb, 6) AS relative FROM m"""
)
def diff_in_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("value").alias("y"), (F.col("user_id") % 2 == 0).alias("treated"), (F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).alias("post"))
    return _rounded(patterns.diff_in_diff(e))


@query(
    r"""WITH r AS (SELECT p_partkey AS id, p_brand AS block, list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '\W+'), lambda t: t <> '')) AS t FROM part)
    SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 6) AS score FROM r a JOIN r b ON a.block = b.block AND a.id < b.id WHERE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.5"""
)
def entity_resolution(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("block"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return _rounded(patterns.entity_pairs(p, 0.5))


@query(
    """WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1), d AS (SELECT e.event_id, e.event_type, value - m AS d FROM events e JOIN m USING (event_type)), a AS (SELECT event_type, median(abs(d)) AS a FROM d GROUP BY 1)
    SELECT event_id, round(0.6745 * d / a, 4) AS score, abs(0.6745 * d / a) > 1.5 AS flag FROM d JOIN a USING (event_type)"""
)
def robust_anomalies(spark, sf_dir):
    r = patterns.robust_anomalies(table(spark, sf_dir, "events"), "event_type", "value", 1.5)
    return r.select("event_id", F.round("score", 4).alias("score"), "flag")


@query()
def frequent_item_sets(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("items"))
    return statistics.frequent_sets(b, "items", 0.02)


@query()
def frequent_sequences(spark, sf_dir):
    w = _events(spark, sf_dir).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("t", "id", "type"))).alias("l"))
    return statistics.frequent_sequences(w.select(F.transform("l", lambda e: F.array(e["type"])).alias("s")), "s", 0.1)


@query()
def k_means(spark, sf_dir):
    return statistics.k_means(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)


# --- finance
_RET = "SELECT o_custkey AS g, o_orderkey AS id, o_orderdate AS d, o_totalprice / lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS r FROM orders"


def _returns(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("d"), (F.col("o_totalprice") / F.lag("o_totalprice").over(w) - 1).alias("r")).where("r IS NOT NULL")


@query(
    f"""WITH x AS (SELECT g, r, row_number() OVER (PARTITION BY g ORDER BY r, id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM ({_RET}) WHERE r IS NOT NULL), k AS (SELECT *, CAST(floor(0.05 * n + 1e-9) AS BIGINT) AS s FROM x)
    SELECT g, round(-max(CASE WHEN i = least(s, n - 1) THEN r END), 6) AS var, round(-avg(CASE WHEN i < least(greatest(s, 1), n) THEN r END), 6) AS cvar FROM k GROUP BY g"""
)
def hist_var_cvar(spark, sf_dir):
    return _rounded(finance.tail_risk(_returns(spark, sf_dir), "g", "r", ["id"]))


@query(
    f"""WITH x AS (SELECT *, product(1 + r) OVER w AS wealth FROM ({_RET}) WHERE r IS NOT NULL WINDOW w AS (PARTITION BY g ORDER BY d, id ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, greatest(max(wealth) OVER (PARTITION BY g ORDER BY d, id ROWS UNBOUNDED PRECEDING), 1.0) AS peak FROM x)
    SELECT g, round(max((peak - wealth) / peak), 6) AS max_drawdown FROM p GROUP BY g"""
)
def max_drawdown(spark, sf_dir):
    d = finance.drawdowns(_returns(spark, sf_dir), "g", "r", ["d", "id"])
    return _rounded(d.groupBy("g").agg(F.max("drawdown").alias("max_drawdown")))


@query(f"SELECT g, round(avg(r), 6) AS mean, round(stddev_samp(r), 5) AS sd, round(sqrt(avg(least(r, 0.0) * least(r, 0.0))), 6) AS downside, round(avg(r) / stddev_samp(r), 5) AS sharpe FROM ({_RET}) WHERE r IS NOT NULL GROUP BY g")
def risk_metrics(spark, sf_dir):
    m = finance.risk_metrics(_returns(spark, sf_dir), "g", "r")
    return m.select("g", F.round("mean", 6).alias("mean"), F.round("sd", 5).alias("sd"), F.round("downside", 6).alias("downside"), F.round("sharpe", 5).alias("sharpe"))


@query("SELECT c_custkey, round(CASE WHEN count(*) OVER (PARTITION BY c_nationkey) = 1 THEN 0.5 ELSE percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) END, 6) AS rank FROM customer")
def cross_sectional_rank(spark, sf_dir):
    return _rounded(finance.cross_sectional_rank(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal").select("c_custkey", "rank"))


@query("SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS vwap FROM lineitem GROUP BY 1")
def vwap(spark, sf_dir):
    return _rounded(finance.vwap(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", "l_quantity"), 4)


@query("SELECT a, b, round(n / sum(n) OVER (PARTITION BY a), 6) AS p FROM (SELECT event_type AS a, b, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY 1, 2)")
def markov_transitions(spark, sf_dir):
    return _rounded(finance.markov_transitions(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"]))


@query("SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS lambda FROM lineitem GROUP BY 1")
def kyle_lambda(spark, sf_dir):
    return _rounded(finance.kyle_lambda(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", "l_quantity"), 4)


@query(
    """WITH r AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS a, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
    SELECT l_suppkey, round(corr(a, b), 6) AS ic FROM r GROUP BY 1"""
)
def information_coefficient(spark, sf_dir):
    return _rounded(finance.information_coefficient(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice"))


# --- uncertainty, metrics
_PY = "SELECT c_custkey AS id, (c_acctbal + 1000) / 11000 AS p, CAST(c_nationkey % 2 AS DOUBLE) AS y FROM customer"


def _forecast(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_acctbal") + 1000) / 11000).alias("p"), (F.col("c_nationkey") % 2).cast("double").alias("y"))


@query(f"SELECT round(avg((p - y) * (p - y)), 6) AS brier FROM ({_PY})")
def brier_score(spark, sf_dir):
    return _rounded(_forecast(spark, sf_dir).agg(finance.brier_score(F.col("p"), F.col("y")).alias("brier")))


@query(f"SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(y), 6) AS accuracy FROM ({_PY}) GROUP BY 1")
def reliability_bins(spark, sf_dir):
    return _rounded(uncertainty.reliability(_forecast(spark, sf_dir), "p", "y"))


@query(
    """SELECT c_nationkey, round(coalesce(max(CASE WHEN r = ceil((n + 1) * 0.9 - 1e-9) THEN c_acctbal END), 'inf'::DOUBLE), 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) GROUP BY 1"""
)
def split_conformal(spark, sf_dir):
    return _rounded(uncertainty.split_conformal(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal", 0.1))


@query(f"SELECT round(avg(0.5 / (0.1 + 0.8 * p) * y), 6) AS ips, round(sum(0.5 / (0.1 + 0.8 * p) * y) / sum(0.5 / (0.1 + 0.8 * p)), 6) AS snips FROM ({_PY})")
def off_policy_evaluation(spark, sf_dir):
    rows = _forecast(spark, sf_dir).withColumn("target", F.lit(0.5)).withColumn("logged", 0.1 + 0.8 * F.col("p"))
    return _rounded(uncertainty.off_policy(rows, "y", "target", "logged"))


@query("SELECT event_type, round(sum(value / (1 + user_id)) / sum(1 / (1 + user_id)), 6) AS mean, round(1 / sum(1 / (1 + user_id)), 8) AS var FROM events GROUP BY 1")
def fuse_gaussians(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", (1 + F.col("user_id")).cast("double"))
    f = uncertainty.fuse_gaussians(e, "event_type", "value", "v")
    return f.select("event_type", F.round("mean", 6).alias("mean"), F.round("var", 8).alias("var"))


@query(
    """WITH s AS (SELECT l_orderkey, max(l_shipdate) AS u FROM lineitem GROUP BY 1) SELECT o_orderkey FROM orders LEFT JOIN s ON l_orderkey = o_orderkey WHERE o_orderdate <= TIMESTAMP '1996-01-01' AND (u IS NULL OR TIMESTAMP '1996-01-01' < u)"""
)
def asof_bitemporal(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    until = l.groupBy("l_orderkey").agg(timeseries.micros(F.max("l_shipdate")).alias("u"))
    t = timeseries.micros(F.lit("1996-01-01").cast("timestamp_ntz"))
    rows = o.join(until, o.o_orderkey == until.l_orderkey, "left").withColumn("f", timeseries.micros(F.col("o_orderdate"))).withColumn("t", t)
    return rows.where((F.coalesce("f", F.lit(0)) <= F.col("t")) & (F.col("u").isNull() | (F.col("t") < F.col("u")))).select("o_orderkey")


@query(f"SELECT round(avg((y - p) ** 2), 6) AS mse, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(y)), 6) AS r2 FROM ({_PY})")
def regression_metrics(spark, sf_dir):
    return _rounded(statistics.regression_metrics(_forecast(spark, sf_dir), "y", "p"))


@query(
    f"""WITH s AS (SELECT y, CAST(p >= 0.5 AS DOUBLE) AS p FROM ({_PY})), c AS (SELECT DISTINCT y AS c FROM s UNION SELECT DISTINCT p FROM s), f AS (SELECT c, 2.0 * sum((y = c AND p = c)::INT) / (sum((y = c)::INT) + sum((p = c)::INT)) AS f FROM c, s GROUP BY c)
    SELECT round((SELECT avg((y = p)::INT) FROM s), 6) AS accuracy, round(avg(f), 6) AS macro_f1 FROM f"""
)
def classification_metrics(spark, sf_dir):
    rows = _forecast(spark, sf_dir).withColumn("said", (F.col("p") >= 0.5).cast("double"))
    return _rounded(statistics.classification_metrics(rows, "y", "said"))


@query(
    """WITH c AS (SELECT value AS v, sum((user_id % 2 = 0)::INT) AS a, sum((user_id % 2 <> 0)::INT) AS b FROM events GROUP BY 1), t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM c)
    SELECT round(max(abs(x / ta - y / tb)), 6) AS ks FROM (SELECT sum(a) OVER (ORDER BY v) AS x, sum(b) OVER (ORDER BY v) AS y FROM c), t"""
)
def ks_two_sample(spark, sf_dir):
    return _rounded(statistics.ks_two_sample(table(spark, sf_dir, "events").withColumn("odd", F.col("user_id") % 2 != 0), "value", "odd"))


@query("SELECT c_custkey, round(exp((c_acctbal - max(c_acctbal) OVER w) / 1000) / sum(exp((c_acctbal - m) / 1000)) OVER w, 9) AS p FROM (SELECT *, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS m FROM customer) WINDOW w AS (PARTITION BY c_nationkey)")
def softmax(spark, sf_dir):
    return _rounded(statistics.softmax(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal", 1000.0).select("c_custkey", "p"), 9)


# --- space, triples, shapes
@query("SELECT c_custkey, round(2 * 6371.0088 * asin(sqrt(least(1.0, power(sin(radians(b - a) / 2), 2) + cos(radians(a)) * cos(radians(b)) * power(sin(radians(c_nationkey * 7.0 - 10) / 2), 2)))), 6) AS km FROM (SELECT c_custkey, c_nationkey, c_custkey % 80 + 0.5 AS a, c_nationkey * 3.0 - 30 AS b FROM customer)")
def haversine(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a, b = F.col("c_custkey") % 80 + 0.5, F.col("c_nationkey") * 3.0 - 30
    return _rounded(c.select("c_custkey", spatial.haversine_km(a, F.lit(10.0), b, F.col("c_nationkey") * 7.0).alias("km")))


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 950 AND 1500")
def spatial_bbox(spark, sf_dir):
    return table(spark, sf_dir, "part").where(spatial.bbox(F.col("p_size"), F.col("p_retailprice"), (10, 950, 20, 1500))).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size >= 0 AND p_size < 40 AND p_retailprice > 25.0 * p_size AND p_retailprice < 1000 AND p_retailprice > 0")
def spatial_within(spark, sf_dir):
    ring = [(0.0, 0.0), (40.0, 1000.0), (0.0, 1000.0)]
    return table(spark, sf_dir, "part").where(spatial.within_polygon(F.col("p_size").cast("double"), F.col("p_retailprice"), ring)).select("p_partkey")


@query("SELECT c_name AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def sparql_pattern(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    triples = c.select("c_name", F.lit("in"), F.concat(F.lit("n"), "c_nationkey")).union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.lit("name"), "n_name")).union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.lit("part"), F.concat(F.lit("r"), "n_regionkey"))).union(r.select(F.concat(F.lit("r"), "r_regionkey"), F.lit("name"), "r_name")).toDF("s", "p", "o")
    return rules.match(triples, [("?c", "in", "?x"), ("?x", "part", "?r"), ("?r", "name", "ASIA"), ("?x", "name", "?n")]).select("c", "n")


@query("SELECT CAST(c_custkey AS VARCHAR) AS focus, 'c_acctbal' AS path, 'range' AS constraint FROM customer WHERE NOT c_acctbal BETWEEN 0 AND 9000 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'c_mktsegment', 'in' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def shape_violations(spark, sf_dir):
    return rules.violations(table(spark, sf_dir, "customer"), "c_custkey", allowed={"c_mktsegment": ["BUILDING", "MACHINERY"]}, ranges={"c_acctbal": (0, 9000)})


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT 'order:' || o_orderkey AS s, 'customer:' || o_custkey AS o FROM orders WHERE o_totalprice > 380000 UNION SELECT src, dst FROM ({_CN}) UNION SELECT src, dst FROM ({_NR})), w(a, b) AS (SELECT s, o FROM e UNION SELECT w.a, e.o FROM w JOIN e ON w.b = e.s)
    SELECT a, b FROM w"""
)
def transitive_closure(spark, sf_dir):
    big = nodes(spark, sf_dir).where("label = 'order' AND value > 380000").select(F.col("id").alias("src"))
    e = edges(spark, sf_dir, "PLACED_BY").join(big, "src", "left_semi").select("src", "dst").unionByName(edges(spark, sf_dir, "LOCATED_IN", "PART_OF").where("src NOT LIKE 'supplier:%'").select("src", "dst"))
    return rules.closure(e.toDF("a", "b"))


# --- pipe language, streams, lake
def _graph(spark, sf_dir):
    return nodes(spark, sf_dir), edges(spark, sf_dir)


@query(
    "SELECT 'customer:' || c_custkey AS id, c_acctbal AS score FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000 AND NOT ('order:' || o_orderkey) LIKE '%7') ORDER BY c_acctbal DESC, 'customer:' || c_custkey LIMIT 25"
)
def pipe_query(spark, sf_dir):
    from . import pipes

    text = "MATCH (:order) WHERE value > $least AND NOT id LIKE '%7' |> TRAVERSE -[:PLACED_BY]->{1,1} |> RANK BY value DESC |> LIMIT 25"
    return pipes.run(text, *_graph(spark, sf_dir), {"least": 300000}).select("id", "score")


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_acctbal > 5000 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)")
def pipe_let_join(spark, sf_dir):
    from . import pipes

    text = "LET rich = MATCH (:customer) WHERE value > 5000; LET big = MATCH (:order) WHERE value > 350000 |> TRAVERSE -[:PLACED_BY]->{1,1}; FROM rich JOIN big"
    return pipes.run(text, *_graph(spark, sf_dir)).select("id")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    from ..streaming import windows

    s = windows.file_stream(spark, sf_dir, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.drain(windows.windowed(s, "ts", ["event_type"], "1 day", n=F.count(F.lit(1)), total=F.sum("value")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, CAST(coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000, FALSE) AS INT) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_sessions(spark, sf_dir):
    from ..streaming import windows

    s = windows.file_stream(spark, sf_dir, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.drain(windows.sessions(s, "ts", "user_id", "30 minutes"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query()
def stream_sequences(spark, sf_dir):
    from ..streaming import windows

    s = windows.file_stream(spark, sf_dir, "events.parquet").select("user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return windows.drain(windows.sequences(s, "user_id", "event_type", "t", "signup", "purchase", 3600.0), "append")


@query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1")
def zset_view(spark, sf_dir):
    from ..streaming import changes

    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    state = c.withColumn("weight", F.lit(1))
    gone = c.where("c_custkey % 3 = 0").withColumn("weight", F.lit(-1))
    view = changes.aggregated(changes.apply(state, gone), ["c_mktsegment"], "c_acctbal")
    return view.select("c_mktsegment", "n", F.round("total", 2).alias("total"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10")
def lake_as_of(spark, sf_dir):
    from ..sources.lake import Table

    t = Table(spark, scratch(spark))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    first = t.write(n.where("n_nationkey < 10"))
    t.write(n.where("n_nationkey >= 10"))
    t.write(n.where("n_nationkey = 0"), "overwrite")
    return t.read(first)


@query("SELECT max(n_nationkey) AS hi, min(n_nationkey) AS lo, count(*) AS n FROM nation")
def lake_zone_map(spark, sf_dir):
    from ..sources.lake import Table

    t = Table(spark, scratch(spark))
    t.write(table(spark, sf_dir, "nation"))
    z = t.zone_map(["n_nationkey"])
    return z.agg(F.max("max_n_nationkey").alias("hi"), F.min("min_n_nationkey").alias("lo"), F.sum("rows").alias("n"))


# --- trees of belief, root causes, process of decisions
@query("SELECT event_id, round(value * exp(-ln(2.0) * (user_id + 1) / 7.0), 6) AS weight FROM events")
def ebbinghaus_decay(spark, sf_dir):
    return _rounded(table(spark, sf_dir, "events").select("event_id", (F.col("value") * uncertainty.ebbinghaus(F.col("user_id") + 1, 7.0)).alias("weight")))


@query("SELECT c_custkey, round(greatest((p * 1.5 - (1 - p)) / 1.5, 0.0), 6) AS kelly FROM (SELECT c_custkey, (c_acctbal + 1000) / 11000 AS p FROM customer)")
def kelly_fraction(spark, sf_dir):
    p = (F.col("c_acctbal") + 1000) / 11000
    return _rounded(table(spark, sf_dir, "customer").select("c_custkey", finance.kelly_fraction(p, F.lit(1.5)).alias("kelly")))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - l_tax) / (l_quantity + l_tax), 6) AS imb, round((l_extendedprice * l_tax + (l_extendedprice + 1) * l_quantity) / (l_quantity + l_tax), 4) AS micro FROM lineitem WHERE l_quantity > 0")
def order_book(spark, sf_dir):
    q, t, p = F.col("l_quantity"), F.col("l_tax"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").where("l_quantity > 0").select("l_orderkey", "l_linenumber", F.round(finance.imbalance(q, t), 6).alias("imb"), F.round(finance.microprice(p, p + 1, q, t), 4).alias("micro"))


@query(
    """SELECT k, round(0.3 / (power(100.0 * k, 0.25) * (1 + 0.25 / 24 * ln(100.0 / k) ** 2 + 0.0625 / 1920 * ln(100.0 / k) ** 4)) * CASE WHEN abs(z) < 1e-8 THEN 1 ELSE z / ln((sqrt(1 + 0.6 * z + z * z) + z + 0.3) / 1.3) END
    * (1 + (0.25 / 24 * 0.09 / power(100.0 * k, 0.5) + -0.3 * 0.5 * 0.4 * 0.3 / (4 * power(100.0 * k, 0.25)) + (2 - 3 * 0.09) / 24 * 0.16) * 1.5), 8) AS vol
    FROM (SELECT k, 0.4 / 0.3 * power(100.0 * k, 0.25) * ln(100.0 / k) AS z FROM (SELECT DISTINCT CAST(60 + 2 * p_size AS DOUBLE) AS k FROM part))"""
)
def sabr_smile(spark, sf_dir):
    k = table(spark, sf_dir, "part").select((60 + 2 * F.col("p_size")).cast("double").alias("k")).distinct()
    return _rounded(k.select("k", finance.sabr_implied_vol(F.lit(100.0), F.col("k"), 1.5, 0.3, 0.5, -0.3, 0.4).alias("vol")), 8)


@query(
    """WITH p AS (SELECT event_type, value AS y, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS x FROM events), f AS (SELECT event_type, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p WHERE x IS NOT NULL GROUP BY 1)
    SELECT event_type, round(CASE WHEN b > 0 AND b < 1 THEN -ln(b) END, 5) AS theta, round(a / (1 - b), 5) AS mu FROM f"""
)
def ou_calibrate(spark, sf_dir):
    f = finance.ou_calibrate(table(spark, sf_dir, "events"), "event_type", "value", ["ts", "event_id"])
    return f.select("event_type", F.round("theta", 5).alias("theta"), F.round("mu", 5).alias("mu"))


@query("SELECT c_custkey, CAST(floor((c_custkey % 360 - 180 + 180) / 360.0 * 64) AS BIGINT) AS tx, CAST(floor((1 - ln(tan(radians(c_nationkey * 2.0)) + 1 / cos(radians(c_nationkey * 2.0))) / pi()) / 2 * 64) AS BIGINT) AS ty FROM customer")
def map_tiles(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    x, y = spatial.tile((F.col("c_custkey") % 360 - 180).cast("double"), F.col("c_nationkey") * 2.0, 6)
    return c.select("c_custkey", x.alias("tx"), y.alias("ty"))


@query("SELECT event_type, sum(n * (v + m * m)) / sum(n) - power(sum(n * m) / sum(n), 2) > 0 AS positive, round(sum(n * m) / sum(n), 5) AS mean FROM (SELECT event_type, user_id, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1")
def mixture_moments(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    m = uncertainty.mixture_moments(c, "event_type", "n", "m", "v")
    return m.select("event_type", (F.col("var") > 0).alias("positive"), F.round("mean", 5).alias("mean"))


# --- sequential kernels, metric queries, models
from ..operators import metrics, models, sequential  # noqa: E402


def _daily(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", timeseries.bucket_start(F.col("ts"), 86400).alias("t")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))


@query()
def kalman_level(spark, sf_dir):
    return _rounded(sequential.kalman_level(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "event_id", "value", 0.1, 1.0))


@query()
def kalman_beta(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return _rounded(sequential.kalman_beta(l, "l_suppkey", ["l_shipdate", "id"], "id", "l_quantity", "l_extendedprice", 1.0, 100.0), 4)


@query()
def matrix_profile(spark, sf_dir):
    return _rounded(sequential.matrix_profile(_daily(spark, sf_dir), "event_type", ["t"], "value", 5))


@query()
def motif_like(spark, sf_dir):
    return _rounded(sequential.motif_like(_daily(spark, sf_dir), "event_type", ["t"], "value", [1.0, 2.0, 3.0, 2.0, 1.0], 3))


@query()
def holt_winters(spark, sf_dir):
    return _rounded(sequential.holt_winters(_daily(spark, sf_dir), "event_type", ["t"], "value", 7, 0.3, 0.1, 0.2, 7))


@query()
def pelt_change_points(spark, sf_dir):
    return sequential.pelt(_daily(spark, sf_dir), "event_type", ["t"], "value", 50.0)


_SAMPLE = "SELECT event_type AS series, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS t, max(value) AS value FROM events GROUP BY 1, 2"


def _samples(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("series"), F.floor(timeseries.micros(F.col("ts")) / 1_000_000).cast("long").alias("t")).agg(F.max("value").alias("value"))


@query(duckdb_text("range_frame"))
def range_frame(spark, sf_dir):
    """The statement of sql_surface.py, planned by hand: Spark would walk each row's whole frame, in one task for each priority.

    Values are counted once and cut into cells of the frame's half width. A frame
    is its value's own cell, and the parts of the cells beside that running counts give.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("v"))
    cell = F.floor(F.col("v") / 1000)
    counts = graph.held(o.groupBy("p", "v").agg(F.count(F.lit(1)).alias("c")).withColumn("cell", cell))
    rows = counts.select("p", "cell", F.col("v").alias("at"), "c", F.lit(0).alias("asked"), "v")
    ask = lambda way: counts.where("v IS NOT NULL").select("p", (F.col("cell") + way).alias("cell"), (F.col("v") + 1000 * way).alias("at"), F.lit(0).cast("long").alias("c"), F.lit(way).alias("asked"), "v")
    both = rows.unionByName(ask(1)).unionByName(ask(-1))
    up, down = (Window.partitionBy("p", "cell").orderBy(order, F.abs("asked")).rowsBetween(Window.unboundedPreceding, 0) for order in (F.asc("at"), F.desc("at")))
    whole = Window.partitionBy("p", "cell")
    seen = F.when(F.col("asked") == 1, F.sum("c").over(up)).when(F.col("asked") == -1, F.sum("c").over(down)).otherwise(F.sum("c").over(whole))
    near = both.withColumn("n", seen).groupBy("p", "v").agg(F.sum("n").alias("near")).select(F.col("p").alias("q"), F.col("v").alias("u"), F.col("near").cast("long").alias("near"))
    return o.join(near, F.col("p").eqNullSafe(F.col("q")) & F.col("v").eqNullSafe(F.col("u"))).select("o_orderkey", "near")


@query(
    f"""SELECT series, t, round(sum(value) OVER w, 4) AS sum, round(avg(value) OVER w, 5) AS avg, min(value) OVER w AS min, max(value) OVER w AS max, count(value) OVER w AS count, round(value - first_value(value) OVER w, 6) AS delta
    FROM ({_SAMPLE}) WINDOW w AS (PARTITION BY series ORDER BY t RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW)"""
)
def promql_over_time(spark, sf_dir):
    o = metrics.over_time(_samples(spark, sf_dir), 7200)
    return o.select("series", "t", F.round("sum", 4).alias("sum"), F.round("avg", 5).alias("avg"), "min", "max", "count", F.round("delta", 6).alias("delta"))


@query(
    f"""WITH s AS ({_SAMPLE}), i AS (SELECT *, coalesce(CASE WHEN value < lag(value) OVER (PARTITION BY series ORDER BY t) THEN value ELSE value - lag(value) OVER (PARTITION BY series ORDER BY t) END, 0) AS i FROM s)
    SELECT series, t, round((sum(i) OVER w - first_value(i) OVER w) / nullif(t - min(t) OVER w, 0), 8) AS rate FROM i WINDOW w AS (PARTITION BY series ORDER BY t RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW)"""
)
def promql_rate(spark, sf_dir):
    return _rounded(metrics.rate(_samples(spark, sf_dir), 7200).select("series", "t", "rate"), 8)


@query(f"SELECT series, t, value FROM ({_SAMPLE}) QUALIFY row_number() OVER (PARTITION BY t // 86400 ORDER BY value DESC, series) <= 2")
def promql_topk(spark, sf_dir):
    s = _samples(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86400))
    return metrics.top_k(s, ["day"], 2).drop("day")


@query("WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem) SELECT l_orderkey * 10 + l_linenumber AS id, round(a + b * l_quantity, 2) AS prediction FROM lineitem, f")
def linear_regression(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return _rounded(models.linear_regression(l, "id", "x", "y"), 2)


@query()
def logistic_classifier(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") < 5).cast("double"))
    return models.classify(v, "vec_id", "embedding", "y").select("vec_id", "prediction")


@query()
def topic_model(spark, sf_dir):
    return models.topics(table(spark, sf_dir, "documents"), 4)


@query()
def gaussian_mixture(spark, sf_dir):
    return models.mixture(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 4)


@query(
    "SELECT 'nation:' || n_nationkey AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000 AND 'customer:' || c_custkey LIKE 'customer:1%' GROUP BY 1"
)
def cypher_match(spark, sf_dir):
    from . import cypher

    text = "MATCH (o:order)-[:PLACED_BY]->(c:customer)-[:LOCATED_IN]->(n) WHERE o.value > 300000 AND c.id STARTS WITH 'customer:1' RETURN n.id AS nation, count(*) AS orders, sum(o.value) AS total"
    return cypher.run(text, *_graph(spark, sf_dir)).withColumn("total", F.round("total", 2))


@query(
    "SELECT 'customer:' || c_custkey AS c, o_orderkey IS NOT NULL AS ordered FROM customer LEFT JOIN (SELECT DISTINCT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE TRUE GROUP BY 1) ON o_custkey = c_custkey WHERE c_acctbal > 9000"
)
def cypher_optional(spark, sf_dir):
    from . import cypher

    text = "MATCH (c:customer) WHERE c.value > 9000 OPTIONAL MATCH (o:order)-[:PLACED_BY]->(c) RETURN c.id AS c, count(o.id) AS n"
    return cypher.run(text, *_graph(spark, sf_dir)).select("c", (F.col("n") > 0).alias("ordered"))


@query("SELECT 'region:' || n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1 ORDER BY n DESC, r LIMIT 3")
def cypher_reverse(spark, sf_dir):
    from . import cypher

    return cypher.run("MATCH (r:region)<-[:PART_OF]-(n:nation) RETURN r.id AS r, count(*) AS n ORDER BY n DESC, r LIMIT 3", *_graph(spark, sf_dir))
