"""Portfolio, backtest and screening queries over the data folder, with their DuckDB SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..catalog import table
from ..operators import portfolio as P
from .library import _rounded, query


def _returns(spark, sf_dir):
    """Daily mean prices of five order priorities as assets, by month of the order."""
    o = table(spark, sf_dir, "orders")
    month = F.date_format("o_orderdate", "yyyy-MM")
    return o.groupBy(F.col("o_orderpriority").alias("asset"), month.alias("t")).agg((F.avg("o_totalprice") / 100000 - 1.5).alias("r"))


_R = "r AS (SELECT o_orderpriority AS asset, strftime(o_orderdate, '%Y-%m') AS t, avg(o_totalprice) / 100000 - 1.5 AS r FROM orders GROUP BY 1, 2), k AS (SELECT t FROM r GROUP BY t HAVING count(*) = (SELECT count(DISTINCT asset) FROM r)), c AS (SELECT a.asset AS a, b.asset AS b, covar_samp(a.r, b.r) AS v FROM r a JOIN r b USING (t) JOIN k USING (t) GROUP BY 1, 2)"


@query(f"WITH {_R} SELECT a, b, round(v, 9) AS covariance FROM c")
def return_covariance(spark, sf_dir):
    names, _, cov = P.moments(_returns(spark, sf_dir), "asset", "t", "r")
    return _rounded(spark.createDataFrame([(a, b, float(cov[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "a string, b string, covariance double"), 9)


@query(f"WITH {_R} SELECT a AS asset, true AS optimal FROM c GROUP BY 1")
def minimum_variance_portfolio(spark, sf_dir):
    """In the least-variance portfolio each asset has the same covariance with the whole, which is the condition of the optimum."""
    names, _, cov = P.moments(_returns(spark, sf_dir), "asset", "t", "r")
    w = P.minimum_variance(cov)
    with_all = cov @ w
    return spark.createDataFrame([(n, bool(np.isclose(x, with_all[0], rtol=1e-6))) for n, x in zip(names, with_all)], "asset string, optimal boolean")


@query(f"WITH {_R} SELECT a AS asset, true AS equal_share, true AS positive FROM c GROUP BY 1")
def risk_parity_portfolio(spark, sf_dir):
    names, _, cov = P.moments(_returns(spark, sf_dir), "asset", "t", "r")
    w = P.risk_parity(cov)
    part = w * (cov @ w)
    return spark.createDataFrame([(n, bool(np.isclose(x, part.mean(), rtol=1e-6)), bool(v > 0)) for n, x, v in zip(names, part, w)], "asset string, equal_share boolean, positive boolean")


@query(
    """SELECT event_type, round(s, 6) AS sharpe FROM (SELECT event_type, avg(x) / stddev_samp(x) AS s FROM (SELECT event_type, value - 49.5 AS x FROM events) GROUP BY 1)"""
)
def sharpe_ratios(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", (F.col("value") - 49.5).alias("x"))
    return _rounded(P.sharpe_statistics(e, "event_type", "x", 10, 0.1).select("event_type", "sharpe"))


@query("SELECT k, round(p, 9) AS p FROM (VALUES (-1.959963984540054::DOUBLE, 0.025::DOUBLE), (-1, 0.15865525393145707), (0, 0.5), (1.2815515655446004, 0.9), (2.3263478740408408, 0.99), (9, 0.9999999990134123)) t(k, p)")
def normal_distribution(spark, sf_dir):
    rows = spark.createDataFrame([(-1.959963984540054,), (-1.0,), (0.0,), (1.2815515655446004,), (2.3263478740408408,), (9.0,)], "k double")
    return rows.select("k", F.round(P.normal_probability(F.col("k")), 9).alias("p"))


@query(
    """WITH s AS (SELECT o_custkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS d, count(*) AS n, sum(o_totalprice) AS t FROM orders WHERE o_totalprice < 200000 AND o_totalprice >= 160000 GROUP BY 1, 2)
    SELECT a.o_custkey, CAST(a.d AS INTEGER) AS day, CAST(sum(b.n) AS BIGINT) AS n, round(sum(b.t), 2) AS total FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND b.d BETWEEN a.d - 89 AND a.d GROUP BY 1, 2 HAVING sum(b.n) >= 2 AND sum(b.t) > 200000"""
)
def structured_payments(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("d"))
    return _rounded(P.screen_payments(o, "o_custkey", "o_totalprice", "d", 200000, 90, 2), 2)


@query("SELECT n_nationkey, round(income / assets - cfo / assets, 9) AS sloan, round(1.2 * (cur - li) / assets + 1.4 * ret / assets + 3.3 * ebit / assets + 0.6 * eq / (debt + li) + sales / assets, 6) AS altman FROM (SELECT n_nationkey, 100.0 + n_nationkey AS assets, 10.0 + n_nationkey AS income, 12.0 AS cfo, 40.0 AS cur, 20.0 AS li, 15.0 AS ret, 14.0 AS ebit, 55.0 AS eq, 25.0 AS debt, 90.0 + n_nationkey AS sales FROM nation)")
def accounting_ratios(spark, sf_dir):
    """Scores of made-up balance sheets, one for each nation."""
    k = F.col("n_nationkey").cast("double")
    now = {"assets": 100 + k, "income": 10 + k, "cfo": F.lit(12.0), "current": F.lit(40.0), "liabilities": F.lit(20.0), "retained": F.lit(15.0), "ebit": F.lit(14.0), "equity": F.lit(55.0), "debt": F.lit(25.0), "sales": 90 + k}
    now |= {n: F.lit(30.0) for n in ("receivables", "gross", "ppe", "depreciation", "sga", "cash", "shares")}
    scores = P.forensic_ratios(now, {n: F.lit(50.0) for n in now})
    return table(spark, sf_dir, "nation").select("n_nationkey", F.round(scores["sloan"], 9).alias("sloan"), F.round(scores["altman"], 6).alias("altman"))
