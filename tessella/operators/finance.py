"""Risk, signals, execution and microstructure over return and price tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import parts_of


def tail_risk(returns: DataFrame, group: str, value: str, order: list[str], confidence: float = 0.95) -> DataFrame:
    """(group, var, cvar), historical: order statistics without interpolation, losses positive."""
    w = Window.partitionBy(group)
    ranked = returns.withColumn("_i", F.row_number().over(w.orderBy(value, *order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    share = F.floor((1 - confidence) * F.col("_n") + 1e-9)
    at = F.least(share, F.col("_n") - 1)
    few = F.least(F.greatest(share, F.lit(1)), F.col("_n"))
    return ranked.groupBy(group).agg(F.max(F.when(F.col("_i") == at, -F.col(value))).alias("var"), (-F.avg(F.when(F.col("_i") < few, F.col(value)))).alias("cvar"))


def drawdowns(returns: DataFrame, group: str, value: str, order: list[str]) -> DataFrame:
    """returns with wealth and drawdown; wealth and its peak start at 1."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.withColumn("wealth", F.product(1 + F.col(value)).over(w))
    peak = F.greatest(F.max("wealth").over(w), F.lit(1.0))
    return rows.withColumn("drawdown", (peak - F.col("wealth")) / peak)


def risk_metrics(returns: DataFrame, group: str, value: str, free: float = 0.0, target: float = 0.0) -> DataFrame:
    """(group, mean, sd, sharpe, downside): sample deviation; downside is the root mean square below target."""
    below = F.least(F.col(value) - target, F.lit(0.0))
    m = returns.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.sqrt(F.avg(below * below)).alias("downside"))
    return m.withColumn("sharpe", F.try_divide(F.col("mean") - free, F.col("sd")))


def cross_sectional_rank(rows: DataFrame, by: str, value: str) -> DataFrame:
    """rows with rank (position - 1) / (n - 1); a single value has 0.5."""
    w = Window.partitionBy(by)
    return rows.withColumn("rank", F.when(F.count(value).over(w) == 1, F.lit(0.5)).otherwise(F.percent_rank().over(w.orderBy(value))))


def vwap(trades: DataFrame, group: str, price: str, volume: str) -> DataFrame:
    return trades.groupBy(group).agg(F.try_divide(F.sum(F.col(price) * F.col(volume)), F.sum(volume)).alias("vwap"))


def imbalance(bid: Column, ask: Column) -> Column:
    return F.coalesce(F.try_divide(bid - ask, bid + ask), F.lit(0.0))


def microprice(bid: Column, ask: Column, bid_size: Column, ask_size: Column) -> Column:
    return F.try_divide(bid * ask_size + ask * bid_size, bid_size + ask_size)


def kelly_fraction(p: Column, odds: Column) -> Column:
    return F.greatest(F.try_divide(p * odds - (1 - p), odds), F.lit(0.0))


def kyle_lambda(rows: DataFrame, group: str, change: str, flow: str) -> DataFrame:
    return rows.groupBy(group).agg(F.regr_slope(change, flow).alias("lambda"))


def avellaneda_stoikov(mid: Column, inventory: Column, sigma: float, gamma: float, kappa: float, tau: float) -> tuple[Column, Column]:
    """Bid and ask around the reservation price."""
    centre = mid - inventory * gamma * sigma**2 * tau
    half = gamma * sigma**2 * tau / 2 + math.log(1 + gamma / kappa) / gamma
    return centre - half, centre + half


def markov_transitions(rows: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """(a, b, p): share of moves from state a that go to b."""
    moves = rows.select(F.col(state).alias("a"), F.lead(state).over(Window.partitionBy(key).orderBy(*order)).alias("b")).where("b IS NOT NULL")
    counts = moves.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("a", "b", (F.col("n") / F.sum("n").over(Window.partitionBy("a"))).alias("p"))


def ou_calibrate(rows: DataFrame, key: str, value: str, order: list[str], dt: float = 1.0) -> DataFrame:
    """(key, theta, mu, sigma) of an Ornstein-Uhlenbeck process, by regression of x on its predecessor; null unless mean-reverting."""
    pairs = rows.select(key, F.col(value).alias("y"), F.lag(value).over(Window.partitionBy(key).orderBy(*order)).alias("x")).where("x IS NOT NULL")
    fit = pairs.groupBy(key).agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), (F.regr_syy("y", "x") - F.regr_slope("y", "x") * F.regr_sxy("y", "x")).alias("sse"), F.count(F.lit(1)).alias("n"))
    theta = F.when((F.col("b") > 0) & (F.col("b") < 1), -F.log("b") / dt)
    variance = F.try_divide(F.col("sse"), F.col("n") - 2)
    return fit.select(key, theta.alias("theta"), F.try_divide(F.col("a"), 1 - F.col("b")).alias("mu"), F.sqrt(F.try_divide(variance * 2 * theta, 1 - F.col("b") * F.col("b"))).alias("sigma"))


def sabr_implied_vol(f: Column, k: Column, t: float, alpha: float, beta: float, rho: float, nu: float) -> Column:
    """Hagan's lognormal expansion; the limit formula at the money."""
    fk = F.pow(f * k, F.lit((1 - beta) / 2))
    lm = F.log(f / k)
    z = nu / alpha * fk * lm
    x = F.log((F.sqrt(1 - 2 * rho * z + z * z) + z - rho) / (1 - rho))
    skew = F.when(F.abs(z) < 1e-8, F.lit(1.0)).otherwise(z / x)
    bend = 1 + (1 - beta) ** 2 / 24 * lm * lm + (1 - beta) ** 4 / 1920 * F.pow(lm, F.lit(4))
    time = 1 + ((1 - beta) ** 2 / 24 * alpha**2 / F.pow(f * k, F.lit(1 - beta)) + rho * beta * nu * alpha / (4 * fk) + (2 - 3 * rho**2) / 24 * nu**2) * t
    return alpha / (fk * bend) * skew * time


def information_coefficient(rows: DataFrame, by: str, signal: str, forward: str) -> DataFrame:
    """(by, ic): correlation of average ranks."""
    def rank(c: str) -> Column:
        w = Window.partitionBy(by).orderBy(c)
        return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(by, c)) - 1) / 2

    dealt = rows.select(by, signal, forward).repartition(parts_of(rows), by)
    ranked = dealt.select(by, rank(signal).alias("a"), rank(forward).alias("b"))
    return ranked.groupBy(by).agg(F.corr("a", "b").alias("ic"))


def brier_score(forecast: Column, outcome: Column) -> Column:
    return F.avg((forecast - outcome) * (forecast - outcome))
