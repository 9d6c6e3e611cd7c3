"""Portfolios, simulated risk, backtest statistics, accounting ratios, screening.

Moments of returns are aggregations; what remains is algebra on a matrix of
assets by assets, whose size is the number of assets, not of rows. More than
MOST_ASSETS is an error.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ASSETS = 2000


def moments(returns: DataFrame, asset: str, time: str, value: str) -> tuple[list, np.ndarray, np.ndarray]:
    """Assets in order, their mean returns and sample covariance over the times that all have."""
    names = sorted(r[0] for r in returns.select(asset).distinct().limit(MOST_ASSETS + 1).collect())
    if len(names) > MOST_ASSETS:
        raise ValueError(f"more than {MOST_ASSETS} assets")
    per = returns.groupBy(time).agg(F.map_from_entries(F.collect_list(F.struct(asset, value))).alias("m")).where(F.size("m") == len(names))
    rows = per.select(F.array(*[F.col("m")[n] for n in names]).alias("x"))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("x")[i].alias("a"), F.col("x")[j].alias("b")) for i, j in pairs])) if len(names) <= 40 else None
    if cells is not None:
        found = rows.select(cells.alias("c")).groupBy("c.i", "c.j").agg(F.covar_samp("c.a", "c.b").alias("v"), F.avg("c.a").alias("m")).collect()
    else:
        flat = rows.select(F.monotonically_increasing_id().alias("t"), F.posexplode("x").alias("i", "a"))
        found = flat.alias("p").join(flat.alias("q"), (F.col("p.t") == F.col("q.t")) & (F.col("p.i") <= F.col("q.i"))).groupBy(F.col("p.i").alias("i"), F.col("q.i").alias("j")).agg(F.covar_samp("p.a", "q.a").alias("v"), F.avg("p.a").alias("m")).collect()
    mean, cov = np.zeros(len(names)), np.zeros((len(names), len(names)))
    for r in found:
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["v"] or 0.0
        if r["i"] == r["j"]:
            mean[r["i"]] = r["m"]
    return names, mean, cov


def minimum_variance(cov: np.ndarray) -> np.ndarray:
    """Weights that sum to 1 and vary least; short positions allowed."""
    w = np.linalg.solve(cov, np.ones(len(cov)))
    return w / w.sum()


def maximum_sharpe(mean: np.ndarray, cov: np.ndarray, free: float = 0.0) -> np.ndarray:
    """The tangency portfolio; short positions allowed."""
    w = np.linalg.solve(cov, mean - free)
    return w / w.sum()


def risk_parity(cov: np.ndarray, tol: float = 1e-12, most: int = 10_000) -> np.ndarray:
    """Positive weights whose risk contributions are equal: coordinate descent on w'Cw / 2 - sum(log w) / n, scaled to 1."""
    n = len(cov)
    w = 1 / np.sqrt(np.diag(cov))
    for _ in range(most):
        before = w.copy()
        for i in range(n):
            rest = cov[i] @ w - cov[i, i] * w[i]
            w[i] = (-rest + math.sqrt(rest * rest + 4 * cov[i, i] / n)) / (2 * cov[i, i])
        if np.abs(w - before).max() <= tol * np.abs(w).max():
            return w / w.sum()
    raise ArithmeticError("risk parity didn't settle")


def black_litterman(cov: np.ndarray, market: np.ndarray, picks: np.ndarray, views: np.ndarray, doubt: np.ndarray, tau: float = 0.05, aversion: float = 2.5) -> np.ndarray:
    """Posterior mean returns: equilibrium returns of the market weights blended with views (picks @ r = views, variances doubt)."""
    prior = aversion * cov @ market
    blend = tau * cov @ picks.T @ np.linalg.inv(picks @ (tau * cov) @ picks.T + np.diag(doubt))
    return prior + blend @ (views - picks @ prior)


def efficient_frontier(mean: np.ndarray, cov: np.ndarray, points: int = 10) -> list[tuple[float, float]]:
    """(return, deviation) of least-variance portfolios between the least-variance one and the best single mean."""
    inverse, one = np.linalg.inv(cov), np.ones(len(cov))
    a, b, c = one @ inverse @ one, one @ inverse @ mean, mean @ inverse @ mean
    targets = np.linspace(b / a, max(float(mean.max()), b / a), points)
    return [(float(t), math.sqrt(max(0.0, (a * t * t - 2 * b * t + c) / (a * c - b * b)))) for t in targets]


def monte_carlo_var(returns: DataFrame, asset: str, time: str, value: str, weights: dict, confidence: float = 0.95, paths: int = 100_000, seed: int = 7) -> tuple[float, float]:
    """(var, cvar) of a weighted portfolio under normal returns, from `paths` draws made in Spark; losses positive."""
    names, mean, cov = moments(returns, asset, time, value)
    w = np.array([weights.get(n, 0.0) for n in names])
    m, sd = float(w @ mean), math.sqrt(float(w @ cov @ w))
    draws = returns.sparkSession.range(0, paths, 1, 16).select((m + sd * F.randn(seed)).alias("r"))
    cut = draws.agg(F.percentile("r", 1 - confidence)).first()[0]
    return -cut, -draws.where(F.col("r") <= cut).agg(F.avg("r")).first()[0]


def sharpe_statistics(returns: DataFrame, group: str, value: str, trials: int, spread: float) -> DataFrame:
    """(group, sharpe, probabilistic, deflated): chance that the true Sharpe ratio is above 0, and above the best that `trials` worthless ones with that spread would show."""
    z, gamma = NormalDist(), 0.5772156649015329
    best = spread * ((1 - gamma) * z.inv_cdf(1 - 1 / trials) + gamma * z.inv_cdf(1 - 1 / (trials * math.e))) if trials > 1 else 0.0
    m = returns.groupBy(group).agg(F.count(value).alias("n"), (F.avg(value) / F.stddev_samp(value)).alias("sharpe"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt"))
    s = F.col("sharpe")
    size = F.sqrt((F.col("n") - 1) / (1 - F.col("skew") * s + (F.col("kurt") - 1) / 4 * s * s))
    return m.select(group, "sharpe", normal_probability(s * size).alias("probabilistic"), normal_probability((s - best) * size).alias("deflated"))


def normal_probability(x: Column) -> Column:
    """The standard normal distribution function: its series, arguments held within -6 and 6, where it is 1e-9 from 0 and 1."""
    t = F.least(F.greatest(x, F.lit(-6.0)), F.lit(6.0))
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(120)), F.struct(t.alias("term"), t.alias("sum")), lambda s, k: F.struct((s["term"] * t * t / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * t * t / (2 * k + 1)).alias("sum")), lambda s: s["sum"])
    return 0.5 + terms * F.exp(-t * t / 2) / math.sqrt(2 * math.pi)


def purged_folds(rows: DataFrame, order: str, folds: int, embargo: int) -> DataFrame:
    """rows with fold, and train_folds, those whose training may use the row: not its own, and not one that it follows or precedes by up to embargo places."""
    n = rows.count()
    numbered = rows.sparkSession.createDataFrame(rows.orderBy(order).rdd.zipWithIndex().map(lambda r: (*r[0], r[1])), rows.schema.add("_at", "long"))
    size = -(-n // folds) or 1
    fold = F.floor(F.col("_at") / size).cast("int")
    far = lambda k: (F.col("_at") < k * size - embargo) | (F.col("_at") >= (k + 1) * size + embargo)
    return numbered.withColumn("fold", fold).withColumn("train_folds", F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: (k != F.col("fold")) & far(k))).drop("_at")


def forensic_ratios(f: dict[str, Column], p: dict[str, Column]) -> dict[str, Column]:
    """Accounting scores of this year's figures f against last year's p.

    Names: sales, receivables, gross, assets, current, ppe, depreciation, sga,
    debt, liabilities, income, cash, cfo, retained, ebit, equity, shares.
    """
    d = F.try_divide
    accruals = d(f["income"] - f["cfo"], f["assets"])
    beneish = (
        -4.84 + 0.92 * d(d(f["receivables"], f["sales"]), d(p["receivables"], p["sales"])) + 0.528 * d(d(p["gross"], p["sales"]), d(f["gross"], f["sales"]))
        + 0.404 * d(1 - d(f["current"] + f["ppe"], f["assets"]), 1 - d(p["current"] + p["ppe"], p["assets"])) + 0.892 * d(f["sales"], p["sales"])
        + 0.115 * d(d(p["depreciation"], p["depreciation"] + p["ppe"]), d(f["depreciation"], f["depreciation"] + f["ppe"])) - 0.172 * d(d(f["sga"], f["sales"]), d(p["sga"], p["sales"]))
        + 4.679 * accruals - 0.327 * d(d(f["debt"] + f["liabilities"], f["assets"]), d(p["debt"] + p["liabilities"], p["assets"]))
    )
    altman = 1.2 * d(f["current"] - f["liabilities"], f["assets"]) + 1.4 * d(f["retained"], f["assets"]) + 3.3 * d(f["ebit"], f["assets"]) + 0.6 * d(f["equity"], f["debt"] + f["liabilities"]) + d(f["sales"], f["assets"])
    yes = lambda t: t.cast("int")
    piotroski = sum(
        map(yes, (
            f["income"] > 0, f["cfo"] > 0, d(f["income"], f["assets"]) > d(p["income"], p["assets"]), f["cfo"] > f["income"], d(f["debt"], f["assets"]) < d(p["debt"], p["assets"]),
            d(f["current"], f["liabilities"]) > d(p["current"], p["liabilities"]), f["shares"] <= p["shares"], d(f["gross"], f["sales"]) > d(p["gross"], p["sales"]), d(f["sales"], f["assets"]) > d(p["sales"], p["assets"]),
        )),
        F.lit(0),
    )
    return {"beneish": beneish, "altman": altman, "piotroski": piotroski, "sloan": accruals}


def screen_payments(payments: DataFrame, key: str, amount: str, day: str, limit: float, days: int = 3, times: int = 3) -> DataFrame:
    """(key, day, n, total): days on which payments just under the limit (80 % at least) reach `times` and together pass it, within the `days` before."""
    small = payments.where((F.col(amount) < limit) & (F.col(amount) >= 0.8 * limit)).groupBy(key, F.col(day).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total"))
    spread = small.select(key, F.explode(F.sequence(F.col("day"), F.col("day") + days - 1)).alias("day"), F.col("day").alias("paid"), "n", "total")
    found = spread.groupBy(key, "day").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("paid").alias("last"))
    return found.where((F.col("n") >= times) & (F.col("total") > limit) & (F.col("last") == F.col("day"))).drop("last")


def expected_loss(p_default: Column, loss_share: Column, exposure: Column) -> Column:
    return p_default * loss_share * exposure
