"""Distributions, beliefs, calibration, conformal sets and off-policy estimates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def beta_bernoulli(a: Column, b: Column, successes: Column, failures: Column) -> tuple[Column, Column]:
    return a + successes, b + failures


def gaussian_update(mean: Column, var: Column, n: Column, total: Column, noise: float) -> tuple[Column, Column]:
    """Posterior mean and variance after n values that sum to total, of known variance `noise`."""
    precision = 1 / var + n / F.lit(float(noise))
    return (mean / var + total / F.lit(float(noise))) / precision, 1 / precision


def fuse_gaussians(rows: DataFrame, group: str, mean: str, var: str) -> DataFrame:
    """(group, mean, var) of the precision-weighted product."""
    p = F.sum(1 / F.col(var))
    return rows.groupBy(group).agg((F.sum(F.col(mean) / F.col(var)) / p).alias("mean"), (1 / p).alias("var"))


def mixture_moments(rows: DataFrame, group: str, weight: str, mean: str, var: str) -> DataFrame:
    """(group, mean, var) of the Gaussian with a mixture's first two moments."""
    w, total = F.col(weight), F.sum(weight)
    m = F.sum(w * F.col(mean)) / total
    return rows.groupBy(group).agg(m.alias("mean"), (F.sum(w * (F.col(var) + F.col(mean) * F.col(mean))) / total - m * m).alias("var"))


def live_at(start: Column, end: Column, t) -> Column:
    """Half-open liveness: a missing start is 0, a missing end never comes."""
    return (F.coalesce(start, F.lit(0)) <= t) & (end.isNull() | (F.lit(t) < end))


def ebbinghaus(age: Column, half_life: float) -> Column:
    return F.when((age <= 0) | F.lit(half_life <= 0), F.lit(1.0)).otherwise(F.exp(-math.log(2) * age / half_life))


def belief_edges(edges: DataFrame, node: str, kind: str) -> DataFrame:
    """Neighbours of node by kind: evidence (incoming SUPPORTS), contradicts (either of two relations, incoming), supported (outgoing)."""
    if kind == "evidence":
        return edges.where((F.col("rel") == "SUPPORTS") & (F.col("dst") == node)).select(F.col("src").alias("id"))
    if kind == "contradicts":
        return edges.where(F.col("rel").isin("CONTRADICTS", "ATTACKS") & (F.col("dst") == node)).select(F.col("src").alias("id"))
    return edges.where((F.col("rel") == "SUPPORTS") & (F.col("src") == node)).select(F.col("dst").alias("id"))


def reliability(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) of equal-width bins; their weighted gaps sum to the calibration error."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long")
    return rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"), F.avg(y).alias("accuracy"))


def calibration_error(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    r = reliability(rows, p, y, bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def split_conformal(scores: DataFrame, group: str, score: str, alpha: float) -> DataFrame:
    """(group, threshold): the ceil((n + 1)(1 - alpha))-th smallest score, infinite if there is none."""
    w = Window.partitionBy(group)
    r = scores.withColumn("_r", F.row_number().over(w.orderBy(score))).withColumn("_n", F.count(F.lit(1)).over(w))
    at = F.ceil((F.col("_n") + 1) * (1 - alpha) - 1e-9)
    return r.groupBy(group).agg(F.coalesce(F.max(F.when(F.col("_r") == at, F.col(score))), F.lit(float("inf"))).alias("threshold"))


def off_policy(rows: DataFrame, reward: str, target: str, logged: str, clip: float | None = None) -> DataFrame:
    """One row: ips, snips; target and logged are the policies' propensities of the logged action."""
    w = F.col(target) / F.col(logged)
    w = F.least(w, F.lit(clip)) if clip else w
    return rows.agg(F.avg(w * F.col(reward)).alias("ips"), F.try_divide(F.sum(w * F.col(reward)), F.sum(w)).alias("snips"))


def doubly_robust(rows: DataFrame, reward: str, target: str, logged: str, model_logged: str, model_target: str) -> DataFrame:
    w = F.col(target) / F.col(logged)
    return rows.agg(F.avg(F.col(model_target) + w * (F.col(reward) - F.col(model_logged))).alias("dr"))
