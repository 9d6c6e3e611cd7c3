"""Kernels whose state runs along a series: filters row by row, the others in one pandas group per series, never the whole table."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _each(points: DataFrame, series: str, order: list[str], columns: list[str], out: str, fn) -> DataFrame:
    """fn(columns of one series, ordered) -> dict of result columns; series is passed through."""
    kind = dict(points.dtypes)[series]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame({series: pdf[series].iloc[0], **fn(*[pdf[c].to_numpy() for c in columns])})

    keep = dict.fromkeys([series, *order, *columns])
    return points.select(*keep).groupBy(series).applyInPandas(run, f"{series} {kind}, {out}")


def _streamed(points: DataFrame, series: str, order: list[str], id_: str, columns: list[str], out: str, begin) -> DataFrame:
    """(series, id, out): begin() gives a series' state, a function of one row's values; rows come sorted and in batches, so memory doesn't grow with a series."""
    kind = dict(points.dtypes)[series]
    rows = points.select(F.col(series).alias("_series"), F.col(id_).cast("long").alias("_id"), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    dealt = rows.repartition("_series").sortWithinPartitions("_series", *[F.asc_nulls_last(f"_o{i}") for i in range(len(order))])
    dealt = dealt.select("_series", "_id", *[f"_v{i}" for i in range(len(columns))])

    def run(batches):
        now, step = None, None
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = []
            for name, *values in zip(names, *[batch.column(2 + i).to_numpy(zero_copy_only=False).tolist() for i in range(len(columns))]):
                if step is None or name != now:
                    now, step = name, begin()
                found.append(step(*values))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64(), from_pandas=True)], names=[series, "id", out])

    return dealt.mapInArrow(run, f"{series} {kind}, id long, {out} double")


def kalman_level(points: DataFrame, series: str, order: list[str], id_: str, value: str, q: float, r: float) -> DataFrame:
    """(series, id, level) of a local-level filter; the first value is the first level."""

    def begin():
        level, p = None, r

        def step(x):
            nonlocal level, p
            if level is None:
                level = x
            else:
                p += q
                gain = p / (p + r)
                level, p = level + gain * (x - level), (1 - gain) * p
            return level

        return step

    return _streamed(points, series, order, id_, [value], "level", begin)


def kalman_beta(points: DataFrame, series: str, order: list[str], id_: str, x: str, y: str, q: float, r: float) -> DataFrame:
    """(series, id, beta): random-walk coefficient of y on x, from 0 with variance 1."""

    def begin():
        beta, p = 0.0, 1.0

        def step(a, b):
            nonlocal beta, p
            p += q
            gain = p * a / (a * a * p + r)
            beta, p = beta + gain * (b - beta * a), (1 - gain * a) * p
            return beta

        return step

    return _streamed(points, series, order, id_, [x, y], "beta", begin)


def sliding_distances(query: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """z-normalised Euclidean distance of query to each window of xs; a flat window is at 0 from a flat query, else at sqrt(m)."""
    m = len(query)
    windows = np.lib.stride_tricks.sliding_window_view(xs, m)
    sd = windows.std(1)
    flat, qflat = sd < 1e-12, query.std() < 1e-12
    if qflat:
        return np.where(flat, 0.0, np.sqrt(m))
    z = (query - query.mean()) / query.std()
    corr = (windows @ z) / (m * np.where(flat, 1, sd))
    return np.where(flat, np.sqrt(m), np.sqrt(np.maximum(2 * m * (1 - corr), 0)))


def matrix_profile(points: DataFrame, series: str, order: list[str], value: str, m: int) -> DataFrame:
    """(series, position, nearest, distance): each window's nearest other window at least m / 2 away."""

    def fn(xs):
        n = len(xs) - m + 1
        if n < 2:
            return {"position": np.zeros(0, int), "nearest": np.zeros(0, int), "distance": np.zeros(0)}
        near, dist = np.full(n, -1), np.full(n, np.inf)
        zone = max(1, m // 2)
        for i in range(n):
            d = sliding_distances(xs[i : i + m], xs)
            d[max(0, i - zone + 1) : i + zone] = np.inf
            near[i] = d.argmin()
            dist[i] = d[near[i]]
        return {"position": np.arange(n), "nearest": near, "distance": dist}

    return _each(points, series, order, [value], "position long, nearest long, distance double", fn)


def motif_like(points: DataFrame, series: str, order: list[str], value: str, query: list[float], k: int) -> DataFrame:
    """(series, position, distance) of the k windows most like query, none overlapping a better one by over half."""
    q = np.array(query, float)

    def fn(xs):
        if len(xs) < len(q):
            return {"position": np.zeros(0, int), "distance": np.zeros(0)}
        d = sliding_distances(q, xs)
        out, found = [], d.copy()
        while len(out) < k and np.isfinite(found).any():
            i = int(found.argmin())
            out.append(i)
            found[max(0, i - len(q) // 2) : i + len(q) // 2 + 1] = np.inf
        return {"position": out, "distance": d[out]}

    return _each(points, series, order, [value], "position long, distance double", fn)


def holt_winters(points: DataFrame, series: str, order: list[str], value: str, period: int, alpha: float, beta: float, gamma: float, horizon: int) -> DataFrame:
    """(series, step, forecast), additive; a series shorter than two periods gives none."""

    def fn(xs):
        if len(xs) < 2 * period:
            return {"step": np.zeros(0, int), "forecast": np.zeros(0)}
        level, trend = xs[:period].mean(), (xs[period : 2 * period].mean() - xs[:period].mean()) / period
        season = list(xs[:period] - level)
        for i, x in enumerate(xs):
            s, before = season[i % period], level
            level = alpha * (x - s) + (1 - alpha) * (level + trend)
            trend = beta * (level - before) + (1 - beta) * trend
            season[i % period] = gamma * (x - level) + (1 - gamma) * s
        n = len(xs)
        return {"step": np.arange(1, horizon + 1), "forecast": [level + h * trend + season[(n + h - 1) % period] for h in range(1, horizon + 1)]}

    return _each(points, series, order, [value], "step long, forecast double", fn)


def pelt(points: DataFrame, series: str, order: list[str], value: str, penalty: float) -> DataFrame:
    """(series, position): starts of new segments of an exact optimal partition by squared error, with pruning."""

    def fn(xs):
        n = len(xs)
        s, s2 = np.r_[0.0, np.cumsum(xs)], np.r_[0.0, np.cumsum(xs * xs)]
        best, back, alive = np.r_[-penalty, np.full(n, np.inf)], np.zeros(n + 1, int), np.array([0])
        for t in range(1, n + 1):
            cost = s2[t] - s2[alive] - (s[t] - s[alive]) ** 2 / (t - alive)
            total = best[alive] + cost + penalty
            j = int(total.argmin())
            best[t], back[t] = total[j], alive[j]
            alive = np.r_[alive[total - penalty <= best[t]], t]
        cuts, t = [], n
        while t > 0:
            t = back[t]
            if t > 0:
                cuts.append(t)
        return {"position": np.array(cuts[::-1], int)}

    return _each(points, series, order, [value], "position long", fn)


def m4(points: DataFrame, series: str, x: str, y: str, low: float, high: float, width: int) -> DataFrame:
    """First, last, lowest and highest point of each of `width` pixel columns, distinct: (series, x, y). Columns, not a loop."""
    from pyspark.sql import functions as F

    pixel = F.least(F.floor((F.col(x) - low) / (high - low) * width), F.lit(width - 1))
    p = points.select(series, F.col(x).alias("x"), F.col(y).alias("y")).where(F.col("x").between(low, high))
    spots = p.groupBy(series, pixel.alias("pixel")).agg(
        *[f.alias(n) for n, f in (("a", F.min(F.struct("x", "y"))), ("b", F.max(F.struct("x", "y"))), ("c", F.min(F.struct("y", "x"))), ("d", F.max(F.struct("y", "x"))))]
    )
    each = F.array("a", "b", F.struct(F.col("c.x").alias("x"), F.col("c.y").alias("y")), F.struct(F.col("d.x").alias("x"), F.col("d.y").alias("y")))
    return spots.select(series, F.explode(F.array_distinct(each)).alias("p")).select(series, "p.x", "p.y")
