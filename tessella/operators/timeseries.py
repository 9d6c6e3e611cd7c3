"""Time-series operators: buckets, as-of joins, gap filling, bars, decay, change points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def bucket_start(ts: Column, seconds: int) -> Column:
    """Start of the bucket, floor(ts / w) * w, in seconds."""
    return F.floor(micros(ts) / (seconds * 1_000_000)).cast("long") * seconds


def bucketed(points: DataFrame, series: str, ts: str, value: str, seconds: int) -> DataFrame:
    """Per series and bucket: count, mean, sum, min, max, first and last. points needs a tie-breaking column id."""
    at = F.struct(F.col(ts), F.col("id"))
    return points.groupBy(F.col(series).alias("series"), bucket_start(F.col(ts), seconds).alias("bucket")).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("sum"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.min_by(value, at).alias("open"), F.max_by(value, at).alias("close"),
    )


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, tolerance: int | None = None) -> DataFrame:
    """left with the value of right's latest row of the same key at or before ts; null beyond tolerance (microseconds).

    One union and one window over the key, no range join: left rows see the
    last right row before them. left needs a unique column id.
    """
    tagged = left.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(1).alias("_left"), "id", F.lit(None).cast("double").alias("_v"))
    known = right.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(0).alias("_left"), F.lit(None).cast("long").alias("id"), F.col(value).cast("double").alias("_v"))
    w = Window.partitionBy("_k").orderBy("_t", "_left").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_left") == 0, F.struct("_t", "_v")), ignorenulls=True).over(w)
    out = tagged.unionByName(known).withColumn("_f", found).where("_left = 1")
    fits = F.lit(True) if tolerance is None else micros(F.col("_t")) - micros(F.col("_f._t")) <= tolerance
    return out.select("id", F.col("_k").alias(key), F.col("_t").alias(ts), F.when(fits, F.col("_f._v")).alias(value))


def gap_filled(buckets: DataFrame, seconds: int) -> DataFrame:
    """(series, bucket, value) on a full grid from each series' first to last bucket, carried forward, with `filled`."""
    spans = buckets.groupBy("series").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    grid = spans.select("series", F.explode(F.sequence("a", "b", F.lit(seconds).cast("long"))).alias("bucket"))
    full = grid.join(buckets, ["series", "bucket"], "left")
    w = Window.partitionBy("series").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return full.select("series", "bucket", F.last("value", ignorenulls=True).over(w).alias("value"), F.col("value").isNull().alias("filled"))


def decay_mean(points: DataFrame, series: str, ts: str, value: str, now: str, half_life_s: float) -> DataFrame:
    """Mean with weights 0.5 ** (age / half-life); points after now don't count."""
    age = (micros(F.lit(now).cast("timestamp_ntz")) - micros(F.col(ts))) / 1e6
    weight = F.pow(F.lit(0.5), age / half_life_s)
    return points.where(age >= 0).groupBy(F.col(series).alias("series")).agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias("mean"))


def cusum(points: DataFrame, series: str, value: str, order: list[str], target: float, drift: float, threshold: float) -> DataFrame:
    """Two-sided CUSUM alarms, restarted after each: (series, position from 0). One group per series in pandas, as state restarts."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        up = down = 0.0
        out = []
        for i, x in enumerate(pdf.sort_values(order)[value].tolist()):
            up, down = max(0.0, up + x - target - drift), max(0.0, down - x + target - drift)
            if up > threshold or down > threshold:
                out.append(i)
                up = down = 0.0
        return pd.DataFrame({"series": str(pdf[series].iloc[0]), "position": pd.Series(out, dtype="int64")})

    return points.groupBy(series).applyInPandas(run, "series string, position long")


def resample(points: DataFrame, grid: DataFrame, mode: str = "linear") -> DataFrame:
    """(series, t, value) points on (series, t) grid instants, t in seconds: nearest (ties to the earlier), linear or hold; no extrapolation."""
    w = Window.partitionBy("series").orderBy("t", "_g")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    p = points.select("series", "t", "value", F.lit(0).alias("_g"))
    g = grid.select("series", "t", F.lit(None).cast("double").alias("value"), F.lit(1).alias("_g"))
    point = F.when(F.col("_g") == 0, F.struct("t", "value"))
    both = p.unionByName(g).withColumn("a", F.last(point, True).over(back)).withColumn("b", F.first(point, True).over(ahead)).where("_g = 1")
    a, b, t = F.col("a"), F.col("b"), F.col("t")
    exact = a["t"] == t
    if mode == "hold":
        value = a["value"]
    elif mode == "nearest":
        value = F.when(a.isNull(), b["value"]).when(b.isNull() | (t - a["t"] <= b["t"] - t), a["value"]).otherwise(b["value"])
    else:
        value = F.when(exact, a["value"]).otherwise(a["value"] + (b["value"] - a["value"]) * F.try_divide(t - a["t"], b["t"] - a["t"]))
    return both.select("series", "t", value.alias("value"))
