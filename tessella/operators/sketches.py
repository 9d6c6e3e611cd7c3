"""Mergeable sketches as aggregations: count-min frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cells(df: DataFrame, item: str, depth: int, width: int) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(d).alias("d"), F.pmod(F.xxhash64(F.lit(d), F.col(item)), F.lit(width)).alias("w")) for d in range(depth)])
    return df.select("*", F.explode(rows).alias("_cell"), F.lit(width).alias("_width"), F.lit(depth).alias("_depth"))


def count_min(df: DataFrame, item: str, depth: int = 5, width: int = 2048) -> DataFrame:
    """(d, w, n): the sketch as a table of at most depth * width cells. Sketches of parts add up by summing n."""
    return _cells(df.select(item), item, depth, width).groupBy(F.col("_cell.d").alias("d"), F.col("_cell.w").alias("w"), "_width", "_depth").agg(F.count(F.lit(1)).alias("n"))


def estimate(sketch: DataFrame, items: DataFrame, item: str, depth: int = 5, width: int = 2048) -> DataFrame:
    """items with column estimate, the least of an item's cells; it is never below the true count."""
    cells = _cells(items, item, depth, width)
    joined = cells.join(sketch.select("d", "w", "n"), (cells["_cell.d"] == sketch["d"]) & (cells["_cell.w"] == sketch["w"]), "left")
    return joined.groupBy(*items.columns).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
