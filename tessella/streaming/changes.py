"""Change streams as weighted rows: an insertion weighs 1, a deletion -1, an update is both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deltas(events: DataFrame, columns: list[str]) -> DataFrame:
    """(columns.., weight) of change events (op, before, after), structs of the columns."""
    gone = events.where("before IS NOT NULL").select(*[F.col(f"before.{c}").alias(c) for c in columns], F.lit(-1).alias("weight"))
    come = events.where("after IS NOT NULL").select(*[F.col(f"after.{c}").alias(c) for c in columns], F.lit(1).alias("weight"))
    return gone.unionByName(come)


def apply(state: DataFrame, delta: DataFrame) -> DataFrame:
    """The weighted sum of two Z-sets; rows whose weights cancel are gone."""
    keys = [c for c in state.columns if c != "weight"]
    return state.unionByName(delta).groupBy(*keys).agg(F.sum("weight").cast("int").alias("weight")).where("weight <> 0")


def filtered(delta: DataFrame, test: Column) -> DataFrame:
    """Filters are linear, so the view's delta is the filtered delta."""
    return delta.where(test)


def aggregated(state: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts and sums of a Z-set."""
    return state.groupBy(*keys).agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col(value)).alias("total"))


def latest(events: DataFrame, key: str, seq: str) -> DataFrame:
    """The last change of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    return events.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
