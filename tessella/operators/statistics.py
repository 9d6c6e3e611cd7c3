"""Metrics, tests and fitted models over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def regression_metrics(rows: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    return rows.agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop(y) * F.count(y))).alias("r2"))


def classification_metrics(rows: DataFrame, y: str, p: str) -> DataFrame:
    """One row: accuracy and macro F1 over the classes that occur in either column."""
    seen = rows.select(F.col(y).alias("y"), F.col(p).alias("p"))
    parts = seen.select(F.explode(F.array_distinct(F.array("y", "p"))).alias("c"), "y", "p")
    per = parts.groupBy("c").agg(F.sum(((F.col("y") == F.col("c")) & (F.col("p") == F.col("c"))).cast("double")).alias("tp"), F.sum((F.col("y") == F.col("c")).cast("double")).alias("yes"), F.sum((F.col("p") == F.col("c")).cast("double")).alias("said"))
    f1 = per.agg(F.avg(F.coalesce(F.try_divide(2 * F.col("tp"), F.col("yes") + F.col("said")), F.lit(0.0))).alias("macro_f1"))
    return seen.agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy")).crossJoin(f1)  # one row each


def spearman(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, rho): correlation of average ranks."""
    def rank(c: str):
        return F.rank().over(Window.partitionBy(group).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(group, c)) - 1) / 2

    return rows.select(group, rank(x).alias("a"), rank(y).alias("b")).groupBy(group).agg(F.corr("a", "b").alias("rho"))


def ks_two_sample(rows: DataFrame, value: str, second: str) -> DataFrame:
    """One row: the largest gap of two samples' distribution functions; `second` is a boolean column.

    Counts of values are summed within 1,024 ranges and before each range, so no task sorts the whole table.
    """
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.sum((~F.col(second)).cast("long")).alias("a"), F.sum(F.col(second).cast("long")).alias("b"))
    ends = counts.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("a").alias("na"), F.sum("b").alias("nb")).first()
    if not ends["na"] or not ends["nb"]:
        return counts.select(F.lit(None).cast("double").alias("ks")).limit(1)
    width = max((ends["hi"] - ends["lo"]) / 1024, 1e-300)
    part = counts.withColumn("part", F.floor((F.col("v") - ends["lo"]) / width))
    sums = part.groupBy("part").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("part", F.coalesce(F.sum("pa").over(w), F.lit(0)).alias("ba"), F.coalesce(F.sum("pb").over(w), F.lit(0)).alias("bb"))
    inner = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    gap = (F.col("ba") + F.sum("a").over(inner)) / ends["na"] - (F.col("bb") + F.sum("b").over(inner)) / ends["nb"]
    return part.join(before, "part").select(F.abs(gap).alias("g")).agg(F.max("g").alias("ks"))


def softmax(rows: DataFrame, group: str, logit: str, temperature: float = 1.0) -> DataFrame:
    """rows with p, stable by the group's maximum."""
    w = Window.partitionBy(group)
    e = F.exp((F.col(logit) - F.max(logit).over(w)) / temperature)
    return rows.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def stability_index(rows: DataFrame, value: str, second: str, low: float, high: float, bins: int = 10) -> DataFrame:
    """One row: population-stability index of two samples over equal-width bins; empty shares count as 1e-6."""
    b = F.greatest(F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)), F.lit(0))
    n = rows.groupBy(b.alias("bin")).agg(F.sum((~F.col(second)).cast("double")).alias("a"), F.sum(F.col(second).cast("double")).alias("b"))
    t = n.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    both = n.crossJoin(t)  # bins with one row
    p, q = F.greatest(F.try_divide("a", "ta"), F.lit(1e-6)), F.greatest(F.try_divide("b", "tb"), F.lit(1e-6))
    return both.agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def k_means(rows: DataFrame, key: str, vector: str, k: int, iterations: int = 20, seed: int = 7) -> DataFrame:
    """(key, cluster) by the library's distributed k-means, seeded."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = rows.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, maxIter=iterations, seed=seed).fit(v)
    return model.transform(v).select(key, F.col("prediction").cast("long").alias("cluster"))


def frequent_sets(baskets: DataFrame, items: str, support: float) -> DataFrame:
    """(items, n) by FP-growth; items is an array of distinct values."""
    from pyspark.ml.fpm import FPGrowth

    model = FPGrowth(itemsCol=items, minSupport=support, minConfidence=0.0).fit(baskets)
    return model.freqItemsets.select(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",").alias("items"), F.col("freq").alias("n"))


def frequent_sequences(sequences: DataFrame, column: str, support: float, longest: int = 4) -> DataFrame:
    """(sequence, n) by PrefixSpan; column is an array of arrays."""
    from pyspark.ml.fpm import PrefixSpan

    found = PrefixSpan(minSupport=support, maxPatternLength=longest, sequenceCol=column).findFrequentSequentialPatterns(sequences)
    return found.select(F.array_join(F.transform("sequence", lambda s: F.array_join(s, "+")), ">").alias("sequence"), F.col("freq").alias("n"))
