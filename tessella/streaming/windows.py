"""Streams of events: windowed aggregates with watermarks, deduplication, and stateful sequences.

A stream is any streaming DataFrame; file_stream reads a folder as one. drain
runs a stream over what is there and returns the result as a table, which lets
tests hold streams against batch queries.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..catalog import scratch


def file_stream(spark: SparkSession, folder: str, name: str, files_each: int = 16) -> DataFrame:
    """The files `name` of a folder as a stream; the schema is that of a batch read."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_each).parquet(folder)


def windowed(events: DataFrame, ts: str, keys: list[str], size: str, slide: str | None = None, late: str = "1 hour", **aggregates) -> DataFrame:
    """Tumbling or sliding windows: (start, keys.., aggregates..)."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("w.start").alias("start"), *keys, *aggregates)


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of session windows."""
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def sequences(events: DataFrame, key: str, kind: str, seconds: str, first: str, then: str, within: float) -> DataFrame:
    """(key, start, end) for each `first` event followed by a `then` event within the span; open starts are the state of a key."""

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values([seconds])
        out = []
        for name, t in zip(rows[kind], rows[seconds]):
            open_ = [s for s in open_ if t - s <= within]
            if name == then:
                out += [(k[0], s, t) for s in open_]
                open_ = []
            elif name == first:
                open_.append(float(t))
        state.update((json.dumps(open_),))
        yield pd.DataFrame(out, columns=[key, "start", "end"]).astype({"start": "float64", "end": "float64"})

    kinds = dict(events.dtypes)
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, start double, end double", "open string", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Process all that is available and return the result table; a batch run again after a failure isn't written twice."""
    spark = stream.sparkSession
    at = scratch(spark)

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is run again takes the place of its first run
        batch.write.mode("overwrite").parquet(f"{at}/out" if mode == "complete" else f"{at}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{at}/out")
