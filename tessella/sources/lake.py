"""Sources and sinks: versioned Parquet tables with a log, and readers of common line formats."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Table:
    """A table whose versions are sets of Parquet folders, recorded as JSON lines of add and remove actions.

    A version is one log file, written by Spark's text writer to a folder of its
    own; a reader replays the log up to the version it wants.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> list[dict]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        rows = self.spark.read.text(f"{self.path}/_log/*").collect()  # one line for each commit's action
        return sorted((json.loads(r["value"]) for r in rows), key=lambda a: (a["version"], a["op"] == "add"))

    def version(self) -> int:
        return max((a["version"] for a in self._log()), default=-1)

    def write(self, rows: DataFrame, mode: str = "append") -> int:
        """Append or overwrite; the new version's number."""
        log = self._log()
        number = max((a["version"] for a in log), default=-1) + 1
        part = f"data-{number:08d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/{part}")
        actions = [{"version": number, "op": "add", "path": part, "schema": rows.schema.json()}]
        if mode == "overwrite":
            actions += [{"version": number, "op": "remove", "path": p} for p in self._live(log, number - 1)]
        text = self.spark.createDataFrame([(json.dumps(a),) for a in actions], "value string")
        text.coalesce(1).write.text(f"{self.path}/_log/{number:08d}")
        return number

    @staticmethod
    def _live(log: list[dict], version: int) -> list[str]:
        live: dict[str, None] = {}
        for a in log:
            if a["version"] <= version:
                if a["op"] == "add":
                    live[a["path"]] = None
                else:
                    live.pop(a["path"], None)
        return list(live)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the last by default; later columns are null in earlier parts."""
        log = self._log()
        at = max((a["version"] for a in log), default=-1) if version is None else version
        live = self._live(log, at)
        if not live:
            raise ValueError(f"{self.path} has no version {at}")
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{p}" for p in live])

    def zone_map(self, columns: list[str]) -> DataFrame:
        """(file, rows, min, max and null count of each column)."""
        aggs = [f(F.col(c)).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
        nulls = [F.sum(F.col(c).isNull().cast("long")).alias(f"nulls_{c}") for c in columns]
        return self.read().groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"), *aggs, *nulls)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; malformed lines are kept in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def delimited(spark: SparkSession, path: str, schema: str, delimiter: str = ",", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("sep", delimiter).option("header", header).csv(path)


def syslog(lines: DataFrame) -> DataFrame:
    """(facility, severity, host, tag, message) of RFC 3164 lines in column value."""
    p = r"^<(\d{1,3})>\S+\s+\d+\s+[\d:]+\s+(\S+)\s+([^:\[\s]+)[^:]*:\s*(.*)$"
    part = lambda i: F.regexp_extract("value", p, i)
    pri = part(1).try_cast("int")
    return lines.select(F.shiftright(pri, 3).alias("facility"), pri.bitwiseAND(F.lit(7)).alias("severity"), part(2).alias("host"), part(3).alias("tag"), part(4).alias("message"))


def n_triples(lines: DataFrame) -> DataFrame:
    """(s, p, o) of N-Triples lines in column value; comments and blank lines are left out."""
    p = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'
    return lines.where(F.col("value").rlike(p)).select(*[F.regexp_extract("value", p, i).alias(c) for i, c in ((1, "s"), (2, "p"), (3, "o"))])


def rollup_export(rows: DataFrame, path: str, by: list[str]) -> None:
    """Partitioned Parquet, clustered so that each value's rows are in few files."""
    rows.repartition(*by).write.partitionBy(*by).parquet(path)
