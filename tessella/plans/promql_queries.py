"""PromQL expressions over the events as samples, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..operators.timeseries import micros
from . import promql
from .library import _rounded, query

_AT = "(SELECT max(epoch_us(ts)) // 1000000 FROM events)"
_S = f"s AS (SELECT event_type AS kind, CAST(user_id % 5 AS VARCHAR) AS shard, epoch_us(ts) / 1e6 AS t, max(value) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3), n AS (SELECT {_AT} AS now)"
_WEEK = "t <= now AND t > now - 604800"


def _asked(name: str, text: str, oracle: str) -> None:
    def run(spark, sf_dir):
        e = table(spark, sf_dir, "events").where("value IS NOT NULL")
        samples = e.groupBy(F.lit("reading").alias("name"), F.col("event_type").alias("kind"), (F.col("user_id") % 5).cast("string").alias("shard"), (micros(F.col("ts")) / 1e6).alias("t")).agg(F.max("value").alias("value"))
        at = table(spark, sf_dir, "events").agg(F.max(micros(F.col("ts")))).first()[0] // 1_000_000
        return _rounded(promql.run(text, samples, float(at)))

    run.__name__ = name
    query(oracle)(run)


_asked("promql_selector", 'last_over_time(reading{kind=~"c.*|view", shard!="3"}[1w] offset 1h)', f"WITH {_S} SELECT kind, shard, round(max_by(value, t), 6) AS value FROM s, n WHERE t <= now - 3600 AND t > now - 3600 - 604800 AND regexp_full_match(kind, 'c.*|view') AND shard <> '3' GROUP BY 1, 2")
_asked("promql_sum_by", 'sum by (kind) (avg_over_time(reading{shard="1"}[1w]))', f"WITH {_S} SELECT kind, round(avg(value), 6) AS value FROM s, n WHERE {_WEEK} AND shard = '1' GROUP BY kind")
_asked("promql_clamp", 'clamp_max(clamp_min(max_over_time(reading[1w]), 50), 95)', f"WITH {_S} SELECT kind, shard, round(least(95.0, greatest(50.0, max(value))), 6) AS value FROM s, n WHERE {_WEEK} GROUP BY 1, 2")
_asked(
    "promql_binary",
    "(max_over_time(reading[1w]) - min_over_time(reading[1w])) / count_over_time(reading[1w]) > 0.5",
    f"WITH {_S} SELECT * FROM (SELECT kind, shard, round((max(value) - min(value)) / count(*), 6) AS value FROM s, n WHERE {_WEEK} GROUP BY 1, 2) WHERE value > 0.5",
)
_asked(
    "promql_delta_deriv",
    "delta(reading[1w]) + deriv(reading[1w]) * 0",
    f"WITH {_S} SELECT kind, shard, round(max_by(value, t) - min_by(value, t), 6) AS value FROM s, n WHERE {_WEEK} GROUP BY 1, 2 HAVING count(*) > 1",
)
_asked(
    "promql_idelta",
    "idelta(reading[1w])",
    f"WITH {_S}, r AS (SELECT *, lag(value) OVER (PARTITION BY kind, shard ORDER BY t) AS b FROM s, n WHERE {_WEEK}) SELECT kind, shard, round(max_by(value - b, t), 6) AS value FROM r GROUP BY 1, 2 HAVING count(*) > 1",
)
_asked(
    "promql_labels",
    'label_join(label_replace(sum without (shard) (count_over_time(reading[1w])), "short", "$1", "kind", "(.).*"), "both", "-", "kind", "short")',
    f"WITH {_S} SELECT kind, kind[1] AS short, kind || '-' || kind[1] AS both, CAST(count(*) AS DOUBLE) AS value FROM s, n WHERE {_WEEK} GROUP BY 1",
)
_asked(
    "promql_topk_quantile",
    "topk(2, quantile by (kind) (0.5, sum_over_time(reading[1w])))",
    f"WITH {_S}, q AS (SELECT kind, quantile_cont(v, 0.5) AS value FROM (SELECT kind, shard, sum(value) AS v FROM s, n WHERE {_WEEK} GROUP BY 1, 2) GROUP BY 1) SELECT kind, round(value, 6) AS value FROM q ORDER BY q.value DESC, kind LIMIT 2",
)
