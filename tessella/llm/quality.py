"""Quality rules: robust multivariate outliers by minimum covariance determinants.

Each text gives a vector of transformed statistics. For every language and
source a mean and covariance are estimated from the three quarters of its rows
that lie closest together. Concentration steps keep the rows of least Mahalanobis
distance and re-estimate, from two starts (medians with median deviations; plain
mean and covariance), until no group's rows change or `most` steps are done; each
group takes the start whose covariance has the smaller determinant. Every step is
an aggregation over all rows; sums are of scaled integers, so they are exact and
reruns agree. Rows whose distance exceeds a chi-square quantile are rejected.

Nulls: a null text has no words and fails the base rule; null languages and
sources are groups of their own. Small groups are drawn towards the estimate of
the whole table. Repeated rows are judged alike; an empty table gives none.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, discard, group_key, map_columns, materialise

SCALE = 1000
#: Least standard deviation that each statistic is granted, in its own unit.
FLOORS = {"length": 0.5, "word_length": 0.08, "symbols": 0.08, "repeats": 0.08, "dup_lines": 0.1, "capitals": 0.1, "marks": 0.1}
NAMES = list(FLOORS)
SYMBOLS = "#*$%&|<>"
MARKS = "!?;:"

_INTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_statistics(text: str | None) -> tuple[list[int], list[int]]:
    """The five base counts and the scaled statistic vector of one text."""
    if not text:
        return [0] * 5, [0] * len(NAMES)
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    dup_lines = lines = 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line.strip(SPACES):
                lines += 1
                if line in seen:
                    dup_lines += 1
                else:
                    seen.add(line)
    repeats = repeated_words(words)
    if not n:
        return [0, chars, symbols, dup_lines, 0], [0] * len(NAMES)
    marks = sum(text.count(c) for c in MARKS)
    capitals = len(re.sub("[^A-Z]+", "", text))
    vector = [
        math.log1p(n), math.log(max(chars, 1) / n), math.sqrt(symbols / n), math.asin(math.sqrt(repeats / n)),
        math.sqrt(dup_lines / max(lines, 1)), math.sqrt(capitals / max(chars, 1)), math.sqrt(marks / n),
    ]
    return [n, chars, symbols, dup_lines, repeats], [round(SCALE * x) for x in vector]


def repeated_words(words: list, width: int = 5) -> int:
    """Words inside windows of `width` words that occur at least twice, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == n:
        return 0
    first: dict = {}
    marked = bytearray(n)
    for i, window in enumerate(windows):
        j = first.setdefault(window, i)
        if j != i:
            marked[i] = marked[j] = 1
    starts = np.flatnonzero(np.frombuffer(marked, np.uint8))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int((np.cumsum(cover) > 0).sum())


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, the group key, base counts and scaled statistics x0.. of every row."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), group_key(F.col("lang"), F.col("source")).alias("g"))

    def measure(rows: dict) -> dict:
        found = [text_statistics(t) for t in rows["text"]]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        out = {"doc_id": rows["doc_id"], "text_hash": rows["text_hash"], "g": rows["g"]}
        out |= {k: [f[0][i] for f in found] for i, k in enumerate(names)}
        return out | {f"x{i}": [f[1][i] for f in found] for i in range(len(NAMES))}

    kind = dict(docs.dtypes)["doc_id"]
    xs = ", ".join(f"x{i} long" for i in range(len(NAMES)))
    return map_columns(keyed, measure, f"doc_id {kind}, text_hash long, g string, {_INTS}, {xs}")


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi2_quantile(p: float, q: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_p(p / 2, mid / 2) < q else (low, mid)
    return (low + high) / 2


def robust_distances(stats: DataFrame, dims: int, floors: list[float], share: float = 0.75, most: int = 8, weight: int = 50) -> DataFrame:
    """stats with column d2, the squared Mahalanobis distance to the robust estimate of its group g.

    weight: rows that the estimate of the whole table counts as in each group's.
    Groups with fewer rows than a covariance needs thus still have one. The
    parameter table has a row for each group; Spark broadcasts it only while its
    written size is below spark.sql.autoBroadcastJoinThreshold.
    """
    xs = [f"x{i}" for i in range(dims)]
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    fixed = [(SCALE * f) ** 2 for f in floors]

    medians = stats.agg(*[F.percentile(x, 0.5).alias(x) for x in xs], F.count(F.lit(1)).alias("n")).first()
    if not medians["n"]:
        return stats.withColumn("d2", F.lit(None).cast("double"))
    spread = stats.agg(*[F.percentile(F.abs(F.col(x) - medians[x]), 0.5).alias(x) for x in xs]).first()
    centre = [float(medians[x]) for x in xs]
    scale = [max((1.4826 * float(spread[x])) ** 2, f) for x, f in zip(xs, fixed)]
    h = chi2_quantile(dims, share)
    consistency = share / gamma_p((dims + 2) / 2, h / 2)

    # The first estimates: each group's own medians and median deviations, no correlation.
    own = stats.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.percentile(x, 0.5).alias(f"m{i}") for i, x in enumerate(xs)])
    own = materialise(own)
    off = stats.join(own, "g").groupBy("g").agg(*[F.percentile(F.abs(F.col(x) - F.col(f"m{i}")), 0.5).alias(f"s{i}") for i, x in enumerate(xs)])

    def start(rows: dict) -> dict:
        out = {"g": rows["g"], "m": [], "p": []}
        for k in range(len(rows["g"])):
            n = rows["n"][k]
            out["m"].append([(n * rows[f"m{i}"][k] + weight * centre[i]) / (n + weight) for i in range(dims)])
            var = [max((n * (1.4826 * rows[f"s{i}"][k]) ** 2 + weight * scale[i]) / (n + weight), fixed[i]) for i in range(dims)]
            out["p"].append([1 / var[i] if i == j else 0.0 for i, j in pairs])
        return out | {"det": [None] * len(out["g"])}

    form = "g string, m array<double>, p array<double>, det double"
    medians_start = materialise(map_columns(own.join(off, "g"), start, form))

    def measured(params: DataFrame) -> DataFrame:
        apart = [F.col(x) - F.col("m")[i] for i, x in enumerate(xs)]
        d2 = sum((F.col("p")[k] * apart[i] * apart[j] * (1 if i == j else 2) for k, (i, j) in enumerate(pairs)), F.lit(0.0))
        return stats.join(params.drop("det"), "g").withColumn("d2", d2)

    def refit(rows: dict, trimmed: bool = True) -> dict:
        out = {"g": rows["g"], "m": [], "p": [], "det": []}
        for k in range(len(rows["g"])):
            n = rows["n"][k]
            mean = np.array([rows[f"a{i}"][k] / n for i in range(dims)])
            cov = np.zeros((dims, dims))
            for i, j in pairs:
                cov[i, j] = cov[j, i] = rows[f"c{i}_{j}"][k] / n - mean[i] * mean[j]
            cov = (consistency if trimmed else 1.0) * cov
            apart = mean - np.array(centre)
            cov = (n * cov + weight * np.diag(scale)) / (n + weight) + np.outer(apart, apart) * (n * weight / (n + weight) ** 2)
            mean = (n * mean + weight * np.array(centre)) / (n + weight)
            cov += np.diag(fixed)
            inverse = np.linalg.inv(cov)
            out["det"].append(float(np.linalg.slogdet(cov)[1]))
            out["m"].append(mean.tolist())
            out["p"].append([float(inverse[i, j]) for i, j in pairs])
        return out

    sums = [F.sum(x).alias(f"a{i}") for i, x in enumerate(xs)] + [F.sum((F.col(xs[i]) * F.col(xs[j])).cast("decimal(20,0)")).alias(f"c{i}_{j}") for i, j in pairs]

    def moments(rows: DataFrame) -> DataFrame:
        kept = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *sums)
        return kept.select(*[F.col(c).cast("double").alias(c) if c[0] in "ac" else F.col(c) for c in kept.columns])

    def concentrated(params: DataFrame) -> DataFrame:
        before = None
        for _ in range(most):
            # Distances in thousandths of their logarithm, so few values that the exact quantile's state stays small.
            q = F.floor(1000 * F.log1p(F.greatest(F.col("d2"), F.lit(0.0)))).cast("long")
            rows = measured(params).withColumn("q", q)
            limit = materialise(rows.groupBy("g").agg(F.percentile("q", share).alias("limit")))
            kept = materialise(moments(rows.join(limit, "g").where(F.col("q") <= F.col("limit"))))
            new = materialise(map_columns(kept, refit, form))
            now = kept.agg(F.bit_xor(F.xxhash64(*kept.columns))).first()[0]
            discard(params, limit, kept)
            params = new
            if now == before:
                break
            before = now
        return params

    plain_start = materialise(map_columns(moments(stats), lambda rows: refit(rows, False), form))
    both = concentrated(medians_start).withColumn("start", F.lit(0)).unionByName(concentrated(plain_start).withColumn("start", F.lit(1)))
    best = both.groupBy("g").agg(F.min(F.struct("det", "start", "m", "p")).alias("b")).select("g", "b.m", "b.p", "b.det")
    return measured(materialise(best)).drop("m", "p")


def quality_rules(docs: DataFrame, rejected: float = 1e-6, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """Per row: doc_id, base counts, base_failed, kept, the squared distance, and hashes of text and group, by which rows are found again.

    rejected: the share of a normal group's rows that the distance limit would
    reject. Rows that fail the base rule take no part in the estimates.
    """
    stats = statistics(docs)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    stats = materialise(stats.withColumn("base_failed", failed))
    limit = chi2_quantile(len(NAMES), 1 - rejected)
    passed = robust_distances(stats.where(~F.col("base_failed")), len(NAMES), list(FLOORS.values()))
    out = passed.unionByName(stats.where("base_failed"), allowMissingColumns=True)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= limit)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("d2", 3).alias("distance2"), "text_hash", F.xxhash64("g").alias("stratum"))
