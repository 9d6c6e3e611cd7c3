"""Vector and text retrieval: exact top-k, filters, BM25, rank fusion, diversity, recall."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import held


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Null for different lengths and for zero vectors."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def l2(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, v: s + v)))


def top_k(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """(vec_id, score) of the k best rows that pass where; nearest first, ties by id. One pass, a bounded heap for each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col("embedding")
    score = {"cosine": lambda: cosine(v, q), "l2": lambda: -l2(v, q), "ip": lambda: dot(v, q)}[metric]()
    rows = vectors if where is None else vectors.where(where)
    return rows.select("vec_id", score.alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "vec_id").limit(k)


def packed(rows: DataFrame, key: str, vector: str, block: int = 1024) -> DataFrame:
    """(d, ids, units): rows in blocks of at most `block` unit vectors of length d, as bytes of 64-bit numbers. Vectors must be neither null nor zero."""
    def run(batches):
        for batch in batches:
            lists, ids = batch.column(vector), np.asarray(batch.column(key), np.int64)
            sizes, values = np.asarray(pc.list_value_length(lists)), np.asarray(lists.flatten(), np.float64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            for d in np.unique(sizes):
                where = np.flatnonzero(sizes == d)
                for i in range(0, len(where), block):
                    some = where[i : i + block]
                    v = values[at[some][:, None] + np.arange(d)]
                    v = v / np.abs(v).max(1, keepdims=True)  # else squares of very large or small components leave the range
                    v /= np.linalg.norm(v, axis=1, keepdims=True)
                    yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "ids": pa.array([ids[some].tobytes()], pa.binary()), "units": pa.array([v.tobytes()], pa.binary())})

    return rows.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector)).mapInArrow(run, "d int, ids binary, units binary")


def best_blocks(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query, vec_id, score): the k best by cosine that a task saw of each query, of every block of `queries` with every block of `vectors` (packed).

    A task holds a block of either side, and the k best of at most 64 blocks of queries.
    """
    both = vectors.select("d", "ids", "units").crossJoin(queries.select(F.col("d").alias("qd"), F.col("ids").alias("qids"), F.col("units").alias("q")))

    def told(best):
        for names, ids, score in best.values():
            m = ids.shape[1]
            yield pa.RecordBatch.from_pydict({"query": np.repeat(names, m), "vec_id": ids.ravel(), "score": score.ravel()})

    def run(batches):
        best = {}
        for batch in batches:
            for i in range(batch.num_rows):
                d, ids, units, qd, qids, q = (batch.column(c)[i] for c in range(6))
                if (d := d.as_py()) != qd.as_py():
                    continue
                key = qids.as_py()
                a, b = (np.frombuffer(x.as_buffer(), np.float64).reshape(-1, d) for x in (q, units))
                score, near = a @ b.T, np.frombuffer(ids.as_buffer(), np.int64)
                if score.shape[1] > 4 * k:  # those not below the k-th best score; of ties all, so that ids decide
                    bar = -np.partition(-score, k - 1, 1)[:, k - 1]
                    wide = int((score >= bar[:, None]).sum(1).max())
                    some = np.argpartition(-score, wide - 1, 1)[:, :wide]
                    score, near = np.take_along_axis(score, some, 1), near[some]
                near = np.broadcast_to(near, score.shape)
                if key in best:
                    score, near = np.hstack([best[key][2], score]), np.hstack([best[key][1], near])
                elif len(best) >= 64:
                    yield from told(best)
                    best = {}
                order = np.lexsort((near, -score), axis=1)[:, :k]
                best[key] = np.frombuffer(key, np.int64), np.take_along_axis(near, order, 1), np.take_along_axis(score, order, 1)
        yield from told(best)

    return both.mapInArrow(run, "query long, vec_id long, score double")


def knn_join(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, vec_id, score) by cosine, exact: blocks of queries against blocks of all rows, each task keeps its k best, then a merge.

    Both sides travel as blocks of bytes, so a task's memory doesn't grow with either. The
    work is queries times rows, as exactness asks. Null and zero vectors take no part on either side.
    """
    some = lambda df: df.where(F.col("embedding").isNotNull() & (dot(F.col("embedding"), F.col("embedding")) > 0))
    v, q = held(packed(some(vectors), "vec_id", "embedding")), held(packed(some(queries), "query", "embedding"))
    tasks = max(v.sparkSession.sparkContext.defaultParallelism, -(-v.count() // 64))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = best_blocks(q, v.repartition(tasks), k)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(docs: DataFrame, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of documents with a query term; lower-cased words, no stemming.

    Texts are split once: lengths and term counts are written as a narrow table,
    from which statistics and scores follow.
    """
    terms = sorted({t.lower() for t in query})
    words = F.split(F.lower("text"), r"[^\p{L}\p{N}]+")
    # split leaves an empty piece where the text begins or ends with a separator
    blank = lambda c: F.coalesce((c == "").cast("int"), F.lit(0))
    length = F.size("w") - blank(F.element_at("w", 1)) - F.when(F.size("w") > 1, blank(F.element_at("w", -1))).otherwise(0)
    found = [(F.size("w") - F.size(F.array_remove("w", F.lit(t)))).alias(f"tf{i}") for i, t in enumerate(terms)]
    counted = held(docs.where("text IS NOT NULL").select("doc_id", words.alias("w")).select("doc_id", length.alias("len"), *found))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    score = F.lit(0.0)
    for i in range(len(terms)):
        df = stats[f"df{i}"] or 0
        idf = float(np.log(1 + (n - df + 0.5) / (df + 0.5)))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / avgdl))
    return counted.select("doc_id", score.alias("score")).where("score > 0")


def snippets(docs: DataFrame, query: list[str], around: int = 40) -> DataFrame:
    """(doc_id, snippet): the text around the first query term as a whole word, the term in angle brackets; documents without one are left out."""
    terms = "|".join(sorted((re.escape(t) for t in query), key=len, reverse=True))
    pattern = rf"(?is)(?<![\p{{L}}\p{{N}}])({terms})(?![\p{{L}}\p{{N}}])"
    at = F.regexp_instr("text", F.lit(pattern))
    word = F.regexp_extract("text", pattern, 1)
    rows = docs.where(F.col("text").rlike(pattern)).select("doc_id", "text", at.alias("at"), word.alias("word"))
    low = F.greatest(F.col("at") - around, F.lit(1))
    before = F.substring(F.col("text"), low, F.col("at") - low)
    after = F.substring(F.col("text"), F.col("at") + F.length("word"), F.lit(around))
    return rows.select("doc_id", F.concat(before, F.lit("<"), "word", F.lit(">"), after).alias("snippet"))


def rrf(lists: list[DataFrame], k: float = 60) -> DataFrame:
    """(id, score): sum of 1 / (k + rank) over lists (id, rank), ranks from 0."""
    found = lists[0].select("id", "rank")
    for other in lists[1:]:
        found = found.unionByName(other.select("id", "rank"))
    return found.groupBy("id").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"))


def mmr(candidates: DataFrame, lam: float, k: int) -> DataFrame:
    """(vec_id, pick) of a greedy maximal-marginal-relevance choice among all candidates (vec_id, embedding, score).

    Each pick is one pass over all rows that keeps a single best one; ties go to
    the smaller id. Rows without score or of a zero vector take no part.
    """
    v, picked = F.col("embedding"), []
    rows = candidates.where("score IS NOT NULL")
    for _ in range(k):
        near = [cosine(v, F.array(*[F.lit(float(x)) for x in p["embedding"]])) for p in picked]
        apart = F.lit(0.0) if not near else near[0] if len(near) == 1 else F.greatest(*near)
        value = lam * F.col("score") - (1 - lam) * apart
        left = rows.where(~F.col("vec_id").isin([p["vec_id"] for p in picked])) if picked else rows
        best = left.where(value.isNotNull()).agg(F.max_by(F.struct("vec_id", "embedding"), F.struct(value.alias("v"), (-F.col("vec_id")).alias("i"))).alias("b")).first()["b"]
        if best is None:
            break
        picked.append(best)
    return candidates.sparkSession.createDataFrame([(int(p["vec_id"]), i) for i, p in enumerate(picked)], "vec_id long, pick long")


def retrieval_quality(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row of mean precision@k, recall@k, MRR and nDCG; ranked (query, id, rank from 1), relevant (query, id)."""
    hits = ranked.where(F.col("rank") <= k).join(relevant.select("query", "id").withColumn("hit", F.lit(1)), ["query", "id"])
    per = hits.groupBy("query").agg(F.count(F.lit(1)).alias("h"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    want = relevant.groupBy("query").agg(F.count(F.lit(1)).alias("r")).join(per, "query", "left").fillna(0, ["h", "dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("r", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return want.agg(
        F.avg(F.col("h") / k).alias("precision"), F.avg(F.col("h") / F.col("r")).alias("recall"),
        F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.col("dcg") / ideal).alias("ndcg"),
    )
