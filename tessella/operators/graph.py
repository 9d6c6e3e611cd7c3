"""Graph operators on edge tables (src, dst): traversal, components, ranks, triangles, similarity, propagation.

Loops run on the driver, their steps are joins and aggregations; each step's
table is written as Parquet, so plans stay short and lost executors cost one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import scratch


def held(df: DataFrame) -> DataFrame:
    """df written as Parquet to a folder that all machines share, and read back: lineage ends, column pruning and sizes stay known."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_of(df: DataFrame, rows: int = 500_000) -> int:
    """How many partitions hold about `rows` rows of df each, the session's number at least: a task's memory then doesn't grow with the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def traverse(edges: DataFrame, seeds: DataFrame, least: int = 1, most: int = 1) -> DataFrame:
    """(id, depth) of nodes first reached at depth least..most by outgoing edges; seeds are depth 0."""
    front = seen = held(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, most + 1):
        step = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        front = held(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front)
        if not front.take(1):
            break
    return seen.where((F.col("depth") >= least) & (F.col("depth") <= most))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree)."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct pairs a < b."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """(id, triangles, coefficient), edges taken as undirected. Pairs point from the node of lower degree, which bounds hubs' wedges."""
    pairs = held(undirected(edges))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    da, db = degree.select(F.col("id").alias("a"), F.col("d").alias("da")), degree.select(F.col("id").alias("b"), F.col("d").alias("db"))
    low = F.struct("da", "a") < F.struct(F.col("db").alias("da"), F.col("b").alias("a"))
    out = held(pairs.join(da, "a").join(db, "b").select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y")))
    wedges = out.alias("p").join(out.alias("q"), F.col("p.x") == F.col("q.x")).where("p.y < q.y").select(F.col("p.x").alias("x"), F.col("p.y").alias("a"), F.col("q.y").alias("b"))
    found = wedges.join(pairs, ["a", "b"]).select(F.explode(F.array("x", "a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    t = F.coalesce("t", F.lit(0))
    d = F.col("d")
    return degree.join(found, "id", "left").select("id", t.alias("triangles"), F.when(d < 2, F.lit(0.0)).otherwise(2 * t / (d * (d - 1))).alias("coefficient"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, directions ignored; labels jump along labels, so steps are logarithmic on paths."""
    pairs = held(undirected(edges))
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    labels = held(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("id"), F.least("x", "m").alias("component")))
    while True:
        near = both.join(labels, both["y"] == labels["id"]).groupBy("x").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["id"] == near["x"]).select("id", F.least("component", "m").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        now = held(step.join(jump, "component", "left").select("id", F.least("component", F.coalesce("up", "component")).alias("component")))
        moved = now.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old").take(1)
        labels = now
        if not moved:
            return labels


def pagerank(edges: DataFrame, damping: float = 0.85, tol: float = 1e-7, most: int = 100, seeds: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """(id, rank); ranks sum to 1 and dangling mass is spread evenly, or over the seeds (id) if given."""
    e = edges.groupBy("src", "dst").agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("double").alias("w"))
    total = e.groupBy("src").agg(F.sum("w").alias("t"))
    e = held(e.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p")))
    ids = held(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(total.select(F.col("src").alias("id"), F.lit(False).alias("dangling")), "id", "left").fillna(True, ["dangling"]))
    home = ids.withColumn("h", F.lit(1.0)) if seeds is None else ids.join(seeds.select("id").distinct().withColumn("h", F.lit(1.0)), "id", "left").fillna(0.0, ["h"])
    mass = home.agg(F.sum("h")).first()[0] or 1.0
    ids = held(home.withColumn("h", F.col("h") / mass))
    ranks = ids.withColumn("rank", F.col("h"))
    for _ in range(most):
        lost = ranks.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        sent = e.join(ranks, e["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        new = (1 - damping) * F.col("h") + damping * (F.coalesce("got", F.lit(0.0)) + lost * F.col("h"))
        now = held(ranks.join(sent, ranks["id"] == sent["dst"], "left").select("id", "dangling", "h", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")))
        apart = now.agg(F.sum("moved")).first()[0]
        ranks = now.drop("moved")
        if apart < tol:
            break
    return ranks.select("id", "rank")


def label_propagation(edges: DataFrame, sweeps: int = 10) -> DataFrame:
    """(id, label): each node takes its neighbours' most frequent label, ties to the smallest; synchronous sweeps."""
    pairs = undirected(edges)
    both = held(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"))))
    labels = both.select(F.col("x").alias("id")).distinct().withColumn("label", F.col("id"))
    parts = parts_of(both)
    for _ in range(sweeps):
        votes = both.join(labels, both["y"] == labels["id"]).select("x", "label").repartition(parts, "x").groupBy("x", "label").agg(F.count(F.lit(1)).alias("n"))
        place = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("n"), "label"))
        labels = held(votes.withColumn("r", place).where("r = 1").select(F.col("x").alias("id"), "label"))
    return labels


def k_core(edges: DataFrame) -> DataFrame:
    """(id, coreness), undirected: from the degrees down, each node takes the largest h that h neighbours reach, until nothing changes."""
    pairs = undirected(edges)
    both = held(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"))))
    cores = held(both.groupBy(F.col("x").alias("id")).agg(F.count(F.lit(1)).alias("coreness")))
    while True:
        mine, near = cores.select(F.col("id").alias("x"), F.col("coreness").alias("cx")), cores.select(F.col("id").alias("y"), F.col("coreness").alias("cy"))
        counts = both.join(near, "y").join(mine, "x").groupBy("x", "cx", F.least("cx", "cy").alias("c")).agg(F.count(F.lit(1)).alias("n"))
        reach = F.sum("n").over(Window.partitionBy("x").orderBy(F.desc("c")))
        now = held(counts.withColumn("h", F.least("c", reach)).groupBy("x", "cx").agg(F.max("h").alias("h")))
        cores = now.select(F.col("x").alias("id"), F.col("h").alias("coreness"))
        if not now.where("h < cx").take(1):
            return cores


def similarity(edges: DataFrame, metric: str = "jaccard", cutoff: float = 0.0) -> DataFrame:
    """(a, b, score) of node pairs with common out-neighbours and a score above cutoff."""
    e = held(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    parts = parts_of(e, 100_000)  # a task counts the pairs of so many edges
    size = e.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    # a node gets the later nodes of each of its neighbours as lists, which are much smaller on the way than pairs; then it counts
    chunk = F.pmod(F.xxhash64("src"), F.ceil(F.col("d") / 1024).cast("long"))
    lists = e.join(e.groupBy("dst").agg(F.count(F.lit(1)).alias("d")), "dst").groupBy("dst", chunk.alias("c")).agg(F.array_sort(F.collect_list("src")).alias("l"))
    lists = lists.withColumnRenamed("dst", "at").repartition(parts, "at")
    later = e.repartition(parts, "dst").join(lists, F.col("dst") == F.col("at")).select(F.col("src").alias("a"), F.filter("l", lambda b: b > F.col("src")).alias("l")).where(F.size("l") > 0)
    common = later.repartition(parts, "a").select("a", F.explode("l").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    near = size.select(F.col("src").alias("a"), F.col("n").alias("na")).repartition(parts, "a")
    least = (cutoff if metric == "jaccard" else cutoff * cutoff) * (1 - 1e-9)  # nb is c at least
    common = common.join(near, "a").where((F.col("c") > least * F.col("na")) | F.lit(cutoff <= 0))
    both = common.join(size.select(F.col("src").alias("b"), F.col("n").alias("nb")), "b")
    score = F.col("c") / (F.col("na") + F.col("nb") - F.col("c")) if metric == "jaccard" else F.col("c") / F.sqrt(F.col("na") * F.col("nb"))
    return both.select("a", "b", score.alias("score")).where(F.col("score") > cutoff)


def link_features(edges: DataFrame) -> DataFrame:
    """(a, b) of pairs with common neighbours: common, Jaccard, Adamic-Adar, preferential attachment; undirected."""
    pairs = undirected(edges)
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    degree = both.groupBy("x").agg(F.count(F.lit(1)).alias("d"))
    mid = both.join(degree.select(F.col("x").alias("y"), F.col("d").alias("dy")), "y")
    found = mid.alias("p").join(mid.alias("q"), F.col("p.y") == F.col("q.y")).where("p.x < q.x").groupBy(F.col("p.x").alias("a"), F.col("q.x").alias("b")).agg(F.count(F.lit(1)).alias("common"), F.sum(1 / F.log(F.col("p.dy").cast("double"))).alias("adamic_adar"))
    found = found.join(degree.select(F.col("x").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("x").alias("b"), F.col("d").alias("db")), "b")
    return found.select("a", "b", "common", (F.col("common") / (F.col("da") + F.col("db") - F.col("common"))).alias("jaccard"), "adamic_adar", (F.col("da") * F.col("db")).alias("attachment"))


def noisy_or(edges: DataFrame, seeds: DataFrame, hops: int = 8) -> DataFrame:
    """(id, p): P(v) = 1 - (1 - prior) * prod(1 - w * P(u)) over edges (src, dst, w), unrolled for `hops` rounds; seeds (id, prior)."""
    p = held(seeds.select("id", F.col("prior").alias("p")))
    prior = p.withColumnRenamed("p", "prior")
    for _ in range(hops):
        sent = edges.join(p, edges["src"] == p["id"]).groupBy(F.col("dst").alias("id")).agg(F.product(1 - F.col("w") * F.col("p")).alias("miss"))
        full = sent.join(prior, "id", "full")
        p = held(full.select("id", (1 - (1 - F.coalesce("prior", F.lit(0.0))) * F.coalesce("miss", F.lit(1.0))).alias("p")))
    return p


def shortest_paths(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, distance) over edges (src, dst, w): relaxation from seeds (id) until nothing improves. A weight below 0 is an error."""
    if edges.where("w < 0").take(1):
        raise ValueError("a weight below 0")
    best = held(seeds.select("id", F.lit(0.0).alias("distance")))
    front = best
    while True:
        step = front.join(edges, front["id"] == edges["src"]).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("w")).alias("new"))
        better = held(step.join(best, "id", "left").where(F.col("distance").isNull() | (F.col("new") < F.col("distance"))).select("id", F.col("new").alias("distance")))
        if not better.take(1):
            return best
        best = held(best.join(better.select("id"), "id", "left_anti").unionByName(better))
        front = better


def neighbour_mean(edges: DataFrame, features: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(id, x): alpha * x + (1 - alpha) * mean of out-neighbours' x."""
    near = edges.join(features.select(F.col("id").alias("dst"), F.col("x").alias("nx")), "dst").groupBy(F.col("src").alias("id")).agg(F.avg("nx").alias("m"))
    return features.join(near, "id", "left").select("id", (alpha * F.col("x") + (1 - alpha) * F.coalesce("m", F.lit(0.0))).alias("x"))
