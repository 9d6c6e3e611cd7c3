"""Event patterns and process mining over (key, type, t, id) event tables; t in seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import held, parts_of


def sequence(events: DataFrame, types: list[str], within: float) -> DataFrame:
    """(key, id, end) of events of types[0] that are followed, in order, by the other types within `within` seconds.

    Greedy and exact: each step takes the earliest later event of the next type,
    which a window over the key finds; no self-join.
    """
    w = Window.partitionBy("key").orderBy("t", "id").rowsBetween(1, Window.unboundedFollowing)
    reach = events.withColumn("_end", F.when(F.col("type") == types[-1], F.col("t")))
    for name in reversed(types[:-1]):
        later = F.min("_end").over(w)
        reach = reach.withColumn("_later", later).withColumn("_next", F.when(F.col("type") == name, F.col("_later")))
        reach = reach.withColumn("_end", F.col("_next"))
    return reach.where((F.col("type") == types[0]) & (F.col("_end") - F.col("t") <= within)).select("key", "id", F.col("_end").alias("end"))


def absence(events: DataFrame, first: str, absent: str, within: float) -> DataFrame:
    """(key, id) of `first` events with no later `absent` event within `within` seconds."""
    w = Window.partitionBy("key").orderBy("t", "id").rowsBetween(1, Window.unboundedFollowing)
    after = events.withColumn("_n", F.min(F.when(F.col("type") == absent, F.col("t"))).over(w))
    return after.where((F.col("type") == first) & (F.col("_n").isNull() | (F.col("_n") - F.col("t") > within))).select("key", "id")


def sessions(events: DataFrame, gap: float) -> DataFrame:
    """(key, session, start, end, n): runs of events no more than gap apart."""
    w = Window.partitionBy("key").orderBy("t", "id")
    new = (F.col("t") - F.lag("t").over(w) > gap).cast("long")
    numbered = events.withColumn("session", F.coalesce(F.sum(F.coalesce(new, F.lit(0))).over(w), F.lit(0)))
    return numbered.groupBy("key", "session").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("n"))


def directly_follows(events: DataFrame) -> DataFrame:
    """(a, b, n): how often type b directly follows type a within a key."""
    w = Window.partitionBy("key").orderBy("t", "id")
    return events.select("type", F.lead("type").over(w).alias("b")).where("b IS NOT NULL").groupBy(F.col("type").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))


def footprint(follows: DataFrame) -> DataFrame:
    """(a, b, relation) of the alpha footprint: causal, parallel or choice (neither order occurs)."""
    names = follows.select(F.explode(F.array("a", "b")).alias("x")).distinct()
    pairs = names.select(F.col("x").alias("a")).crossJoin(names.select(F.col("x").alias("b")))  # activities, not events
    f = follows.select("a", "b", F.lit(True).alias("f"))
    g = follows.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("g"))
    both = pairs.join(f, ["a", "b"], "left").join(g, ["a", "b"], "left")
    return both.select("a", "b", F.when(F.col("f") & F.col("g"), "parallel").when(F.col("f"), "causal").when(F.col("g"), "reverse").otherwise("choice").alias("relation"))


def association(items: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, n, support, confidence, lift) of item pairs in at least `least` baskets; items (basket, item) is distinct."""
    total = items.select("basket").distinct().count()
    single = items.groupBy("item").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least)
    kept = held(items.join(single.select("item"), "item", "left_semi"))
    parts = parts_of(kept)
    kept = kept.repartition(parts, "basket")
    pair = kept.alias("p").join(kept.alias("q"), F.col("p.basket") == F.col("q.basket")).where("p.item < q.item").select(F.col("p.item").alias("a"), F.col("q.item").alias("b"))
    pair = pair.repartition(parts, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    pair = pair.join(single.select(F.col("item").alias("a"), F.col("c").alias("ca")), "a").join(single.select(F.col("item").alias("b"), F.col("c").alias("cb")), "b")
    return pair.select("a", "b", "n", (F.col("n") / total).alias("support"), (F.col("n") / F.col("ca")).alias("confidence"), (F.col("n") * total / (F.col("ca") * F.col("cb"))).alias("lift"))


def diff_in_diff(rows: DataFrame) -> DataFrame:
    """One row of the four means and the effect; rows (treated, post, y)."""
    mean = lambda t, p: F.avg(F.when((F.col("treated") == t) & (F.col("post") == p), F.col("y")))
    m = rows.agg(mean(True, True).alias("tp"), mean(True, False).alias("tb"), mean(False, True).alias("cp"), mean(False, False).alias("cb"))
    effect = (F.col("tp") - F.col("tb")) - (F.col("cp") - F.col("cb"))
    return m.select("*", effect.alias("effect"), F.coalesce(F.try_divide(effect, F.col("tb")), F.lit(0.0)).alias("relative"))


def entity_pairs(records: DataFrame, threshold: float, chunk: int = 256) -> DataFrame:
    """(a, b, score) of records of the same block whose token sets have a Jaccard of at least threshold > 0; records (id, block, text).

    Equal sets of a block are compared once. Sets of the wanted similarity share a
    token among their rarest ones, as many as they may differ in and one more. The
    records of two similar sets then meet in chunks of about `chunk` ids a side,
    dealt out evenly, so no task holds a whole set or block.
    """
    if threshold <= 0:
        raise ValueError("a threshold of 0 or below pairs all records")
    tokens = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("text"), r"\W+"), lambda t: t != "")))
    r = held(records.select("id", "block", tokens.alias("tokens")).where("id IS NOT NULL AND block IS NOT NULL AND size(tokens) > 0"))
    sets = held(r.groupBy("block", "tokens").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.monotonically_increasing_id()))
    each = sets.select("g", F.explode("tokens").alias("token"))
    rare = each.join(each.groupBy("token").agg(F.count(F.lit(1)).alias("f")), "token").groupBy("g").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("by"))
    some = F.size("by") - F.ceil(F.size("by") * F.lit(threshold) - 1e-9).cast("int") + 1
    front = held(sets.join(rare, "g").select("g", "block", "tokens", F.explode(F.slice("by", F.lit(1), some)).alias("e")).select("g", "block", "tokens", "e.token"))
    common = F.size(F.array_intersect("p.tokens", "q.tokens"))
    score = common / (F.size("p.tokens") + F.size("q.tokens") - common)
    met = front.alias("p").join(front.alias("q"), ["block", "token"]).where("p.g < q.g").select(F.col("p.g").alias("ga"), F.col("q.g").alias("gb"), score.alias("score"))
    close = met.where(F.col("score") >= threshold).distinct().unionByName(sets.where("n > 1").select(F.col("g").alias("ga"), F.col("g").alias("gb"), F.lit(1.0).alias("score")))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / chunk).cast("long"))
    chunks = held(r.join(sets, ["block", "tokens"]).groupBy("g", part.alias("c")).agg(F.collect_list("id").alias("ids")))
    left, right = chunks.select(F.col("g").alias("ga"), F.col("c").alias("ca"), F.col("ids").alias("xs")), chunks.select(F.col("g").alias("gb"), F.col("c").alias("cb"), F.col("ids").alias("ys"))
    meet = held(close.join(left, "ga").join(right, "gb").where("ga < gb OR ca <= cb"))
    total = meet.agg(F.sum(F.size("xs").cast("long") * F.size("ys"))).first()[0] or 0
    parts = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 4_000_000)
    pairs = meet.repartition(parts).withColumn("x", F.explode("xs")).select("ga", "gb", "ca", "cb", "x", "score", F.explode("ys").alias("y"))
    return pairs.where("x < y OR (x > y AND (ga < gb OR ca < cb))").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


def robust_anomalies(rows: DataFrame, group: str, value: str, cut: float = 3.5) -> DataFrame:
    """rows with score = 0.6745 (x - median) / MAD of their group, and flag; a MAD of 0 gives 0."""
    med = rows.groupBy(group).agg(F.percentile(value, 0.5).alias("_m"))
    dev = rows.join(med, group).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    mad = dev.groupBy(group).agg(F.percentile("_d", 0.5).alias("_mad"))
    score = F.coalesce(F.try_divide(0.6745 * (F.col(value) - F.col("_m")), F.col("_mad")), F.lit(0.0))
    return dev.join(mad, group).withColumn("score", score).withColumn("flag", F.abs("score") > cut).drop("_m", "_d", "_mad")
