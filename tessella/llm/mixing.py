"""Mixing sources to target weights: a min-cost flow over membership patterns.

Documents are aggregated by pattern, the set of sources that count them as
members. A pattern's capacity is its number of words; taking it a second time
costs more than the first, so costs are convex in repetition. A min-cost flow
routes capacity to the sources' targets, and documents are then selected in a
seeded order until each pattern's flow is met: every document whole, as many
times as the flow has full passes, and a seeded part of them once more. The part
ends where the next document would overshoot; of all documents left over, the
one that comes nearest to the rest is added where that brings the sum closer.

Selection works on exact running sums: sums of 1,024 hash ranges of each pattern
first, rows of the range where the target falls only then, so no task holds a
pattern's documents. The flow itself runs on the driver over one row for each
pattern; more than MAX_PATTERNS of them is an error, not a cut.

A null text has 0 words, a null source is a source of its own and comes last.
Repeated rows are rows of their own, and equal rows share a position by number.
An empty table gives none.
"""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, words_in

MAX_PATTERNS = 200_000
RANGES = 1024


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Shares of share * sum(sizes) by weight; none above most times its size, the excess reshared among the rest."""
    out = [0.0] * len(sizes)
    free = [i for i in range(len(sizes))]
    left = share * sum(sizes)
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def route(capacity: list[int], members: list[list[int]], quota: list[int], repeats: int = 2) -> list[dict[int, int]]:
    """Min-cost flow: words of each pattern that go to each source it belongs to.

    Successive shortest augmenting paths from patterns to sources, where a
    pattern's r-th pass costs r. The least-used pass is filled first, so flow
    is rerouted between overlapping sources before anything repeats.
    """
    flow: list[dict[int, int]] = [dict.fromkeys(m, 0) for m in members]
    used = [0] * len(capacity)
    need = list(quota)
    holds: list[list[int]] = [[] for _ in quota]
    for p, sources in enumerate(members):
        for s in sources:
            holds[s].append(p)
    for passes in range(1, repeats + 1):
        for target in range(len(quota)):
            while need[target] > 0:
                # Breadth first from the source in need over patterns it may draw on; a full pattern
                # passes the demand on to the other sources that use it.
                came: dict[tuple[str, int], tuple[str, int] | None] = {("s", target): None}
                queue: list[tuple[int, int, tuple[str, int]]] = []
                order = 0
                heappush(queue, (0, order, ("s", target)))
                end = None
                while queue and end is None:
                    depth, _, (kind, k) = heappop(queue)
                    if kind == "s":
                        nexts = [("p", p) for p in holds[k]]
                    elif used[k] < passes * capacity[k]:
                        end = ("p", k)
                        break
                    else:
                        nexts = [("s", s) for s, f in flow[k].items() if f > 0]
                    for node in nexts:
                        if node not in came:
                            came[node] = (kind, k)
                            order += 1
                            heappush(queue, (depth + 1, order, node))
                if end is None:
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                amount = min(need[target], passes * capacity[end[1]] - used[end[1]])
                for a, b in zip(path[1::2], path[2::2]):  # source a gives its draw on pattern b to the one before
                    amount = min(amount, flow[b[1]][a[1]])
                used[end[1]] += amount
                for p, s in zip(path[::2], path[1::2]):
                    flow[p[1]][s[1]] += amount
                for s, p in zip(path[1::2], path[2::2]):
                    flow[p[1]][s[1]] -= amount
                need[target] -= amount
    return flow


def select(rows: DataFrame, plan: DataFrame, key: Column) -> DataFrame:
    """rows (with g, size) and column taken; plan gives for each g: passes, and part, the words once more.

    key orders the rows of a pattern. Rows of equal size and key are told apart by their number only.
    """
    spot = F.pmod(key, F.lit(RANGES)).cast("int")
    rows = rows.withColumn("_spot", spot).withColumn("_key", key)
    sums = rows.groupBy("g", "_spot").agg(F.sum("size").alias("_sum"))
    w = Window.partitionBy("g").orderBy("_spot")
    sums = sums.withColumn("_before", F.sum("_sum").over(w) - F.col("_sum"))
    # which ranges are taken whole, which one is cut
    ranges = sums.join(plan, "g").select("g", "_spot", "_before", "passes", "part", (F.col("_before") + F.col("_sum") <= F.col("part")).alias("_whole"), (F.col("_before") < F.col("part")).alias("_reached"))
    ranges = materialise(ranges)
    rows = rows.join(ranges, ["g", "_spot"])
    cut = F.col("_reached") & ~F.col("_whole")
    order = ["_key", "doc_id", "size"]
    inside = Window.partitionBy("g", "_spot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    some = materialise(rows.where(cut).withColumn("_run", F.col("_before") + F.sum("size").over(inside)))
    some = some.withColumn("_once", F.col("_run") <= F.col("part"))
    gap = some.groupBy("g", "part").agg(F.max(F.when(F.col("_once"), F.col("_run")).otherwise(F.col("_before"))).alias("_to")).select("g", (F.col("part") - F.col("_to")).alias("_gap"))
    others = rows.where(~F.col("_reached")).select("g", "_spot", *order).unionByName(some.where(~F.col("_once")).select("g", "_spot", *order))
    apart = F.abs(F.col("_gap") - F.col("size"))
    near = others.join(gap, "g").where(apart < F.col("_gap")).groupBy("g").agg(F.min(F.struct(apart.alias("d"), "_spot", *order)).alias("_best"))
    near = materialise(near)
    whole = rows.where(~cut).withColumn("_once", F.col("_reached") & F.col("_whole"))
    both = whole.unionByName(some.select(*whole.columns)).join(near, "g", "left")
    match = F.coalesce(~F.col("_once") & (F.struct("_spot", *order) == F.struct(*[F.col(f"_best.{c}") for c in ("_spot", *order)])), F.lit(False))
    added = both.where(match).withColumn("_once", F.row_number().over(Window.partitionBy("g").orderBy(*order)) == 1)
    both = both.where(~match).unionByName(added)
    out = both.withColumn("times", F.col("passes") + F.col("_once").cast("long")).withColumn("taken", F.col("size") * F.col("times"))
    return out.drop("_spot", "_key", "_before", "passes", "part", "_whole", "_reached", "_once", "_best")


def mix(docs: DataFrame, sources: Column | None = None, size: Column | None = None, cycle: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 17) -> DataFrame:
    """Per row of docs: row (the whole row), doc_id, source, size, source_size, target, times and taken.

    size: words of a document, by default those of its text. Columns of any
    name pass inside row.
    sources: the array of sources that a document belongs to; by default its own
    source alone. source_size and target are those of the column source.
    cycle: weights dealt to the sources in code-point order, null last.
    """
    spark = docs.sparkSession
    member = sources if sources is not None else F.array("source")
    # null sorts last and differs from every text
    named = F.array_sort(F.array_distinct(F.transform(member, lambda s: F.coalesce(F.concat(F.lit("v"), s.cast("string")), F.lit("~")))))
    own = F.coalesce(F.concat(F.lit("v"), F.col("source").cast("string")), F.lit("~"))
    words = words_in(F.col("text")) if size is None else size
    rows = materialise(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", words.alias("size"), own.alias("_own"), F.to_json(named).alias("g"), named.alias("_members")))
    patterns = rows.groupBy("g", "_own").agg(F.sum("size").alias("size"), F.first("_members").alias("members"))
    found = patterns.take(MAX_PATTERNS + 1)
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    order = lambda s: (s == "~", s)
    names = sorted({s for r in found for s in [*r["members"], r["_own"]]}, key=order)
    at = {s: i for i, s in enumerate(names)}
    own_sizes, capacity, members = [0] * len(names), {}, {}
    for r in found:
        own_sizes[at[r["_own"]]] += r["size"]
        capacity[r["g"]] = capacity.get(r["g"], 0) + r["size"]
        members[r["g"]] = [at[s] for s in r["members"]]
    aims = targets(own_sizes, [cycle[i % len(cycle)] for i in range(len(names))], share, repeats)
    keys = sorted(capacity)
    flow = route([capacity[g] for g in keys], [members[g] for g in keys], [round(t) for t in aims], repeats)
    plan = []
    for g, out in zip(keys, flow):
        total, size = sum(out.values()), capacity[g]
        passes = total // size if size else 0
        plan.append((g, passes, total - passes * size if passes < repeats else 0))
    plan_df = spark.createDataFrame(plan, "g string, passes long, part long")
    about = spark.createDataFrame([(s, own_sizes[i], aims[i]) for s, i in at.items()], "_own string, source_size long, target double")
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    return select(rows, plan_df, key).join(about, "_own").drop("_own", "g", "_members")
