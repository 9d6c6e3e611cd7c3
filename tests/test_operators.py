"""Operators that SQL doesn't check: against plain Python on small inputs."""

import collections
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import graph, retrieval, rules, timeseries
from tessella.plans import pipes
from tessella.sources import lake
from tessella.streaming import changes, windows


def pairs(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def test_components_and_cores(spark):
    e = pairs(spark, [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (100, 102), (102, 103), (7, 7)])
    found = {r["id"]: r["component"] for r in graph.components(e).collect()}
    assert set(found.values()) == {0, 100} and found[30] == 0 and found[103] == 100
    cores = {r["id"]: r["coreness"] for r in graph.k_core(pairs(spark, [(100, 101), (101, 102), (100, 102), (102, 103)])).collect()}
    assert cores == {100: 2, 101: 2, 102: 2, 103: 1}


def test_pagerank_sums_to_one_and_matches_power_iteration(spark):
    rows = [(0, 1), (1, 2), (2, 0), (2, 3)]
    got = {r["id"]: r["rank"] for r in graph.pagerank(pairs(spark, rows), tol=1e-9).collect()}
    p = dict.fromkeys(range(4), 0.25)
    out = {0: [1], 1: [2], 2: [0, 3], 3: []}
    for _ in range(200):
        lost = p[3]
        p = {v: 0.15 / 4 + 0.85 * (lost / 4 + sum(p[u] / len(out[u]) for u in out if v in out[u])) for v in p}
    assert math.isclose(sum(got.values()), 1, abs_tol=1e-6)
    assert all(math.isclose(got[v], p[v], abs_tol=1e-6) for v in p)


def test_shortest_paths_against_relaxation(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(12), rng.randrange(12), rng.randrange(1, 9)) for _ in range(40)]
    got = {r["id"]: r["distance"] for r in graph.shortest_paths(spark.createDataFrame(rows, "src long, dst long, w long"), spark.createDataFrame([(0,)], "id long")).collect()}
    best = {0: 0}
    for _ in range(12):
        for a, b, w in rows:
            if a in best and best[a] + w < best.get(b, 1e9):
                best[b] = best[a] + w
    assert got == best


def test_resample(spark):
    p = spark.createDataFrame([("a", 0, 0.0), ("a", 10, 10.0)], "series string, t long, value double")
    g = spark.createDataFrame([("a", t) for t in (-1, 0, 5, 6, 10, 11)], "series string, t long")
    at = lambda mode: {r["t"]: r["value"] for r in timeseries.resample(p, g, mode).collect()}
    assert at("linear") == {-1: None, 0: 0.0, 5: 5.0, 6: 6.0, 10: 10.0, 11: None}
    assert at("nearest")[5] == 0.0 and at("nearest")[6] == 10.0
    assert at("hold")[11] == 10.0 and at("hold")[-1] is None


def test_rrf_ranks_from_zero(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "id string, rank long")
    b = spark.createDataFrame([("y", 0)], "id string, rank long")
    got = {r["id"]: r["score"] for r in retrieval.rrf([a, b]).collect()}
    assert math.isclose(got["y"], 1 / 61 + 1 / 60) and math.isclose(got["x"], 1 / 60)


def test_chain_keeps_the_best_confidence(spark):
    facts = spark.createDataFrame([("a", "sub", "b", 0.9), ("b", "sub", "c", 0.5), ("a", "sub", "x", 1.0), ("x", "sub", "c", 0.8)], "s string, p string, o string, conf double")
    got = {(r["s"], r["o"]): r["conf"] for r in rules.chain(facts, ["sub", "sub"], "sub", 0.5).collect()}
    assert math.isclose(got["a", "c"], 0.4)


def test_pipes_round_trip_and_faults(spark):
    text = "LET a = MATCH (:n) WHERE v > 1 ; FROM a |> LIMIT 2"
    once = pipes.show(text)
    assert pipes.show(once) == once
    for bad in ("WHERE x = 1 |>", "MATCH (", "MATCH () |> LIMIT", "MATCH () |> NOPE", "MATCH () WHERE v = $p"):
        with pytest.raises(pipes.SyntaxFault):
            pipes.show(bad)


def test_pipes_traverse_skips_seeds_and_limit_is_a_prefix(spark):
    nodes = spark.createDataFrame([(c, "n", float(i)) for i, c in enumerate("abcde")], "id string, label string, v double")
    edges = spark.createDataFrame([("a", "b", "E"), ("b", "c", "E"), ("c", "a", "E"), ("c", "d", "F")], "src string, dst string, rel string")
    hop = pipes.run("MATCH (:n) WHERE id = 'a' |> TRAVERSE -[:E]->{1,5}", nodes, edges)
    assert {r["id"] for r in hop.collect()} == {"b", "c"}
    every = [r["id"] for r in pipes.run("MATCH () |> RANK BY v DESC |> LIMIT 5", nodes, edges).orderBy("ord").collect()]
    assert every == list("edcba")
    assert [r["id"] for r in pipes.run("MATCH () |> RANK BY v DESC |> LIMIT 2", nodes, edges).orderBy("ord").collect()] == every[:2]


def test_zset_view_equals_recompute(spark):
    base = spark.createDataFrame([(1, "a", 2), (2, "b", 3)], "k long, g string, v long").withColumn("weight", F.lit(1))
    events = spark.createDataFrame([((1, "a", 2), (1, "b", 5)), ((2, "b", 3), None), (None, (3, "a", 7))], "before struct<k: long, g: string, v: long>, after struct<k: long, g: string, v: long>")
    after = changes.apply(base, changes.deltas(events, ["k", "g", "v"]))
    assert sorted(tuple(r) for r in changes.aggregated(after, ["g"], "v").collect()) == [("a", 1, 7), ("b", 1, 5)]


def test_stream_equals_batch(spark):
    from tessella.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    stream = QUERIES["stream_tumbling"](spark, sf).count()
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert stream == e.groupBy(F.date_trunc("day", "ts"), "event_type").count().count()
    assert windows.file_stream(spark, sf, "events.parquet").isStreaming


def test_lake_versions_and_schema_growth(spark, tmp_path):
    t = lake.Table(spark, str(tmp_path / "t"))
    first = t.write(spark.createDataFrame([(1,)], "a long"))
    t.write(spark.createDataFrame([(2, "x")], "a long, b string"))
    assert t.read(first).collect()[0]["a"] == 1
    assert {(r["a"], r["b"]) for r in t.read().collect()} == {(1, None), (2, "x")}
    t.write(spark.createDataFrame([(9,)], "a long"), "overwrite")
    assert [r["a"] for r in t.read().collect()] == [9]


def test_line_formats(spark):
    lines = spark.createDataFrame([("<34>Oct 11 22:14:15 host su: failed",), ("junk",)], "value string")
    got = [tuple(r) for r in lake.syslog(lines).collect()]
    assert got[0] == (4, 2, "host", "su", "failed") and got[1][0] is None
    nt = spark.createDataFrame([('<a> <b> "c\\"d"@en .',), ("# no",), ("<a> <b> _:x .",)], "value string")
    assert [r["o"] for r in lake.n_triples(nt).collect()] == ['"c\\"d"@en', "_:x"]


def test_cypher_faults_and_optional(spark):
    from tessella.plans import cypher

    nodes = spark.createDataFrame([("a", "p", 1.0), ("b", "p", 2.0), ("c", "q", 3.0)], "id string, label string, v double")
    edges = spark.createDataFrame([("a", "c", "E"), ("b", "c", "F")], "src string, dst string, rel string")
    got = cypher.run("MATCH (x:p) OPTIONAL MATCH (x)-[:E]->(y) RETURN x.id AS x, y.id AS y ORDER BY x", nodes, edges).collect()
    assert [tuple(r) for r in got] == [("a", "c"), ("b", None)]
    one = cypher.run("MATCH (x)-[:E|F]->(y:q) WHERE x.v IN [2, 9] OR y.id CONTAINS 'zz' RETURN DISTINCT x.id AS x SKIP 0 LIMIT 5", nodes, edges).collect()
    assert [r["x"] for r in one] == ["b"]
    for bad in ("RETURN 1", "MATCH (a)", "MATCH (a)-(b) RETURN a.id", "MATCH (a) WHERE sleep(1) RETURN a.id", "MATCH (a) RETURN a.id AS a LIMIT x"):
        with pytest.raises(cypher.CypherFault):
            cypher.run(bad, nodes, edges)


def test_frequent_sequences_of_whole_histories(spark, tmp_path):
    from tessella.plans.library import QUERIES

    rng = random.Random(11)
    users = {u: [rng.choice("aaabbc" if u % 3 else "cdde") for _ in range(rng.randrange(1, 12))] for u in range(25)}
    rows = [(100 * u + i, u, i // 2, kind) for u, kinds in users.items() for i, kind in enumerate(kinds)]
    rng.shuffle(rows)
    made = spark.createDataFrame(rows, "event_id long, user_id long, s long, event_type string")
    made.select("event_id", "user_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "event_type", F.lit(1.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    want = collections.Counter(p for kinds in users.values() for p in {">".join(c) for k in range(1, 5) for c in itertools.combinations(kinds, k)})
    got = {r["sequence"]: r["n"] for r in QUERIES["frequent_sequences"](spark, str(tmp_path)).collect()}
    assert got == {p: n for p, n in want.items() if n >= 0.1 * len(users)}


def test_supplier_graph_has_all_items(spark, tmp_path):
    from tessella.plans.library import QUERIES

    rng = random.Random(4)
    rows = [(o, rng.randrange(14) + 20 * (o % 3 == 0), float(rng.randrange(1, 51))) for o in range(30) for _ in range(rng.randrange(1, 4))] + [(90, 1, None), (90, 77, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    near = collections.defaultdict(set)
    for (o, a, _), (p, b, _) in itertools.product(rows, rows):
        if o == p and a != b:
            near[a].add(b)
    cores, left, k = {}, {x: set(v) for x, v in near.items()}, 0
    while left:
        x = min(left, key=lambda x: len(left[x]))
        cores[x] = k = max(k, len(left[x]))
        for y in left.pop(x):
            left[y].discard(x)
    labels = {x: x for x in near}
    for _ in range(5):
        votes = {x: collections.Counter(labels[y] for y in v) for x, v in near.items()}
        labels = {x: min(v, key=lambda c: (-v[c], c)) for x, v in votes.items()}
    far = {min(near): 0}
    for _ in near:
        for x, y in [(x, y) for x in near if x in far for y in near[x]]:
            far[y] = min(far.get(y, math.inf), far[x] + abs(x - y))
    got = lambda name: {r[0]: r[1] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got("k_core") == cores
    assert got("label_propagation") == labels
    assert got("shortest_paths") == far


def test_gaussian_mixture_sees_every_component(spark, tmp_path):
    from tessella.plans.library import QUERIES

    rng = random.Random(6)
    rows = [(i, [0.1] * 4 + [rng.gauss(0.8 * (i % 2), 0.1) for _ in range(60)]) for i in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    # the first four components are alike in all rows
    assert len({r["cluster"] for r in QUERIES["gaussian_mixture"](spark, str(tmp_path)).collect()}) > 1
