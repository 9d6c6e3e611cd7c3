"""Graph, finance and language operators that SQL doesn't check: against plain Python on small inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import centrality, graph, ontology, portfolio, retrieval, rules
from tessella.plans import cypher, graphql, sparql


def pairs(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


@pytest.fixture(scope="module")
def tangle():
    rng = random.Random(2)
    return sorted({tuple(sorted(rng.sample(range(9), 2))) for _ in range(14)})


def plain(df, *columns):
    return {r[columns[0]]: r[columns[1]] if len(columns) == 2 else tuple(r[c] for c in columns[1:]) for r in df.collect()}


def test_strong_components_and_levels(spark):
    e = pairs(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (4, 5), (6, 0), (7, 7)])
    assert plain(centrality.strongly_connected(e), "id", "component") == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7}
    levels = plain(centrality.topological_order(pairs(spark, [(0, 1), (1, 2), (0, 2), (2, 3), (5, 6), (6, 5), (6, 8)])), "id", "level")
    assert levels == {0: 0, 1: 1, 2: 2, 3: 3, 5: None, 6: None, 8: None}


def test_betweenness_counts_every_way(spark, tangle):
    ids = sorted({x for e in tangle for x in e})
    near = {i: [b if a == i else a for a, b in tangle if i in (a, b)] for i in ids}
    score = dict.fromkeys(ids, 0.0)
    for s, t in itertools.combinations(ids, 2):
        ways, front = [], [[s]]
        while front and not ways:
            front = [[*w, n] for w in front for n in near[w[-1]] if n not in w]
            ways = [w for w in front if w[-1] == t]
        for w in ways:
            for x in w[1:-1]:
                score[x] += 1 / len(ways)
    got = plain(centrality.betweenness(pairs(spark, tangle)), "id", "score")
    assert got == pytest.approx(score)


def test_eigenvector_and_article_rank(spark, tangle):
    ids = sorted({x for e in tangle for x in e})
    a = np.zeros((len(ids), len(ids)))
    for x, y in tangle:
        a[ids.index(x), ids.index(y)] = a[ids.index(y), ids.index(x)] = 1
    values, vectors = np.linalg.eigh(a)
    got = plain(centrality.eigenvector(pairs(spark, tangle), tol=1e-7), "id", "score")
    assert [got[i] for i in ids] == pytest.approx(np.abs(vectors[:, values.argmax()]).tolist(), abs=1e-4)
    out = [sum(x == i for x, _ in tangle) for i in ids]
    r = np.full(len(ids), 0.15)
    for _ in range(200):
        r = np.array([0.15 + 0.85 * sum(r[ids.index(x)] / (out[ids.index(x)] + np.mean(out)) for x, y in tangle if y == i) for i in ids])
    got = plain(centrality.article_rank(pairs(spark, tangle), tol=1e-7), "id", "score")
    assert [got[i] for i in ids] == pytest.approx(r.tolist(), abs=1e-5)


def test_colours_forest_and_walks(spark, tangle):
    colours = plain(centrality.greedy_colours(pairs(spark, tangle)), "id", "colour")
    assert all(colours[a] != colours[b] for a, b in tangle)
    weighted = [(a, b, float((a * 5 + b * 3) % 7)) for a, b in tangle]
    up = {x: x for e in tangle for x in e}

    def root(x):
        return x if up[x] == x else root(up[x])

    want = set()
    for w, a, b in sorted((w, a, b) for a, b, w in weighted):
        if root(a) != root(b):
            up[root(a)] = root(b)
            want.add((a, b, w))
    assert {tuple(r) for r in centrality.minimum_spanning_forest(spark.createDataFrame(weighted, "src long, dst long, w double")).collect()} == want
    walks = centrality.random_walks(pairs(spark, tangle), spark.createDataFrame([(i,) for i in range(9)], "id long"), 3).collect()
    ends = {a for a, _ in tangle}
    for r in walks:
        assert r["walk"][0] == r["id"] and all(e in tangle for e in zip(r["walk"], r["walk"][1:])) and (len(r["walk"]) == 4 or r["walk"][-1] not in ends)


def test_communities_of_two_cliques(spark):
    e = [(a, b) for k in (0, 5) for a, b in itertools.combinations(range(k, k + 5), 2)] + [(0, 5)]
    got = plain(centrality.leiden(pairs(spark, e), levels=2, sweeps=6), "id", "community")
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(5, 10)}) == 1 and got[0] != got[9]


def test_limits_are_errors(spark):
    facts = spark.createDataFrame([(str(i), "sub", str(i + 1), 1.0) for i in range(30)], "s string, p string, o string, conf double")
    assert rules.chain(facts, ["sub", "sub"], "sub").count() == 30 * 31 // 2
    with pytest.raises(ValueError):
        rules.chain(facts, ["sub", "sub"], "sub", most=2)
    far = graph.shortest_paths(spark.createDataFrame([(i, i + 1, 1) for i in range(12)], "src long, dst long, w long"), spark.createDataFrame([(0,)], "id long"))
    assert far.agg(F.max("distance")).first()[0] == 12.0
    assert graph.k_core(pairs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        graph.shortest_paths(spark.createDataFrame([(0, 1, -1)], "src long, dst long, w long"), spark.createDataFrame([(0,)], "id long"))


def test_diversity_and_zero_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((25, 4))
    score = rng.random(25)
    rows = [(i, v[i].tolist(), float(score[i])) for i in range(25)] + [(90, [0.0] * 4, 2.0), (91, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    u, picked = v / np.linalg.norm(v, axis=1, keepdims=True), []
    for _ in range(4):
        value = [0.6 * score[i] - 0.4 * max((u[i] @ u[p] for p in picked), default=0.0) if i not in picked else -9 for i in range(25)]
        picked.append(int(np.argmax(value)))
    assert [r["vec_id"] for r in retrieval.mmr(df.where("vec_id < 90"), 0.6, 4).orderBy("pick").collect()] == picked
    near = retrieval.knn_join(df.select("vec_id", "embedding"), df.where("vec_id IN (3, 90)").select(F.col("vec_id").alias("query"), "embedding"), 2).collect()
    assert {r["query"] for r in near} == {3} and all(r["vec_id"] < 90 for r in near)


def test_portfolios(spark):
    rng = np.random.default_rng(4)
    a = rng.standard_normal((4, 4))
    cov, mean = a @ a.T + np.eye(4), np.array([0.1, 0.2, 0.15, 0.05])
    w = portfolio.risk_parity(cov)
    assert np.ptp(w * (cov @ w)) < 1e-9 and (w > 0).all()
    best = portfolio.maximum_sharpe(mean, cov)
    ratio = lambda x: abs(x @ mean) / np.sqrt(x @ cov @ x)
    assert all(ratio(best) >= ratio(best + 0.05 * rng.standard_normal(4)) - 1e-12 for _ in range(50))
    market = np.full(4, 0.25)
    # a view without doubt is met, one of much doubt leaves the equilibrium
    pick = np.array([[1.0, 0, 0, 0]])
    assert portfolio.black_litterman(cov, market, pick, np.array([0.3]), np.array([1e-12]))[0] == pytest.approx(0.3)
    assert portfolio.black_litterman(cov, market, pick, np.array([0.3]), np.array([1e12])) == pytest.approx(2.5 * cov @ market)
    line = portfolio.efficient_frontier(mean, cov, 5)
    least = portfolio.minimum_variance(cov)
    assert line[0][1] == pytest.approx(np.sqrt(least @ cov @ least)) and [s for _, s in line] == sorted(s for _, s in line)
    rows = [(n, t, float(x)) for t in range(60) for n, x in zip("ab", rng.multivariate_normal([0, 0], [[1, 0.3], [0.3, 1]]))]
    var, cvar = portfolio.monte_carlo_var(spark.createDataFrame(rows, "asset string, t int, r double"), "asset", "t", "r", {"a": 0.5, "b": 0.5}, paths=20_000)
    sums = np.array([r for *_, r in rows]).reshape(-1, 2).mean(1)
    assert var == pytest.approx(1.645 * sums.std(ddof=1) - sums.mean(), rel=0.08) and cvar > var
    folds = portfolio.purged_folds(spark.createDataFrame([(i,) for i in range(12)], "t int"), "t", 3, 1).orderBy("t").collect()
    assert [r["fold"] for r in folds] == [0] * 4 + [1] * 4 + [2] * 4 and folds[4]["train_folds"] == [2] and folds[5]["train_folds"] == [0, 2] and folds[7]["train_folds"] == [0]


def test_proofs_name_their_rule(spark):
    t = spark.createDataFrame([("x", ontology.TYPE, "A"), ("A", ontology.SUBCLASS, "B"), ("B", ontology.SUBCLASS, "C"), ("p", ontology.TYPE, ontology.SYMMETRIC), ("x", "p", "y")], "s string, p string, o string")
    got = {(r["s"], r["p"], r["o"]): (r["rule"], r["round"]) for r in ontology.materialise_rl(t).where("rule IS NOT NULL").collect()}
    assert got[("x", ontology.TYPE, "B")] == ("cax-sco", 1) and got[("x", ontology.TYPE, "C")][0] == "cax-sco" and got[("y", "p", "x")] == ("prp-symp", 1) and len(got) == 4


def test_bad_texts_are_faults(spark):
    nodes = spark.createDataFrame([("a", "p", 1.0)], "id string, label string, v double")
    edges = spark.createDataFrame([], "src string, dst string, rel string")
    for text in ("MATCH (x", "MATCH (x) RETURN y", "RETURN", "MATCH (x) WHERE drop(x) RETURN x", "MATCH (x)-[:E]->(y) DELETE z"):
        with pytest.raises(cypher.CypherFault):
            cypher.run(text, nodes, edges)
    with pytest.raises(cypher.CypherFault):  # a node with relationships isn't deleted
        cypher.Graph(nodes, spark.createDataFrame([("a", "a", "E")], "src string, dst string, rel string")).write("MATCH (x) DELETE x")
    data = sparql.Dataset.of_triples(spark.createDataFrame([("<a>", "<p>", '"1"')], "s string, p string, o string"))
    for text in ("SELECT ?x WHERE { ?x", "SELECT ?x WHERE { ?x no:prefix ?y }", "FETCH ?x", "SELECT ?x WHERE { ?x <p> ?y FILTER(nope(?y)) }"):
        with pytest.raises(sparql.SparqlFault):
            data.query(text)
    for text in ("{ p { nope } }", "{ p(first: ", "mutation { x }", "{ p { ...none } }"):
        with pytest.raises(graphql.GraphqlFault):
            graphql.run(text, nodes, edges)


def test_exact_neighbours_over_several_blocks(spark):
    """Blocks are smaller than the table, lengths differ, and ties go to smaller ids."""
    import numpy as np

    from tessella.operators import retrieval

    rng = np.random.default_rng(4)
    v = rng.standard_normal((150, 6))
    v[60:90] = v[60]
    rows = [(i, [float(x) for x in v[i]]) for i in range(150)] + [(200, [1.0, 2.0]), (201, [2.0, 4.0]), (202, None), (203, [0.0] * 6)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>").where("vec_id < 202 AND embedding IS NOT NULL")
    blocks = retrieval.packed(t, "vec_id", "embedding", 32).cache()
    assert blocks.count() >= 6
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in retrieval.best_blocks(blocks, blocks.repartition(3), 4).collect():
        got.setdefault(r["query"], set()).add((-round(r["score"], 9), r["vec_id"]))
    for q in range(150):
        best = sorted((-round(float(unit[i] @ unit[q]), 9), i) for i in range(150))[:4]
        assert sorted(got[q])[:4] == best
    assert {i for _, i in got[200]} == {200, 201}


def test_points_on_a_line_cluster_as_by_their_pairs(spark):
    import random

    from tessella.operators import centrality as C

    rng = random.Random(5)
    xs = [round(rng.uniform(-60, 60), 1) for _ in range(90)] + [7.0] * 5 + [200.0, 201.0, 202.0, 203.5, 300.0, float("nan"), None]
    points = spark.createDataFrame(list(enumerate(xs)), "id long, x double")
    near = [(a, b) for a, x in enumerate(xs) for b, y in enumerate(xs) if a < b and x is not None and y is not None and abs(x - y) <= 1.5]
    for least in (2, 3, 5):
        expected = C.dbscan(spark.createDataFrame(near, "src long, dst long"), points.select("id"), least)
        assert sorted(map(tuple, C.dbscan_line(points, 1.5, least).collect())) == sorted(map(tuple, expected.collect()))


def test_entity_pairs_of_large_equal_groups_meet_in_chunks(spark):
    import random

    from tessella.operators import patterns

    rng = random.Random(2)
    rows = [(i, rng.choice("xy"), " ".join(rng.choice(["red", "blue", "Large", "small", "ring", "bolt"]) for _ in range(rng.randrange(0, 4)))) for i in range(120)] + [(200, None, "red"), (201, "x", None)]
    for threshold in (0.34, 0.5, 1.0):
        found = patterns.entity_pairs(spark.createDataFrame(rows, "id long, block string, text string"), threshold, chunk=3)
        # no join makes pairs of records: they come from chunks of ids
        assert "xs" in found._jdf.queryExecution().analyzed().toString()
        sets = {i: (b, set((t or "").lower().split())) for i, b, t in rows}
        expected = {}
        for i, (b, s) in sets.items():
            for j, (c, t) in sets.items():
                if i < j and b and b == c and s and t and len(s & t) / len(s | t) >= threshold:
                    expected[i, j] = len(s & t) / len(s | t)
        got = {(r["a"], r["b"]): r["score"] for r in found.collect()}
        assert got == expected and found.count() == len(expected)


def test_cypher_rings_meet_in_the_middle(spark):
    from tessella.plans import cypher

    rows = [("o", i, "p", p, "HAS") for i in range(8) for p in ((i * 3) % 5, (i * 7 + 1) % 5)] + [("o", i, "c", i % 3, "OF") for i in range(8)] + [("p", i, "p", (i + 1) % 5, "LIKE") for i in range(5)] + [("p", 0, "p", 2, "LIKE")]
    e = sorted({(f"{a}{i}", f"{b}{j}", rel) for a, i, b, j, rel in rows})
    edges = spark.createDataFrame(e, "src string, dst string, rel string").cache()
    nodes = spark.createDataFrame(sorted({(x, x[0], 1.0) for s, d, _ in e for x in (s, d)}), "id string, label string, value double").cache()
    has, of, like = ([(a, b) for a, b, r in e if r == k] for k in ("HAS", "OF", "LIKE"))
    found = cypher.run("MATCH (x:o)-[:HAS]->(p:p)<-[:HAS]-(y:o)-[:OF]->(c:c)<-[:OF]-(x) RETURN x.id AS x, p.id AS p, y.id AS y, c.id AS c", nodes, edges)
    assert sorted(map(tuple, found.collect())) == sorted((x, p, y, c) for x, p in has for y, q in has if p == q and x != y for z, c in of if z == x if (y, c) in of)
    # each arm goes through an order, which has few edges going out; no join makes the orders' pairs of a part
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("_start2") and plan.count("_at2")
    three = cypher.run("MATCH (a)-[:LIKE]->(b)-[r]-(c)<-[:LIKE]-(a) RETURN a.id AS a, b.id AS b, c.id AS c", nodes, edges)
    ways = {(a, b): (a, b) for a, b in like} | {(b, a): (a, b) for a, b in like}
    assert sorted(map(tuple, three.collect())) == sorted((a, b, c) for a, b in like for x, c in like if x == a and c != b and (b, c) in ways)


def test_components_taken_whole_agree_with_joins(spark, monkeypatch):
    import random

    from tessella.operators import centrality as C

    rng = random.Random(6)
    chain = [(i, i + 1) for i in range(100, 103)] + [(a, b) for a in range(103, 110) for b in range(103, a)]  # a long way and a dense end
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)] + chain + [(200, 201)], "src long, dst long").cache()
    near = {f: {r["id"]: tuple(r)[1:] for r in getattr(C, f)(e).collect()} for f in ("betweenness", "closeness", "greedy_colours")}
    assert all("Arrow" in getattr(C, f)(e)._jdf.queryExecution().analyzed().toString() for f in near)
    monkeypatch.setattr(C, "LOCAL_NODES", 9)  # the component of the way and the dense end goes by joins
    for f in near:
        got = {r["id"]: tuple(r)[1:] for r in getattr(C, f)(e).collect()}
        assert got.keys() == near[f].keys() and all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], near[f][k]))


def test_sliding_ranges_come_from_cells(spark):
    from tessella.operators import metrics

    rng = random.Random(8)
    rows = [(s, t, None if rng.random() < 0.1 else float(rng.randrange(50))) for s in "ab" for t in sorted(rng.sample(range(-40, 400), 90)) if not 100 < t < 160]
    samples = spark.createDataFrame(rows, "series string, t long, value double")
    found = metrics.over_time(samples, 20)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "RangeFrame, -20" not in plan and "_cell" in plan  # no frame of a sample's whole range
    got = {(r["series"], r["t"]): r for r in found.collect()}
    assert len(got) == len(rows)
    for s, t, v in rows:
        frame = [x for q, u, x in rows if q == s and t - 20 <= u <= t]
        some, r = [x for x in frame if x is not None], got[s, t]
        assert r["count"] == len(some) and r["min"] == min(some, default=None) and r["max"] == max(some, default=None)
        assert r["sum"] == (sum(some) if some else None) and (r["avg"] is None) == (not some)
        assert r["stddev"] is None if not some else abs(r["stddev"] - np.std(some)) < 1e-6
        assert r["delta"] == (None if v is None or frame[0] is None else v - frame[0])
    full = [(s, t, v) for s, t, v in rows if v is not None]
    rate = {(r["series"], r["t"]): r["rate"] for r in metrics.rate(spark.createDataFrame(full, "series string, t long, value double"), 20).collect()}
    for s, t, _ in full:
        frame = [(u, x) for q, u, x in full if q == s and t - 20 <= u <= t]
        grown = sum(y if y < x else y - x for (_, x), (_, y) in itertools.pairwise(frame))
        assert rate[s, t] is None if len(frame) == 1 else abs(rate[s, t] - grown / (t - frame[0][0])) < 1e-9


def test_filters_run_through_a_series_in_batches(spark):
    from tessella.operators import sequential

    rng = random.Random(9)
    rows = [(s, t, 10 * t + i, rng.random()) for i, s in enumerate(["a", "b", None]) for t in range(300)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        found = sequential.kalman_level(spark.createDataFrame(rows, "s string, t long, i long, v double"), "s", ["t"], "i", "v", 0.1, 1.0)
        # no task takes a whole series at once
        assert "FlatMapGroups" not in found._jdf.queryExecution().analyzed().toString()
        got = {r["id"]: r["level"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s in ("a", "b", None):
        level, p = None, 1.0
        for _, _, i, x in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            if level is None:
                level = x
            else:
                p += 0.1
                gain = p / (p + 1.0)
                level, p = level + gain * (x - level), (1 - gain) * p
            assert got.pop(i) == level
    assert not got


def test_partitions_grow_with_the_table(spark):
    from tessella.operators import finance, patterns

    assert graph.parts_of(spark.range(10)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert graph.parts_of(spark.range(101), 10) == 11
    items = spark.createDataFrame([(i % 7, i % 5) for i in range(35)], "basket long, item long").distinct()
    for df in (patterns.association(items, 2), finance.information_coefficient(items, "basket", "item", "item"), graph.similarity(items.toDF("src", "dst"))):
        assert "RepartitionByExpression" in df._jdf.queryExecution().analyzed().toString()


def test_similarity_by_lists_of_later_nodes(spark):
    rng = random.Random(10)
    e = {(rng.randrange(30), rng.randrange(12)) for _ in range(150)}
    out = {a: {y for x, y in e if x == a} for a, _ in e}
    for metric, cutoff in (("jaccard", 0.2), ("jaccard", 0.0), ("cosine", 0.5)):
        got = {(r["a"], r["b"]): r["score"] for r in graph.similarity(pairs(spark, [*e, *list(e)[:9]]), metric, cutoff).collect()}
        score = lambda x, y: len(x & y) / (len(x | y) if metric == "jaccard" else (len(x) * len(y)) ** 0.5)  # noqa: B023, E731
        expected = {(a, b): score(out[a], out[b]) for a in out for b in out if a < b and out[a] & out[b] and score(out[a], out[b]) > cutoff}
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
