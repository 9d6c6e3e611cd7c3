"""Operators on whole tables, against brute force on small tables with nulls, ties and repeats."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from tessella.llm import hilbert, hosts, jaccard, mixing, nndescent, warc  # noqa: E402
from tessella.llm.components import components  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_sets(rows):
    sets = []
    for _, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    return sets


def plain_components(rows, percent=75):
    sets = plain_sets(rows)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return {i: (len(s), least[root(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))}


def near_copies():
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") * rng.randrange(1, 4) + str(rng.randrange(60)) for _ in range(rng.choice([3, 8, 20, 60, 150]))] for _ in range(12)]
    rows = []
    for i in range(260):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            k = rng.randrange(len(words))
            words[k : k + rng.randrange(2)] = [rng.choice("ABCxyz") + str(rng.randrange(99))]
        rows.append((i, " ".join(words)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, rows[0][1] + " "), (904, rows[0][1].upper())]


@pytest.mark.parametrize("block", [1024, 16])
def test_jaccard_join_finds_every_component(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SMALL", 4)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(docs).collect()}
    assert got == plain_components(rows)


def test_trees_give_links_and_all_links(spark, monkeypatch):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # spanning links come from the nearest-neighbour search of the trees, true ones only
    sets = plain_sets(rows)
    found = jaccard._Nodes(docs, 75, 5)
    rep = {r["node"]: r["rep"] for r in found.reps.collect()}
    at = {i: s for (i, _), s in zip(rows, sets)}
    links = [(at[rep[r["a"]]], at[rep[r["b"]]]) for r in jaccard.nearest_links(found, found.trees()).collect()]
    assert len(links) > 20 and all(100 * len(a & b) >= 75 * len(a | b) for a, b in links)
    # every link of different sets, named by their least ids
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    pairs, membership = jaccard.jaccard_links(docs)
    least = {}
    for (i, _), s in zip(rows, sets):
        least.setdefault(frozenset(s), i)
    wanted = {tuple(sorted((least[a], least[b]))) for a, b in itertools.combinations(least, 2) if a and b and 100 * len(a & b) >= 75 * len(a | b)}
    got = [(r["a"], r["b"]) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    assert {r["doc_id"]: r["rep"] for r in membership.collect()} == {i: least[frozenset(s)] if s else None for (i, _), s in zip(rows, sets)}


@pytest.mark.parametrize("first", [16, 1])
def test_a_pair_comes_from_one_of_its_trees(spark, monkeypatch, first):
    monkeypatch.setattr(jaccard, "FIRST", first, raising=False)
    rng, rows = random.Random(8), []
    for i in range(60):
        words = [f"w{k}" for k in range(120)]
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    given, search = [], jaccard._candidates

    def counted(*args):
        found = search(*args).select("a", "b").collect()
        given.extend((r["a"], r["b"]) for r in found)
        return search(*args)

    monkeypatch.setattr(jaccard, "_candidates", counted)
    links, _ = jaccard.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = plain_sets(rows)
    wanted = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if 100 * len(a & b) >= 75 * len(a | b)}
    assert {(r["a"], r["b"]) for r in links.collect()} == wanted
    assert len(wanted) > 1000
    if first == 16:  # each of a pair's many trees gave it before
        assert len(given) <= 1.05 * len(set(given))


def test_jaccard_join_of_nothing(spark):
    for rows in ([], [(1, None), (2, "")]):
        got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(i, 0, i) for i, _ in rows]


def test_bound_never_undercuts_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        va, vb = jaccard.counts_of(jaccard.count_vector(a)), jaccard.counts_of(jaccard.count_vector(b))
        groups = min(len(va), len(vb))
        assert np.minimum(jaccard.folded(va, groups), jaccard.folded(vb, groups)).sum() >= len(np.intersect1d(a, b))


def test_tree_search_equals_scan():
    rng = np.random.default_rng(2)
    points, sizes, comps = rng.integers(0, 4, (300, 16)).astype(np.int16), rng.integers(20, 40, 300), rng.integers(0, 9, 300)
    tree = jaccard.RTree(points, sizes, comps)
    for k in range(0, 300, 7):
        bound = np.minimum(points, points[k]).sum(1)
        wanted = np.flatnonzero((bound >= jaccard.overlap_needed(sizes[k], sizes, 75)) & (comps != comps[k]))
        assert sorted(tree.search(points[k], sizes[k], comps[k], 75)) == wanted.tolist()


        excess = np.where(comps != comps[k], bound - jaccard.overlap_needed(sizes[k], sizes, 75), -1)
        best, where = tree.nearest(points[k], sizes[k], comps[k], 75)
        assert best == max(excess.max(), -1) and (best < 0 or excess[where] == best)
    ranks = rng.permutation(300)
    tree = jaccard.RTree(points, sizes, ranks, together=False)
    for k in range(0, 300, 7):
        excess = np.where(ranks < ranks[k], np.minimum(points, points[k]).sum(1) - jaccard.overlap_needed(sizes[k], sizes, 75), -1)
        best, where = tree.nearest(points[k], sizes[k], ranks[k], 75, lower=True)
        assert best == max(excess.max(), -1) and (best < 0 or excess[where] == best)


def test_shards_prune_filters_on_every_dimension(spark):
    rng = random.Random(8)
    rows = [(i, "x" * int(rng.paretovariate(0.7) * 20 % 5000), rng.choice(["de", "en", "fr", None]), f"s{rng.randrange(8)}", 0) for i in range(4000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("curve", F.lit(1))
    got = hilbert.shard(docs).join(docs.select("doc_id", "lang", "source"), "doc_id").collect()
    for name, wanted in (("doc_id", lambda v: v < 200), ("size", lambda v: v > 3000), ("source", lambda v: v == "s3"), ("lang", lambda v: v == "de")):
        spans = {}
        for r in got:
            if r[name] is not None:
                low, high = spans.get(r["shard"], (r[name], r[name]))
                spans[r["shard"]] = (min(low, r[name]), max(high, r[name]))
        # a shard is read if a value within its range may be wanted
        values = sorted({r[name] for r in got if r[name] is not None})
        read = sum(any(low <= v <= high and wanted(v) for v in values) for low, high in spans.values())
        assert read <= 16, (name, read)


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91), (5, 5)], "a long, b long")
    found = {r["node"]: r["comp"] for r in components(e).collect()}
    assert set(found.values()) == {0, 90} and len(found) == 43


def test_hilbert_curve_visits_every_point_by_single_steps(spark):
    for bits, dims in ((3, 2), (2, 3), (2, 4)):
        n = 1 << bits
        points = spark.createDataFrame(list(itertools.product(range(n), repeat=dims)), [f"a{i}" for i in range(dims)])
        rows = sorted((r[-1], r[:-1]) for r in points.withColumn("h", hilbert.hilbert_index([F.col(f"a{i}") for i in range(dims)], bits)).collect())
        assert [r[0] for r in rows] == list(range(n**dims))
        assert all(sum(abs(x - y) for x, y in zip(a[1], b[1])) == 1 for a, b in zip(rows, rows[1:]))


def test_shards_are_even_runs_of_the_curve(spark):
    rows = [(i, None if i % 9 == 0 else "é" * (i * i % 300), None if i % 5 == 0 else "en", f"s{i % 3}", 0) for i in range(101)] + [(7, "same", "en", "s", 4)] * 30
    got = hilbert.shard(spark.createDataFrame(rows, DOCS)).collect()
    text = {i: t for i, t, *_ in rows[:101]} | {7: "same"}
    counts = Counter(r["shard"] for r in got)
    assert len(got) == 131 and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(24))
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    ordered = [r["curve"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert ordered == sorted(ordered)
    for r in got:
        if r["doc_id"] != 7:
            data = (text[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
    assert hilbert.shard(spark.createDataFrame([], DOCS)).count() == 0
    assert [r["shard"] for r in hilbert.shard(spark.createDataFrame(rows[:1], DOCS)).collect()] == [0]


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_warc_round_trip(spark, chunk):
    html = ["a\nb", "a\nb", None, "", "x\r\n\r\nWARC/1.1\r\nq", "no newline" * 30, "\n", "\n\n\n", "tail\r", "é\n" * 100, "\r\n\r", "a\nb", "日本" * 9]
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string").repartition(3)
    path = warc.shared_dir(spark)
    warc.write(warc.classified(pages, "page_id", "html"), path, chunk)
    got, last = defaultdict(bytes), {}
    for r in warc.read_chunks(spark, path).orderBy("id", "chunk").collect():
        got[r["id"]] += r["data"]
        last[r["id"]] = r
        assert r["bytes"] <= chunk and r["size_so_far"] == len(got[r["id"]])
        assert r["digest_so_far"] == base64.b32encode(hashlib.sha1(got[r["id"]]).digest()).decode()
    for i, x in enumerate(html):
        data = (x or "").encode()
        first = min(j for j, y in enumerate(html) if (y or "") == (x or ""))
        assert got[i] == (data if first == i else b"") and last[i]["last"]
        assert (last[i]["record_type"], last[i]["refers_to"]) == (("response", None) if first == i else ("revisit", first))
        assert (last[i]["stated_size"], last[i]["stated_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_hosts_and_rules(spark):
    urls = ["http://A.NET", "http://a.net/", "https://x.example.net/en/1?q", "http://example.com/de/z", "ftp://org/fr/", "http://w.org/fr", "nothing", None, "http://u@h.com:80/a/b?x#y", "http://net/?a", "http://Ü.NET/", "x://?q", "http://a.net/x\ny?z", "://h/p", "a://b://c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([(0, True), (1, None)], "page_id long, bad boolean")
    for r in hosts.judge(pages, outcomes).collect():
        url = urls[r["page_id"]]
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        assert (r["host"], r["path"]) == (host, path)
        fits = [(x, v) for x, v in hosts.RULES if (host == (h := x[: x.index("/")]) or host.endswith("." + h)) and path.startswith(x[x.index("/") :])]
        rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, None)
        assert r["rule"] == rule and (verdict is None or r["verdict"] == verdict)
    assert hosts.judge(pages.limit(0), outcomes).count() == 0
    assert {r["verdict"] for r in hosts.judge(pages, outcomes.limit(0)).where("rule IS NULL").collect()} == {"allow"}


def test_host_query_joins_every_labelled_page(spark, tmp_path):
    from tessella.llm.queries import op6_host_reputation

    ends = ["", "/", "//", ".html", "?page=2", "/?page=7/8", "#top", "/#a/9", ".html?x=http://y/3/"]
    rows = [(i, f"http://h{i % 4}.example.com/en/{i % 90}{ends[i % len(ends)]}") for i in range(180)] + [(500, None), (501, "no url"), (502, "http://h1.example.com/en/"), (503, "http://h1.example.com?x=/7/")]
    labels = [(d, int(d % 3 > 0), int(d % 5 == 0)) for d in range(0, 90, 2)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    bad = {d: q == 0 or t == 1 for d, q, t in labels}
    outcomes = [(i, bad[i % 90]) for i, _ in rows if i < 180 and i % 90 in bad]
    want = hosts.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad boolean"))
    plain = lambda df: sorted((r["page_id"], r["verdict"], None if r["bound"] is None else round(r["bound"], 9)) for r in df.collect())
    assert plain(op6_host_reputation(spark, str(tmp_path))) == plain(want)


def test_reputation_shrinks_towards_the_domain(spark):
    rows = [("a.bad.com", True)] * 40 + [("b.bad.com", True)] * 40 + [("c.good.com", False)] * 80 + [("d.bad.com", False)]
    got = {r["name"]: r["bound"] for r in hosts.reputation(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert got["a.bad.com"] > got["bad.com"] > got["com"] > got["good.com"]
    # one good outcome leaves a host of a bad domain in doubt, not cleared or blocked
    assert got["d.bad.com"] < 0.5


def test_beta_quantile_and_domains(spark):
    def density_sum(a, b, x, n=200_000):
        t = (np.arange(n) + 0.5) / n
        # substituting t = u ** k tames the poles at the ends
        f = np.exp((a - 1) * np.log(t) + (b - 1) * np.log1p(-t))
        return f[t <= x].sum() / f.sum()

    pairs = [(1.0, 1.0), (2.0, 5.0), (3.5, 1.2), (40.0, 160.0), (500.0, 20.0), (1.3, 900.0)]
    df = spark.createDataFrame(pairs, "a double, b double").withColumn("q", hosts.beta_quantile(F.col("a"), F.col("b"), 0.05)).withColumn("p", hosts.beta_probability(F.lit(0.3), F.col("a"), F.col("b")))
    for r in df.collect():
        assert density_sum(r["a"], r["b"], r["q"]) == pytest.approx(0.05, abs=0.002)
        assert r["p"] == pytest.approx(density_sum(r["a"], r["b"], 0.3), abs=0.002)
    names = {"a.b.co.uk": ("b.co.uk", "co.uk"), "x.y.example.com:8080": ("example.com", "com"), "me@h.org.": ("h.org", "org"), "10.0.0.1:80": ("10.0.0.1", "ip"), "": ("", ""), "local": ("local", "local")}
    for r in spark.createDataFrame([(n,) for n in names], "h string").select("h", hosts.domain_of(F.col("h")).alias("d"), hosts.suffix_of(F.col("h")).alias("s")).collect():
        assert (r["d"], r["s"]) == names[r["h"]]


def test_repeated_pages_count_once(spark):
    pages = spark.createDataFrame([(1, "http://a.x.com/1")] * 3 + [(2, "http://b.x.com/2"), (3, "http://b.x.com/3")], "page_id long, url string")
    outcomes = spark.createDataFrame([(1, True), (2, False), (3, False)], "page_id long, bad boolean")
    bound = {r["host"]: r["bound"] for r in hosts.judge(pages, outcomes).collect()}
    again = {r["host"]: r["bound"] for r in hosts.judge(pages.distinct(), outcomes).collect()}
    assert bound == again


def test_flow_is_of_least_cost():
    rng = random.Random(3)
    for _ in range(60):
        capacity = [rng.randrange(1, 4) for _ in range(3)]
        members = [sorted(rng.sample(range(2), rng.randrange(1, 3))) for _ in capacity]
        quota = [rng.randrange(0, 5) for _ in range(2)]
        flow = mixing.route(capacity, members, quota, 2)
        cost = lambda used: sum(max(0, u - c) + u for u, c in zip(used, capacity))  # noqa: B023, E731  a second pass costs 2
        best = (0, 0)
        # every way to draw on the patterns: words of each (pattern, source)
        ways = [(p, s) for p, m in enumerate(members) for s in m]
        for amounts in itertools.product(*[range(min(2 * capacity[p], quota[s]) + 1) for p, s in ways]):
            used, got = [0] * 3, [0] * 2
            for (p, s), x in zip(ways, amounts):
                used[p] += x
                got[s] += x
            if all(u <= 2 * c for u, c in zip(used, capacity)) and all(g <= q for g, q in zip(got, quota)):
                best = min(best, (-sum(got), cost(used)))
        mine = [sum(f.values()) for f in flow]
        assert (-sum(mine), cost(mine)) == best


def test_targets_and_flow():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 1.5, 2) == [200, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([0, 10], [3, 1], 1.5, 2) == [0, 15]
    flow = mixing.route([100, 50, 10], [[0, 1], [1], [0]], [110, 90])
    assert sum(f.get(0, 0) for f in flow) == 110 and sum(f.get(1, 0) for f in flow) == 90
    # an overlapping pattern gives way before anything repeats
    first = mixing.route([100, 50], [[0, 1], [0]], [100, 50])
    assert first[0] == {0: 50, 1: 50} and first[1] == {0: 50}


def test_mix_meets_targets_and_repeats_itself(spark):
    rng = random.Random(8)
    rows = [(i, None if i == 5 else "w " * rng.randrange(0, 60), None if i % 7 == 0 else f"s{i % 4}") for i in range(800)] + [(3, "w w w", "s3")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("g", F.lit(1))
    got = [tuple(r) for r in mixing.mix(docs).select("doc_id", "size", "source", "source_size", "target", "taken").collect()]
    assert Counter(got) == Counter(tuple(r) for r in mixing.mix(docs.repartition(5)).select("doc_id", "size", "source", "source_size", "target", "taken").collect())
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    aims = dict(zip(names, mixing.targets([sizes[s] for s in names], [3, 1, 2, 3, 1], 1.5, 2)))
    for s in names:
        mine = [g for g in got if g[2] == s]
        assert all(g[3] == sizes[s] and g[4] == pytest.approx(aims[s]) and g[5] <= 2 * g[1] for g in mine)
        assert abs(sum(g[5] for g in mine) - aims[s]) <= 30
    assert mixing.mix(docs.limit(0)).count() == 0


def test_nearest_neighbours_reach_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((10, 16))
    v = np.round(centres[rng.integers(0, 10, 600)] + 0.6 * rng.standard_normal((600, 16)), 4)
    v[100:140] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(600)] + [(700, None), (750, [0.0] * 16), (800, [float("nan")] * 16), (850, [None] * 16), (900, [1.0])]
    got = defaultdict(list)
    found = nndescent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, every=50).orderBy("query_id", "rank").collect()
    for r in found:
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    assert sorted(got) == list(range(0, 600, 50))
    for q, mine in got.items():
        scores = unit @ unit[q]
        best = [int(i) for i in np.lexsort((np.arange(600), -np.round(scores, 12))) if i != q][:5]
        hits += len(set(best) & {i for i, _ in mine})
        assert all(abs(scores[i] - s) < 1e-9 for i, s in mine) and len(mine) == 5
    assert hits >= 0.9 * 5 * len(got)
    few = nndescent.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"), k=5, every=50).collect()
    assert [r["vec_id"] for r in few if r["query_id"] == 0].__len__() == 2


def test_near_copies_are_told_apart_by_graph_and_by_comparison(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((3, 16))[rng.integers(0, 3, 900)] + 1e-5 * rng.standard_normal((900, 16))  # cosines differ by some 1e-10
    table = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(900)], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for exact, least in ((0, 0.9), (1e12, 1.0)):
        found = defaultdict(list)
        for r in nndescent.nearest(table, k=5, every=50, exact=exact).orderBy("query_id", "rank").collect():
            found[r["query_id"]].append(r["vec_id"])
        best = {q: [int(i) for i in np.argsort(-(unit @ unit[q])) if i != q][:5] for q in range(0, 900, 50)}
        assert sum(len(set(best[q]) & set(found[q])) for q in best) >= least * 5 * len(best)
