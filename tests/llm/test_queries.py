"""The registered queries over small tables with nulls, repeated ids and rows, clashing columns, and over empty tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402
from tiktoken.load import load_tiktoken_bpe  # noqa: E402

from tessella.llm.queries import QUERIES  # noqa: E402

TEXTS = [
    "write to jo.doe@mail.example.com or +44 207 183 8750 today, from 10.0.0.1 and 4111 1111 1111 1111 as ever",
    "nothing to see in these plain words of ours that go on for a while, line by line\nand more\nand more\n",
    None, "", " \n ", "x", "größe 日本 € 'tis it's 12345 tokens", "a b c d e " * 12, "same words here " * 9,
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, ["en", "de", None][i % 3], [None, "web", "books"][i % 3], 1) for i, t in enumerate(TEXTS * 3)] + [(0, TEXTS[0], "en", None, 1), (None, "no id at all for this row of ten words or so", "en", "web", 1), (None, None, None, None, None), (7, "another text under an id that has one already, ten words", "fr", "web", 2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'clash' AS node", "1 AS g", "2.5D AS size", "'u' AS uri", "0 AS shard").write.parquet(f"{at}/documents.parquet")
    pages = [(i, f"http://h{i % 3}.example.org:80/en/{i}", ["<p>a</p>", None, "<p>a</p>", "b\r\n\r\nWARC/1.1", "z" * 40][i % 5]) for i in range(20)] + [(3, "http://h0.example.org/en/3", "<p>a</p>"), (None, None, "<p>a</p>"), (None, "x://y", "only here"), (1, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "'c' AS host", "'d' AS id").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 12)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, docs, pages


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "pages", "labels"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<double>").write.parquet(f"{at}/embeddings.parquet")
    return at


def query(spark, at, n):
    name = next(k for k in QUERIES if k.startswith(f"op{n}_"))
    return QUERIES[name](spark, at)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("n", range(1, 11))
def test_empty_tables_give_nothing(spark, empty, n):
    assert query(spark, empty, n).count() == 0


def test_personal_data(spark, folder):
    got = query(spark, folder[0], 1).collect()
    assert len(got) == len(folder[1])
    row = next(r for r in got if r["doc_id"] == 0)
    t = TEXTS[0]
    base = [f"{k}:{t.index(s)}:{t.index(s) + len(s)}" for k, s in (("email", "jo.doe@mail.example.com"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+44 207 183 8750"))]
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1)
    assert row["spans"] == ",".join(base) and row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert Counter(r["spans"] for r in got)[row["spans"]] == 4


def test_quality(spark, folder):
    got = Counter((r["doc_id"], r["n_words"], r["base_failed"], r["kept"] and r["base_failed"]) for r in query(spark, folder[0], 2).collect())
    assert Counter((i, len(words(t))) for i, t, *_ in folder[1]) == Counter({k[:2]: 0 for k in got}) + Counter([k[:2] for k, n in got.items() for _ in range(n)])
    assert all(failed or n >= 10 for _, n, failed, _ in got) and not any(both for *_, both in got)


def test_shards(spark, folder):
    got = query(spark, folder[0], 4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in folder[1])
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted({(r["shard"], r["slot"]) for r in got})


def test_archives(spark, folder):
    got = query(spark, folder[0], 5).collect()
    least = {}
    for i, _, html in folder[2]:
        if i is not None:
            least[html or ""] = min(i, least.get(html or "", i))
    wanted = Counter()
    for i, _, html in folder[2]:
        data, first = (html or "").encode(), least.get(html or "")
        revisit = first is not None and first != i
        wanted[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None)] += 1
    assert Counter(tuple(r[:5]) for r in got) == wanted


def test_hosts(spark, folder):
    got = query(spark, folder[0], 6).collect()
    assert Counter(r["page_id"] for r in got) == Counter(p[0] for p in folder[2])
    assert all(r["host"] == "" for r in got if r["page_id"] == 1 and r["path"] == "")


def test_links(spark, folder):
    got = query(spark, folder[0], 7).collect()
    sets = Counter((i, len({tuple(words(t.lower())[k : k + 5]) for k in range(max(1, len(words(t)) - 4))}) if words(t) else 0) for i, t, *_ in folder[1])
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == sets
    assert {r["component_id"] for r in got if r["doc_id"] in (7, 16, 25) and r["n_shingles"] == 5} == {7}


def test_mix(spark, folder):
    got = query(spark, folder[0], 8).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(words(t))) for i, t, *_ in folder[1])
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_tokens(spark, folder):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    wanted = Counter()
    for i, t, *_ in folder[1]:
        ids = library.encode_ordinary(t or "")
        wanted[(i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r[:4]) for r in query(spark, folder[0], 9).collect()) == wanted


def test_pipeline_keeps_rows_without_id(spark, folder):
    import corpus_pipeline
    from tessella.llm.common import materialise

    long = [(None, f"words of a text without an id, number {k}, all its own and quite distinct {k * 7} from {k * 13} others {k}", "en", "web", 1) for k in range(3)]
    long += [(5, "one text under the id five that says this and that of one thing", "en", "web", 1)] * 2 + [(5, "a wholly other text under that same id of five with other words in it", "en", "web", 1)]
    docs = spark.createDataFrame(long, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = materialise(stage(spark, docs, folder[0]))
    assert Counter(tuple(r) for r in docs.collect()) == Counter(set(long))
