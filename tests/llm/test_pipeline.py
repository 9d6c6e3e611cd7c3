"""The pipeline's stages keep the columns of documents and their decisions take effect."""

import numpy as np
import psutil
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tessella.llm.common import materialise, released  # noqa: E402
from tessella.llm.pii import all_spans, redact  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF))
        seen[name] = docs
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    names = list(seen)
    for name in names[:-1]:
        assert seen[name].columns == raw.columns
    ids = {name: [r[0] for r in seen[name].select("doc_id").collect()] for name in names}
    assert len(set(ids[names[1]])) == len(ids[names[1]]) <= len(ids[names[0]]) < raw.count()
    assert sorted(ids[names[2]]) == sorted(ids[names[1]])
    assert set(ids[names[3]]) <= set(ids[names[2]]) and sorted(ids[names[4]]) == sorted(ids[names[3]])
    assert max(ids[names[3]].count(i) for i in set(ids[names[3]])) <= 2
    assert not any(any(all_spans(r["text"])[1].values()) for r in seen[names[2]].collect())


def test_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF))
    assert docs.count() == 0


def test_workers_give_memory_back():
    def work():
        held = [np.ones(8_000) for _ in range(3_000)]  # 192 MB in pieces that the allocator keeps
        pin.append(np.ones(8_000))
        yield len(held)

    pin = []
    before = psutil.Process().memory_info().rss
    assert list(released(work())) == [3_000]
    assert psutil.Process().memory_info().rss - before < 60e6


def test_redaction_across_slices(spark):
    rows = [(i, f"mail a{i}@b.example or nothing" if i % 3 else None) for i in range(1_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["text"] for r in redact(docs).collect()}
    assert got == {i: t and "mail <EMAIL> or nothing" for i, t in rows}
