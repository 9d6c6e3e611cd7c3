"""The queries opN_<name> of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import detect

    return detect(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hilbert import shard

    return shard(table(spark, sf_dir, "documents"))


def op5_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .hosts import judge, split_url

    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    # the last number of a page's path is the document that it shows; slashes may follow
    shown = pages.select("page_id", F.regexp_extract(split_url(F.col("url"))[1], r"/([0-9]{1,18})[^/0-9]*/*\z", 1).try_cast("long").alias("doc_id")).distinct()
    outcomes = shown.join(labels, "doc_id").select("page_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge(pages, outcomes)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .common import words_in
    from .mixing import mix

    docs = table(spark, sf_dir, "documents")
    return mix(docs.select("doc_id", "source", words_in(docs.text).alias("words")), size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


def op9_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_column

    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_column(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=False)


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nndescent import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_pii_deobfuscation, op2_quality_rules, op3_license_scan, op4_hilbert_shards, op5_warc_chunks, op6_host_reputation, op7_jaccard_join, op8_source_mixing, op9_byte_bpe, op10_nn_descent)}
ORACLE_SQL: dict[str, str] = {}
