"""A training corpus from raw documents: clean, deduplicate, redact, mix, tokenise.

Each stage takes what its predecessor kept, as a Parquet table with the columns
of documents, and its decisions take effect. Tables may be empty, columns null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.bpe import encode_column
from tessella.llm.common import WORD, discard, group_key, materialise
from tessella.llm.jaccard import jaccard_join
from tessella.llm.mixing import mix
from tessella.llm.pii import redact
from tessella.llm.quality import quality_rules

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the outlier test keep; each row is judged by its own text and group, its id may be null or repeat."""
    kept = quality_rules(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "stratum").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), F.xxhash64(group_key(F.col("lang"), F.col("source"))).alias("g"))
    same = keyed["doc_id"].eqNullSafe(kept["_id"]) & (keyed["text_hash"] == kept["_hash"]) & (keyed["g"] == kept["stratum"])
    return keyed.join(kept, same, "left_semi").select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the row with the smallest id (null first), then text hash, then row; rows without words stay."""
    joined = jaccard_join(docs).where("class_id IS NOT NULL")
    first = joined.groupBy("class_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("_first")).select("_first.*")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("_words"))
    same = keyed["_id"].eqNullSafe(first["doc_id"]) & (keyed["_hash"] == first["text_hash"])
    linked = keyed.where("_words").join(first, same, "left_semi").groupBy("_id", "_hash").agg(F.min("row").alias("row"))
    return linked.select("row.*").unionByName(keyed.where("NOT _words").select("row.*"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, disguised or not, replaced by its kind."""
    return redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    taken = mix(docs).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests by which a reader can verify them."""
    return encode_column(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", deduplicate), ("personal data", private), ("source mixing", mixed), ("byte-level BPE", tokens)]

#: The outlier test, seeded choice and tokenizer are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        discard(before)
    return docs
