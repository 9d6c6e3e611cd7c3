"""The tables of a data folder, and the property graph that they form."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL whose table names stand for the folder's tables; views are private to this call."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        session.conf.set(key, spark.conf.get(key))
    for name in TABLES:
        if name in text:
            table(session, sf_dir, name).createOrReplaceTempView(name)
    return session.sql(text)


def scratch(spark: SparkSession) -> str:
    """A new folder name that all machines share, below spark.checkpoint.dir; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="tessella-")
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"


#: (relation, source label, source key, target label, target key, table, distinct)
_EDGES = (
    ("PLACED_BY", "order", "o_orderkey", "customer", "o_custkey", "orders", False),
    ("CONTAINS", "order", "l_orderkey", "part", "l_partkey", "lineitem", True),
    ("SUPPLIED_BY", "part", "l_partkey", "supplier", "l_suppkey", "lineitem", True),
    ("LOCATED_IN", "customer", "c_custkey", "nation", "c_nationkey", "customer", False),
    ("LOCATED_IN", "supplier", "s_suppkey", "nation", "s_nationkey", "supplier", False),
    ("PART_OF", "nation", "n_nationkey", "region", "n_regionkey", "nation", False),
)
_NODES = (("customer", "c_custkey", "c_acctbal"), ("supplier", "s_suppkey", "s_acctbal"), ("part", "p_partkey", "p_retailprice"), ("orders", "o_orderkey", "o_totalprice"), ("nation", "n_nationkey", None), ("region", "r_regionkey", None))


def node_id(label: str, key: str):
    return F.concat(F.lit(f"{label}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, value) of every vertex."""
    found = None
    for name, key, value in _NODES:
        label = "order" if name == "orders" else name
        some = table(spark, sf_dir, name).select(node_id(label, key).alias("id"), F.lit(label).alias("label"), (F.col(value) if value else F.lit(None)).cast("double").alias("value"))
        found = some if found is None else found.unionByName(some)
    return found


def edges(spark: SparkSession, sf_dir: str, *relations: str) -> DataFrame:
    """(src, dst, rel) of the given relations, of all without any."""
    found = None
    for rel, a, ka, b, kb, name, distinct in _EDGES:
        if relations and rel not in relations:
            continue
        some = table(spark, sf_dir, name).select(node_id(a, ka).alias("src"), node_id(b, kb).alias("dst"), F.lit(rel).alias("rel"))
        some = some.distinct() if distinct else some
        found = some if found is None else found.unionByName(some)
    return found
