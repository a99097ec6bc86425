"""Inputs of the registered queries, derived from the driver's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import RingConfig
from tessera.functions.text import encode_document
from tessera.operators import rag, ring

#: 2024-01-31 00:00 UTC.
AS_OF = 1_706_659_200_000
FOUR_NODES = RingConfig(nodes=(*RingConfig().nodes, ("node-4", "localhost", 6382)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder's path in the folder that executors share; only a local session may leave that unset."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='tessera-')).rstrip('/')}/index-{uuid.uuid4().hex}"


def event_ms():
    """Epoch milliseconds of the zoneless ``ts``, read as UTC whatever the session's zone."""
    return F.expr("unix_millis(cast(convert_timezone('UTC', current_timezone(), ts) as timestamp))")


def kv_log(spark: SparkSession, sf_dir: str, clears: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "events")
    clear = (F.col("event_id") % 5000 == 2499) if clears else F.lit(False)
    return e.select(
        F.col("event_id").alias("seq"),
        F.when(clear, "CLEAR").when(F.col("event_type") == "error", "DELETE").otherwise("SET").alias("op"),
        F.when(~clear, F.concat(F.lit("user:"), F.col("user_id").cast("string"))).alias("key"),
        F.when(~clear, F.col("props")).alias("value"),
        F.when(F.col("event_type") == "view", F.lit(86_400_000)).cast("long").alias("ttl_ms"),
        event_ms().alias("ts_ms"),
    )


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(spark, sf_dir).select("key").distinct()


def three_nodes(spark: SparkSession, unhealthy: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    n = ring.nodes(spark, RingConfig(), unhealthy)
    return n, ring.vnodes(n)


def replicas(spark: SparkSession) -> DataFrame:
    rows = [("node-1", True, True, 0, 0, 0), ("node-2", True, False, 5, 7, 1), ("node-3", True, False, 3, 7, 2), ("node-4", False, False, 9, 12, 3)]
    return spark.createDataFrame(rows, "node_id string, is_healthy boolean, is_master boolean, replication_lag long, synced_ops long, insert_ord int")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.to_json(F.struct("label"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("values"), meta.alias("metadata"))


def vec_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20."""
    return vectors(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("query_id"), "values")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(vectors(spark, sf_dir).where(F.col("id") == vec_id).first()["values"])


def mem_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("event_id") % 4).cast("int").alias("segment_ord"), F.floor(F.col("event_id") / 4).alias("entry_ord"), F.col("user_id").cast("string").alias("id"),
        F.array(F.col("value")).alias("vector"), F.col("props").alias("metadata"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("tombstone"),
    )


def node_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), (F.col("event_type") != "error").alias("ok"), event_ms().alias("ts_ms"), F.col("value").alias("response_ms"))
    _, r = three_nodes(spark)
    return ring.place(e, r, 450).select("seq", "node_id", "ok", "ts_ms", "response_ms")


def rag_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value per chunk of each document, with the vector of the document's number."""
    chunks = rag.chunk(table(spark, sf_dir, "documents").select("doc_id", "text"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), "embedding")
    got = chunks.join(e, F.col("doc_id") % 500 == F.col("vec_id"))
    key = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"), F.lit(":chunk:"), F.col("chunk").cast("string"))
    return got.select(key.alias("key"), encode_document(F.col("text"), F.col("embedding"), F.to_json(F.struct("doc_id"))).alias("value"))
