"""Incremental replay of a log stream into a state table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.state import latest
from tessera.sources.log import KV_LOG

CHANGES = "seq BIGINT, op STRING, key STRING, value STRING, ttl_ms BIGINT, ts_ms BIGINT"


def merged(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The last row of each key, deletes included, of a state and a batch of ``KV_LOG`` rows.

    The last CLEAR stays as a row without a key; what comes before it is gone.
    """
    rows = state.select("seq", "op", "key", "value", "ttl_ms", "ts_ms").union(batch.select("seq", "op", "key", "value", "ttl_ms", "ts_ms"))
    barrier = F.coalesce(rows.where("op = 'CLEAR'").agg(F.max("seq")).scalar(), F.lit(-(1 << 62)))
    return latest(rows.where((F.col("seq") > barrier) | ((F.col("seq") == barrier) & (F.col("op") == "CLEAR"))))


def start(log: DataFrame, path: str, checkpoint: str):
    """Merge each micro-batch of a stream of ``KV_LOG`` rows into versions of a state table below ``path``.

    A batch reads the newest version before its own number and writes ``v=<batch>`` anew, so a batch that runs again
    after a failure gives the same version. Versions older than the last two are removed.
    """
    spark = log.sparkSession
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def merge(batch: DataFrame, n: int) -> None:
        old = [v for v in versions(spark, path) if v < n]
        state = spark.read.schema(CHANGES).parquet(f"{path}/v={old[-1]}") if old else spark.createDataFrame([], CHANGES)
        merged(state, batch).write.mode("overwrite").parquet(f"{path}/v={n}")
        for v in old[:-1]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}"), True)

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were written to their end."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def state_log(spark: SparkSession, path: str) -> DataFrame:
    """The newest version as ``KV_LOG`` rows; ``operators.state.replay`` gives the state from them."""
    got = versions(spark, path)
    return spark.read.schema(CHANGES).parquet(f"{path}/v={got[-1]}") if got else spark.createDataFrame([], KV_LOG)
