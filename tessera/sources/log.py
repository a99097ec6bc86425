"""Append-only logs and the folder layout of a collection."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KV_LOG = "seq BIGINT, op STRING, key STRING, value STRING, ttl_ms BIGINT, ts_ms BIGINT"
#: As written by a store: relative time to live and time, without a sequence number.
KV_LINES = "op STRING, key STRING, value STRING, ttl BIGINT, ts BIGINT"
VECTOR_LOG = "seq BIGINT, type STRING, id STRING, vector ARRAY<DOUBLE>, metadata STRING, timestamp BIGINT"


def read_kv_lines(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines log as ``KV_LOG``; rows are numbered from 1 by file name, then by place, with gaps between splits.

    Spark deals splits to tasks by size, so a row's number comes from its split's rank and its place within the task,
    which within a split follows the file. Only the splits' names come to the driver.
    """
    rows = spark.read.schema(KV_LINES).json(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = rows.withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    splits = sorted((r["file"], r["start"]) for r in rows.select("file", "start").distinct().collect())
    ranks = spark.createDataFrame([(*s, i) for i, s in enumerate(splits)], "split_file string, split_start long, split long")
    got = rows.join(ranks, (F.col("file") == F.col("split_file")) & (F.col("start") == F.col("split_start")))
    seq = F.shiftleft("split", 33) + F.col("place") + 1
    return got.select(seq.alias("seq"), "op", "key", "value", F.col("ttl").alias("ttl_ms"), F.col("ts").alias("ts_ms"))


def stream_kv_lines(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """The same log as a stream of ``KV_LINES``."""
    return spark.readStream.schema(KV_LINES).option("maxFilesPerTrigger", files_per_batch).json(path)


def append_kv_lines(log: DataFrame, path: str) -> None:
    """Append ``KV_LOG`` rows as JSON lines, absent fields left out."""
    log.select("op", "key", "value", F.col("ttl_ms").alias("ttl"), F.col("ts_ms").alias("ts")).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str = KV_LOG) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def next_seq(log: DataFrame) -> int:
    """The number a writer gives next; truncating a log does not set it back if the writer keeps it."""
    return (log.agg(F.max("seq")).first()[0] or 0) + 1


def segment_name(n: int) -> str:
    """``seg-000001``; longer numbers are not cut."""
    if n < 0:
        raise ValueError("segment numbers are not negative")
    return f"seg-{n:06d}"


class Layout:
    """Paths of a collection: ``<root>/<collection>/{wal.log, segments/seg-NNNNNN, CURRENT}``.

    Paths may be of any file system Spark reaches; ``CURRENT`` is swapped by a rename there.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, collection: str | None = None):
        self.spark = spark
        self.root = (root or os.environ.get("KVSTORE_DATA_DIR") or "data").rstrip("/")
        self.collection = collection or os.environ.get("KVSTORE_COLLECTION") or "default"
        if not re.fullmatch(r"[\w.-]+", self.collection):
            raise ValueError("collection names are letters, digits, dots, dashes and underscores")
        self.dir = f"{self.root}/{self.collection}"
        self.wal, self.segments, self.current = f"{self.dir}/wal.log", f"{self.dir}/segments", f"{self.dir}/CURRENT"

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def init(self) -> Layout:
        fs, at = self._at(self.segments)
        fs.mkdirs(at)
        fs, at = self._at(self.wal)
        fs.mkdirs(at)
        return self

    def segment(self, n: int) -> str:
        return f"{self.segments}/{segment_name(n)}"

    def rewrite(self, path: str, rows: DataFrame) -> int:
        """Put a log's new form in its place, with one row more for the last number given; returns the other rows.

        The new files are written beside the old ones first, and a reader sees either all of the one or of the other
        but for the moment between two renames.
        """
        n, last = rows.count(), read_log(self.spark, path, rows.schema).agg(F.max("seq")).first()[0]
        rows.write.mode("overwrite").parquet(f"{path}.new")
        if last is not None and rows.agg(F.max("seq")).first()[0] != last:
            blank = [F.lit(last).cast("long").alias("seq") if f.name == "seq" else F.lit({"op": "NOP", "type": "nop"}.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema]
            self.spark.range(1).select(*blank).write.mode("append").parquet(f"{path}.new")
        fs, at = self._at(path)
        _, new = self._at(f"{path}.new")
        _, old = self._at(f"{path}.old")
        fs.delete(old, True)
        if not fs.rename(at, old) or not fs.rename(new, at):
            raise OSError(f"{path} could not be replaced")
        fs.delete(old, True)
        return n

    def read_current(self) -> str | None:
        fs, at = self._at(self.current)
        if not fs.exists(at):
            return None
        rows = self.spark.read.text(self.current).collect()
        return rows[0][0].strip() if rows else None

    def write_current(self, name: str) -> None:
        """Write the pointer beside the old one, then rename it into place, over the old one."""
        fs, at = self._at(self.current)
        _, new = self._at(f"{self.current}.new")
        out = fs.create(new, True)
        out.write(bytearray(f"{name}\n".encode()))
        out.close()
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs
        kind = getattr(hadoop, "Options$Rename")
        how = sc._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        at, new = fs.makeQualified(at), fs.makeQualified(new)
        hadoop.FileContext.getFileContext(at.toUri(), sc._jsc.hadoopConfiguration()).rename(new, at, how)
