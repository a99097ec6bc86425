"""Versioned segments: build, read, manifest, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import CompactionConfig
from tessera.operators.state import latest

#: Column by which rows of a segment, or of several, are told apart: `segment_ord`, then `entry_ord` within it.
ENTRY = "segment_ord INT, entry_ord BIGINT, id STRING, vector ARRAY<DOUBLE>, metadata STRING, seq BIGINT, tombstone BOOLEAN"


def memtable(log: DataFrame) -> DataFrame:
    """``id, vector, metadata, seq, tombstone`` from a vector log ``(seq, type, id, vector, metadata)``.

    A delete keeps the payload of the row before it, if there is one, under its own number.
    """
    back = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    is_upsert = F.col("type") == "upsert"
    carried = lambda c: F.last(F.when(is_upsert, F.struct(F.col(c).alias("x"))), ignorenulls=True).over(back)["x"]
    rows = log.select("id", carried("vector").alias("vector"), carried("metadata").alias("metadata"), "seq", (~is_upsert).alias("tombstone"))
    return latest(rows, "id")


def is_full(table: DataFrame, threshold: int) -> bool:
    return len(table.select("id").take(threshold)) >= threshold


def segment_map(entries: DataFrame) -> DataFrame:
    """What the segments' maps hold: of one id's entries within a segment, the last."""
    rank = F.row_number().over(Window.partitionBy("segment_ord", "id").orderBy(F.desc("entry_ord")))
    return entries.withColumn("__r", rank).where("__r = 1").drop("__r")


def manifest(entries: DataFrame) -> DataFrame:
    """``segment_ord, entry_count, min_seq, max_seq``; the count includes repeated ids."""
    return entries.groupBy("segment_ord").agg(F.count("*").alias("entry_count"), F.coalesce(F.min("seq"), F.lit(0)).alias("min_seq"), F.coalesce(F.max("seq"), F.lit(0)).alias("max_seq"))


def read(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return segment_map(entries).join(ids.select("id").distinct(), "id", "left_semi")


def _newest(entries: DataFrame) -> DataFrame:
    """The newest mapped entry of each id; of equal numbers the first segment's."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq"), "segment_ord"))
    return segment_map(entries).withColumn("__r", rank).where("__r = 1").drop("__r")


def compact(entries: DataFrame) -> DataFrame:
    """The newest entry of each id, without tombstones."""
    return _newest(entries).where(~F.col("tombstone"))


def compact_stats(entries: DataFrame) -> DataFrame:
    """One row: segments, mapped entries, entries dropped as older, tombstones dropped, entries left."""
    mapped = segment_map(entries).agg(F.countDistinct("segment_ord").alias("input_segments"), F.count("*").alias("mapped"))
    newest = _newest(entries).agg(F.count("*").alias("ids"), F.count(F.when(F.col("tombstone"), 1)).alias("dropped"))
    n = newest.select(F.struct("ids", "dropped")).scalar()
    out = mapped.withColumn("n", n)
    return out.select("input_segments", (F.col("mapped") - F.col("n.ids")).alias("deduplicated"), F.col("n.dropped").alias("dropped_tombstones"), (F.col("n.ids") - F.col("n.dropped")).alias("entry_count"))


def should_compact(segments: int, config: CompactionConfig = CompactionConfig()) -> bool:
    return segments >= max(2, config.threshold)


def manager_trace(entries: DataFrame, config: CompactionConfig = CompactionConfig()) -> DataFrame:
    """``step, arrived, compacted, segments, live``: segments arrive in order, and once there are enough of them all
    are replaced by their compaction.

    Which steps compact follows from the counts alone, so each step's entries are one plan over all of the input.
    """
    order = [r[0] for r in entries.select("segment_ord").distinct().orderBy("segment_ord").collect()]
    spark, rows, held = entries.sparkSession, [], 0
    for step, s in enumerate(order, 1):
        held += 1
        ran = should_compact(held, config)
        held = 1 if ran else held
        rows.append((step, s, ran, held))
    steps = spark.createDataFrame(rows, "step int, arrived int, compacted boolean, segments int")
    # After a compaction at step t, the entries left are those of a compaction of all that came up to t.
    runs = steps.where("compacted").select("step", "arrived")
    upto = segment_map(entries).join(F.broadcast(runs), F.col("segment_ord") <= F.col("arrived"))
    rank = F.row_number().over(Window.partitionBy("step", "id").orderBy(F.desc("seq"), "segment_ord"))
    left = upto.withColumn("__r", rank).where("__r = 1 and not tombstone").groupBy("step").agg(F.count("*").alias("live"))
    return steps.join(left, "step", "left").select("step", "arrived", "compacted", "segments", F.when(F.col("compacted"), F.coalesce("live", F.lit(0))).cast("long").alias("live"))
