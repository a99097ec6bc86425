"""Consistent hashing: virtual nodes, placement, failover and moved keys."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import RingConfig
from tessera.functions.hashing import ring_hash, ring_hash_of

TOP = (1 << 32) - 1
#: Buckets of the hash space that the range lookup is keyed by.
BUCKET_BITS = 10
#: A ring of up to this many virtual nodes goes to every task.
BROADCAST_VNODES = 100_000


def nodes(spark: SparkSession, config: RingConfig = RingConfig(), unhealthy: tuple[str, ...] = ()) -> DataFrame:
    """``node_id, host, port, is_healthy``, one row a node id; a repeated id counts once."""
    rows = {n[0]: (*n, n[0] not in unhealthy) for n in reversed(config.nodes)}
    return spark.createDataFrame([rows[n[0]] for n in dict.fromkeys(config.nodes) if n[0] in rows], "node_id string, host string, port int, is_healthy boolean").dropDuplicates(["node_id"])


def vnodes(node_rows: DataFrame, count: int = 150) -> DataFrame:
    """``node_id, vnode, hash, is_healthy``."""
    rows = node_rows.select("node_id", "is_healthy", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("vnode"))
    return rows.select("node_id", "vnode", ring_hash(F.concat_ws(":", "node_id", F.col("vnode").cast("string"))).alias("hash"), "is_healthy")


def segments(ring: DataFrame) -> DataFrame:
    """``lo, hi, node_id``: hashes in (lo, hi] belong to the node; only healthy nodes own any.

    A hash beyond the last virtual node wraps to the first. Of equal hashes the first by node and number owns the
    segment. The window's one partition holds the ring itself, nodes times virtual nodes.
    """
    healthy = ring.where("is_healthy").groupBy("hash").agg(F.min(F.struct("node_id", "vnode")).alias("x")).select("hash", "x.node_id")
    order = Window.orderBy("hash")
    own = healthy.select(F.coalesce(F.lag("hash").over(order), F.lit(-1)).alias("lo"), F.col("hash").alias("hi"), "node_id")
    wrap = healthy.agg(F.max("hash").alias("lo"), F.min_by("node_id", "hash").alias("node_id")).where("lo is not null").select("lo", F.lit(TOP).alias("hi"), "node_id")
    return own.union(wrap.where(F.col("lo") < TOP))


def place(keys: DataFrame, ring: DataFrame, ring_size: int | None = None) -> DataFrame:
    """``keys`` with ``node_id``, null where no node is healthy.

    The lookup is an equi-join on the hash's upper bits; a segment is listed under each bucket it meets. The ring is
    broadcast only if ``ring_size`` is known and small.
    """
    shift = 32 - BUCKET_BITS
    low = F.shiftright(F.col("lo") + 1, shift)
    parts = segments(ring).select("lo", "hi", "node_id", F.explode(F.sequence(low, F.shiftright("hi", shift))).alias("bucket"))
    if ring_size is not None and ring_size <= BROADCAST_VNODES:
        parts = F.broadcast(parts)
    hashed = keys.drop("node_id").withColumn("__h", ring_hash(F.col("key")))
    got = hashed.join(parts, (F.shiftright("__h", shift) == F.col("bucket")) & (F.col("__h") > F.col("lo")) & (F.col("__h") <= F.col("hi")), "left")
    return got.drop("__h", "lo", "hi", "bucket")


def owner_of(key: str, config: RingConfig, unhealthy: tuple[str, ...] = ()) -> str | None:
    """The node of one key, on the driver: what ``place`` gives it; none if no node is healthy."""
    ring = sorted((ring_hash_of(f"{n[0]}:{i}"), n[0], i) for n in dict.fromkeys(config.nodes) if n[0] not in unhealthy for i in range(config.vnodes))
    if not ring:
        return None
    return ring[bisect.bisect_left(ring, (ring_hash_of(key),)) % len(ring)][1]


def distribution(placed: DataFrame, node_rows: DataFrame) -> DataFrame:
    """``node_id, key_count``, every node present."""
    counts = placed.groupBy("node_id").agg(F.count("*").alias("n"))
    return node_rows.select("node_id").join(counts, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).cast("long").alias("key_count"))


def key_lists(placed: DataFrame, node_rows: DataFrame) -> DataFrame:
    """``node_id, key_count, keys``: every node with all its keys in order; meant for small stores."""
    lists = placed.groupBy("node_id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    return node_rows.select("node_id").join(lists, "node_id", "left").select("node_id", F.coalesce(F.size("keys"), F.lit(0)).cast("long").alias("key_count"), F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))


def moved(keys: DataFrame, before: DataFrame, after: DataFrame, size_before: int | None = None, size_after: int | None = None) -> DataFrame:
    """``key, node_before, node_after`` of keys that two rings place differently."""
    a = place(keys.select("key"), before, size_before).withColumnRenamed("node_id", "node_before")
    b = place(a, after, size_after).withColumnRenamed("node_id", "node_after")
    return b.where(~F.col("node_before").eqNullSafe(F.col("node_after"))).select("key", "node_before", "node_after")


def ring_stats(ring: DataFrame) -> DataFrame:
    """One row: nodes, healthy nodes, virtual nodes."""
    return ring.agg(F.countDistinct("node_id").alias("total_nodes"), F.countDistinct(F.when(F.col("is_healthy"), F.col("node_id"))).alias("healthy_nodes"), F.count("*").alias("virtual_nodes"))
