"""State of a key-value store, derived from its log.

The log (``seq, op, key, value, ttl_ms, ts_ms``) is the only truth: the state is each key's latest SET after the last
CLEAR. Time is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import utf16_length


def expiry(ttl_ms: Column, ts_ms: Column) -> Column:
    """Absolute expiry; null and 0 never expire, a negative time to live already has."""
    return F.when(ttl_ms.isNotNull() & (ttl_ms != 0), ts_ms + ttl_ms)


def live(as_of_ms: int, expire_at: str = "expire_at_ms") -> Column:
    return F.col(expire_at).isNull() | (F.lit(as_of_ms) <= F.col(expire_at))


def after_clear(log: DataFrame) -> DataFrame:
    """Rows after the last CLEAR."""
    barrier = log.where(F.col("op") == "CLEAR").agg(F.max("seq").alias("barrier"))
    return log.where(F.col("seq") > F.coalesce(barrier.scalar(), F.lit(-(1 << 62))))


def latest(log: DataFrame, key: str = "key") -> DataFrame:
    """Each key's last row. A key's rows are cut to one within each task before they meet."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
    return log.withColumn("__r", rank).where("__r = 1").drop("__r")


def replay(log: DataFrame, as_of_ms: int | None = None) -> DataFrame:
    """``key, value, seq, ts_ms, expire_at_ms`` of all keys that are set, as of a time: rows later than it are not seen.

    Without a time, every row is seen and nothing expires.
    """
    seen = log if as_of_ms is None else log.where(F.col("ts_ms") <= as_of_ms)
    state = latest(after_clear(seen).where(F.col("op").isin("SET", "DELETE"))).where("op = 'SET'")
    state = state.select("key", "value", "seq", "ts_ms", expiry(F.col("ttl_ms"), F.col("ts_ms")).alias("expire_at_ms"))
    return state if as_of_ms is None else state.where(live(as_of_ms))


def keys(log: DataFrame, as_of_ms: int | None = None) -> DataFrame:
    return replay(log, as_of_ms).select("key")


def get_batch(requests: DataFrame, state: DataFrame) -> DataFrame:
    """``requests`` with ``found`` and ``value``."""
    return requests.join(state.select("key", "value", F.lit(True).alias("__hit")), "key", "left").select(*requests.columns, F.coalesce("__hit", F.lit(False)).alias("found"), "value")


def exists_batch(requests: DataFrame, state: DataFrame) -> DataFrame:
    return requests.join(state.select("key"), "key", "left_semi")


def delete_outcomes(log: DataFrame) -> DataFrame:
    """``seq, key, existed`` of each DELETE: the key's row before it is a SET, and no CLEAR lies between.

    A key that is past its time but still there counts as existing. Clears are few; their numbers go along as one
    sorted array.
    """
    clears = log.where("op = 'CLEAR'").agg(F.sort_array(F.collect_list("seq")).alias("clears")).scalar()
    before = Window.partitionBy("key").orderBy("seq")
    rows = log.where(F.col("op").isin("SET", "DELETE")).select("seq", "key", "op", F.lag("op").over(before).alias("was"), F.lag("seq").over(before).alias("at"))
    gone = rows.where("op = 'DELETE'").withColumn("__clears", clears)
    cleared = F.exists("__clears", lambda c: (c > F.col("at")) & (c < F.col("seq")))
    return gone.select("seq", "key", F.coalesce((F.col("was") == "SET") & ~cleared, F.lit(False)).alias("existed"))


def stats(log: DataFrame) -> DataFrame:
    """One row: keys (expired ones that no read has purged included), bytes by the store's estimate, operations."""
    state = replay(log).agg(F.count("*").alias("total_keys"), F.coalesce(F.sum(utf16_length(F.col("key")) + utf16_length(F.col("value")) + 100), F.lit(0)).cast("long").alias("memory_usage"))
    return state.withColumn("operations", log.agg(F.count("*")).scalar())
