"""Replica selection, the operation log and master promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import ReplicationConfig
from tessera.functions.hashing import code_unit_hash


def candidates(replicas: DataFrame) -> DataFrame:
    """One row: the sorted ids of healthy replicas."""
    return replicas.where("is_healthy").agg(F.sort_array(F.collect_list("node_id")).alias("ids"))


def select_replicas(ops: DataFrame, replicas: DataFrame, factor: int = 2) -> DataFrame:
    """``ops`` with ``key_hash`` and ``targets``: up to ``factor`` healthy replicas but the origin ``node_id``.

    They follow each other, by id, from the key's hash on, round the list. An operation without a key hashes
    ``global``. Without candidates the list is empty.
    """
    rows = ops.withColumn("__ids", F.array_remove(candidates(replicas).scalar(), F.coalesce("node_id", F.lit(""))))
    rows = rows.withColumn("key_hash", code_unit_hash(F.coalesce("key", F.lit("global"))))
    n = F.size("__ids")
    take = F.least(n, F.lit(factor))
    chosen = F.when(take > 0, F.transform(F.sequence(F.lit(0), F.greatest(take, F.lit(1)) - 1), lambda i: F.get("__ids", ((F.col("key_hash") + i) % F.greatest(n, F.lit(1))).cast("int")))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("targets", chosen).drop("__ids")


def op_log(ops: DataFrame, replicas: DataFrame, config: ReplicationConfig = ReplicationConfig()) -> DataFrame:
    """``seq, op, key, node_id, ts_ms, targets, replicated, replica_count``.

    An asynchronous operation counts as replicated at once, a synchronous one if any replica took it.
    """
    rows = select_replicas(ops, replicas, config.factor)
    done = F.size("targets") > 0
    return rows.select("seq", "op", "key", "node_id", "ts_ms", "targets", (F.lit(True) if config.mode == "async" else done).alias("replicated"), F.size("targets").alias("replica_count"))


def sync_stats(log: DataFrame, replicas: DataFrame, as_of_ms: int) -> DataFrame:
    """``node_id, synced_operations, last_sync_ms, replication_lag`` of each replica; the lag is that of its last operation."""
    per = log.select("seq", "ts_ms", F.explode("targets").alias("node_id")).groupBy("node_id").agg(F.count("*").alias("n"), F.max("ts_ms").alias("last_sync_ms"), F.max_by("ts_ms", "seq").alias("__ts"))
    got = replicas.select("node_id", "is_healthy").join(per, "node_id", "left")
    return got.select("node_id", "is_healthy", F.coalesce("n", F.lit(0)).cast("long").alias("synced_operations"), "last_sync_ms", F.coalesce(F.lit(as_of_ms) - F.col("__ts"), F.lit(0)).cast("long").alias("replication_lag"))


def replication_stats(log: DataFrame, synced: DataFrame, config: ReplicationConfig = ReplicationConfig()) -> DataFrame:
    """One row: replicas, healthy ones, mean lag of the healthy, operations by mode."""
    out = synced.agg(F.count("*").alias("total_replicas"), F.count(F.when(F.col("is_healthy"), 1)).alias("healthy_replicas"), F.coalesce(F.avg(F.when(F.col("is_healthy"), F.col("replication_lag"))), F.lit(0.0)).alias("average_lag"))
    n = log.agg(F.count("*")).scalar()
    zero = F.lit(0).cast("long")
    return out.withColumn("sync_operations", n if config.mode == "sync" else zero).withColumn("async_operations", n if config.mode == "async" else zero)


def trimmed_size(total: int, config: ReplicationConfig = ReplicationConfig()) -> int:
    """Rows a log of ``total`` appended rows holds, if it is cut to ``keep`` whenever it grows beyond ``limit``."""
    if total <= config.limit:
        return total
    return config.keep + (total - config.limit - 1) % (config.limit - config.keep + 1)


def trimmed(log: DataFrame, config: ReplicationConfig = ReplicationConfig()) -> DataFrame:
    """The newest rows of a log, as many as are left if it is cut in this way."""
    return log.orderBy(F.desc("seq")).limit(trimmed_size(log.count(), config))


def recent(log: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` rows, newest first."""
    return log.orderBy(F.desc("seq")).limit(n)


def master(replicas: DataFrame) -> DataFrame:
    return replicas.where("is_master").orderBy("insert_ord").limit(1)


def promote(replicas: DataFrame) -> DataFrame:
    """The replica that becomes master: healthy, not master, most synced; ties to the first inserted."""
    return replicas.where("is_healthy and not is_master").orderBy(F.desc("synced_ops"), "insert_ord").limit(1)


def _folded(rows: dict[str, dict], events: list[tuple[str, str]]) -> int:
    """Apply ``(event, node_id)`` to the replicas by id; how many masters were promoted."""
    promoted = 0

    def succeed():
        nonlocal promoted
        fit = [r for r in rows.values() if r["is_healthy"] and not r["is_master"]]
        if fit and not any(r["is_master"] and r["is_healthy"] for r in rows.values()):
            max(fit, key=lambda r: (r["synced_ops"], -r["insert_ord"]))["is_master"] = True
            promoted += 1

    for event, node in events:
        if event not in ("add", "unhealthy", "healthy", "remove"):
            raise ValueError(f"unknown event {event}")
        r = rows.get(node)
        if event == "add" and r is None:
            last = max((x["insert_ord"] for x in rows.values()), default=-1)
            rows[node] = {"node_id": node, "is_healthy": True, "is_master": False, "replication_lag": 0, "synced_ops": 0, "insert_ord": last + 1}
        if r is None:
            continue
        if event == "unhealthy" and r["is_healthy"]:
            r["is_healthy"] = False
            if r["is_master"]:
                succeed()
        elif event == "healthy" and not r["is_healthy"]:
            if r["is_master"] and any(x["is_master"] and x["is_healthy"] for x in rows.values()):
                r["is_master"] = False
            r["is_healthy"], r["replication_lag"] = True, 0
        elif event == "remove":
            del rows[node]
            if r["is_master"]:
                succeed()
    return promoted


def _by_id(replicas: DataFrame) -> dict[str, dict]:
    return {r["node_id"]: r.asDict() for r in replicas.orderBy("insert_ord").limit(10_000).collect()}


def fold_membership(replicas: DataFrame, events: list[tuple[str, str]]) -> DataFrame:
    """``replicas`` after ``(event, node_id)`` in turn: add, unhealthy, healthy or remove.

    An added replica is healthy, no master, without operations, and the last inserted. A master that turns unhealthy,
    or is removed, has a successor promoted at that transition only; it stays marked master itself while it is away,
    and loses the mark when it comes back. Unknown ids and repeated events change nothing. A replica set is a handful
    of rows, so this runs on the driver.
    """
    rows = _by_id(replicas)
    _folded(rows, events)
    return replicas.sparkSession.createDataFrame([tuple(r.get(c) for c in replicas.columns) for r in rows.values()], replicas.schema)


def failovers(replicas: DataFrame, events: list[tuple[str, str]]) -> int:
    """How many of the events had a successor promoted."""
    return _folded(_by_id(replicas), events)
