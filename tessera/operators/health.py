"""Circuit breakers, node health, retries and partitions, as folds over event tables."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import FaultConfig
from tessera.operators.folds import in_order

CLOSED, OPEN, HALF_OPEN = "CLOSED", "OPEN", "HALF_OPEN"


class Breaker:
    """Closed until ``failure_threshold`` failures in a row; open until ``recovery_ms`` after the last; then half open
    until ``success_threshold`` successes, or one failure."""

    def __init__(self, config: FaultConfig = FaultConfig()):
        self.config, self.state, self.failures, self.successes, self.last_failure = config, CLOSED, 0, 0, 0.0

    def admits(self, now: float) -> bool:
        if self.state == OPEN:
            if now - self.last_failure <= self.config.recovery_ms:
                return False
            self.state, self.successes = HALF_OPEN, 0
        return self.state != HALF_OPEN or self.successes < self.config.success_threshold

    def record(self, ok: bool, now: float) -> None:
        if ok:
            self.failures = 0
            if self.state == HALF_OPEN:
                self.successes += 1
                if self.successes >= self.config.success_threshold:
                    self.state = CLOSED
        else:
            self.failures += 1
            self.last_failure = now
            if self.state == HALF_OPEN or self.failures >= self.config.failure_threshold:
                self.state = OPEN

    def force(self, state: str) -> None:
        """OPEN and HALF_OPEN only show; CLOSED resets."""
        if state == CLOSED:
            self.__init__(self.config)
        elif state not in (OPEN, HALF_OPEN):
            raise ValueError(f"unknown state {state}")


def breaker_states(calls: DataFrame, config: FaultConfig = FaultConfig()) -> DataFrame:
    """``seq, node_id, admitted, state, failures`` after each call ``(seq, node_id, ok, ts_ms)``, in order, per node.

    ``ok`` of a call that is not admitted does not matter. A row whose optional ``force`` is not null sets the state
    instead of being a call. A node's calls are one task's, but pass through it batch by batch.
    """
    rows = calls if "force" in calls.columns else calls.withColumn("force", F.lit(None).cast("string"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, b = None, None
        for part in parts:
            out = []
            for n, ok, now, force in zip(part["node_id"], part["ok"], part["ts_ms"], part["force"]):
                if b is None or n != node:
                    node, b = n, Breaker(config)
                if isinstance(force, str):
                    b.force(force)
                    out.append((None, b.state if force == CLOSED else force, b.failures))
                    continue
                if admitted := b.admits(now):
                    b.record(bool(ok), now)
                out.append((admitted, b.state, b.failures))
            if out:
                admitted, state, failures = zip(*out)
                yield pd.DataFrame({"seq": part["seq"], "node_id": part["node_id"], "admitted": pd.Series(admitted, index=part.index, dtype=object), "state": state, "failures": failures})

    return in_order(rows.select("seq", "node_id", "ok", "ts_ms", "force"), "node_id", "seq").mapInPandas(run, "seq long, node_id string, admitted boolean, state string, failures long")


def health_transitions(calls: DataFrame, config: FaultConfig = FaultConfig()) -> DataFrame:
    """``seq, node_id, is_healthy`` where a node's health changes; all start healthy.

    A node turns unhealthy at a run of ``unhealthy_after`` failures and healthy again at one of ``healthy_after``
    successes. Runs come from windows; of the rows that reach either length, those that differ from the one before
    are the changes.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("node_id").orderBy("seq")
    runs = calls.select("seq", "node_id", "ok", F.sum(F.coalesce((F.lag("ok").over(order) != F.col("ok")).cast("int"), F.lit(1))).over(order).alias("run"))
    at = F.row_number().over(Window.partitionBy("node_id", "run").orderBy("seq"))
    reached = runs.withColumn("n", at).where((F.col("ok") & (F.col("n") == config.healthy_after)) | (~F.col("ok") & (F.col("n") == config.unhealthy_after)))
    return reached.withColumn("was", F.coalesce(F.lag("ok").over(order), F.lit(True))).where(F.col("was") != F.col("ok")).select("seq", "node_id", F.col("ok").alias("is_healthy"))


def node_health(calls: DataFrame, nodes: DataFrame, config: FaultConfig = FaultConfig()) -> DataFrame:
    """``node_id, is_healthy, response_ms, errors, calls`` of each node at the end."""
    last = health_transitions(calls, config).groupBy("node_id").agg(F.max_by("is_healthy", "seq").alias("h"))
    seen = calls.groupBy("node_id").agg(F.max_by("response_ms", "seq").alias("response_ms"), F.count(F.when(~F.col("ok"), 1)).alias("e"), F.count("*").alias("c"))
    out = nodes.select("node_id").join(seen, "node_id", "left").join(last, "node_id", "left")
    return out.select("node_id", F.coalesce("h", F.lit(True)).alias("is_healthy"), "response_ms", F.coalesce("e", F.lit(0)).cast("long").alias("errors"), F.coalesce("c", F.lit(0)).cast("long").alias("calls"))


def fault_stats(health: DataFrame, breakers: DataFrame, retries: Column, recoveries: Column) -> DataFrame:
    """One row: healthy nodes, mean response of the healthy, error rate in percent, breakers open now."""
    now = breakers.groupBy("node_id").agg(F.max_by("state", "seq").alias("state")).agg(F.count(F.when(F.col("state") == OPEN, 1))).scalar()
    out = health.agg(F.count(F.when(F.col("is_healthy"), 1)).alias("healthy_nodes"), F.count(F.when(~F.col("is_healthy"), 1)).alias("unhealthy_nodes"), F.avg(F.when(F.col("is_healthy"), F.col("response_ms"))).alias("average_response_ms"))
    return out.withColumn("error_rate", F.coalesce(F.try_divide(retries * 100.0, retries + recoveries), F.lit(0.0))).withColumn("open_breakers", now)


def retry_schedule(spark: SparkSession, config: FaultConfig = FaultConfig()) -> DataFrame:
    """``attempt, delay_ms, waited_ms``: the pause before each retry and the sum so far."""
    rows = spark.range(1, config.max_retries + 1).select(F.col("id").cast("int").alias("attempt"))
    delay = lambda i: F.least(F.lit(float(config.max_delay_ms)), config.retry_delay_ms * F.pow(F.lit(config.backoff), i - 1)).cast("long")
    return rows.select("attempt", delay(F.col("attempt")).alias("delay_ms"), F.aggregate(F.transform(F.sequence(F.lit(1), "attempt"), delay), F.lit(0).cast("long"), lambda a, x: a + x).alias("waited_ms"))


def with_retries(action: Callable, config: FaultConfig = FaultConfig(), sleep: Callable[[float], None] | None = None, fallback: Callable | None = None):
    """Run a driver-side action with retries; then the fallback, if there is one, else the last error."""
    for attempt in range(config.max_retries + 1):
        try:
            return action()
        except Exception:
            if attempt == config.max_retries:
                if fallback is None:
                    raise
                return fallback()
            (sleep or time.sleep)(min(config.max_delay_ms, config.retry_delay_ms * config.backoff**attempt) / 1000)


class NodeMonitor:
    """Breakers and health of the nodes that a driver-side client calls."""

    def __init__(self, config: FaultConfig = FaultConfig()):
        self.config, self.nodes, self.breakers = config, {}, {}
        self.retries = self.recoveries = self.degradations = self.partitions = self.turned_unhealthy = 0
        self._cut: dict[str, float] = {}

    def register(self, node_id: str) -> bool:
        if node_id in self.nodes:
            return False
        self.nodes[node_id] = {"node_id": node_id, "is_healthy": True, "failures": 0, "successes": 0, "response_ms": 0.0, "errors": 0, "last_check_ms": None, "shown": None}
        self.breakers[node_id] = Breaker(self.config)
        return True

    def unregister(self, node_id: str) -> bool:
        self.breakers.pop(node_id, None)
        return self.nodes.pop(node_id, None) is not None

    def update(self, **changes) -> FaultConfig:
        """Change the configuration; breakers that exist follow it from their next call on."""
        self.config = replace(self.config, **changes)
        for b in self.breakers.values():
            b.config = self.config
        return self.config

    def record(self, node_id: str, ok: bool, now_ms: float, response_ms: float = 0.0) -> None:
        """A call's outcome; unknown nodes are passed over."""
        n = self.nodes.get(node_id)
        if n is None:
            return
        n |= {"response_ms": response_ms, "last_check_ms": now_ms, "shown": None}
        n["failures"], n["successes"] = (0, n["successes"] + 1) if ok else (n["failures"] + 1, 0)
        n["errors"] += not ok
        if ok and not n["is_healthy"] and n["successes"] >= self.config.healthy_after:
            n["is_healthy"] = True
            self.recoveries += 1
        elif not ok and n["is_healthy"] and n["failures"] >= self.config.unhealthy_after:
            n["is_healthy"] = False
            self.turned_unhealthy += 1

    def execute(self, node_id: str, action: Callable, now_ms: float, fallback: Callable | None = None):
        """Run an action of a node behind its breaker and record how it went; if it fails, the fallback, else its error.

        A call that the breaker does not admit fails as well. A fallback that fails gives way to the first error.
        """
        if node_id not in self.nodes:
            raise KeyError(f"node {node_id} is not registered")
        self._heal(now_ms)
        breaker, began = self.breakers[node_id], time.perf_counter()
        try:
            if not breaker.admits(now_ms):
                raise RuntimeError(f"the breaker of {node_id} is open")
            try:
                result = action()
            except Exception:
                breaker.record(False, now_ms)
                raise
            breaker.record(True, now_ms)
        except Exception:
            self.record(node_id, False, now_ms)
            if fallback is not None:
                self.degradations += 1
                with contextlib.suppress(Exception):
                    return fallback()
            raise
        self.record(node_id, True, now_ms, (time.perf_counter() - began) * 1000)
        return result

    def retried(self, action: Callable, now_ms: float, node_id: str | None = None, sleep: Callable[[float], None] | None = None):
        """``with_retries`` that counts failed attempts and recoveries, and records the failures of a node."""
        failed = 0

        def attempt():
            nonlocal failed
            try:
                got = action()
            except Exception:
                failed += 1
                self.retries += 1
                if node_id is not None:
                    self.record(node_id, False, now_ms)
                raise
            self.recoveries += failed > 0
            return got

        return with_retries(attempt, self.config, sleep)

    def force(self, node_id: str, state: str) -> bool:
        """Show a breaker state; CLOSED also resets the breaker. Whether the node is known."""
        if node_id not in self.breakers:
            return False
        self.breakers[node_id].force(state)
        self.nodes[node_id]["shown"] = None if state == CLOSED else state
        return True

    def partition(self, node_ids: list[str], now_ms: float, duration_ms: float | None = None) -> None:
        """Cut nodes off: unhealthy from now on, healthy again once the duration is over."""
        self.partitions += 1
        for k in node_ids:
            if k in self.nodes:
                self.nodes[k] |= {"is_healthy": False, "failures": self.config.unhealthy_after}
                self._cut[k] = now_ms + (self.config.partition_ms if duration_ms is None else duration_ms)

    def _heal(self, now_ms: float) -> None:
        for k in [k for k, until in self._cut.items() if now_ms >= until]:
            del self._cut[k]
            if k in self.nodes:
                self.nodes[k] |= {"is_healthy": True, "failures": 0, "successes": self.config.healthy_after}

    def health(self, now_ms: float) -> list[dict]:
        self._heal(now_ms)
        return [{k: v for k, v in n.items() if k != "shown"} | {"breaker": n["shown"] or self.breakers[n["node_id"]].state} for n in self.nodes.values()]

    def healthy(self, now_ms: float, wanted: bool = True) -> list[str]:
        return [n["node_id"] for n in self.health(now_ms) if n["is_healthy"] is wanted]

    def stats(self, now_ms: float) -> dict[str, float]:
        up = [n["response_ms"] for n in self.health(now_ms) if n["is_healthy"]]
        done = self.retries + self.recoveries
        return {
            "average_response_ms": sum(up) / len(up) if up else 0.0, "error_rate": 100 * self.retries / done if done else 0.0, "open_breakers": sum(b.state == OPEN for b in self.breakers.values()),
            "retries": self.retries, "recoveries": self.recoveries, "degradations": self.degradations, "partitions": self.partitions, "turned_unhealthy": self.turned_unhealthy,
        }


def partition_events(partitions: DataFrame, default_ms: int = 10_000) -> DataFrame:
    """``node_id, from_ms, to_ms`` of simulated partitions ``(node_id, ts_ms, duration_ms)``; no duration: the default."""
    return partitions.select("node_id", F.col("ts_ms").alias("from_ms"), (F.col("ts_ms") + F.coalesce("duration_ms", F.lit(default_ms))).alias("to_ms"))


def under_partition(calls: DataFrame, intervals: DataFrame) -> DataFrame:
    """``calls`` with ``partitioned``: whether the node is cut off at the time. Intervals are few, one array a node."""
    by_node = intervals.groupBy("node_id").agg(F.collect_list(F.struct("from_ms", "to_ms")).alias("__cut"))
    got = calls.join(by_node, "node_id", "left")
    return got.withColumn("partitioned", F.coalesce(F.exists("__cut", lambda c: (F.col("ts_ms") >= c["from_ms"]) & (F.col("ts_ms") < c["to_ms"])), F.lit(False))).drop("__cut")
