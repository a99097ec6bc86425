"""LRU cache simulation over access traces."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.folds import in_order


class Lru:
    """A bounded cache of keys in order of use, with the counters of a store's cache."""

    def __init__(self, capacity: int):
        if capacity < 0:
            raise ValueError("capacity must not be negative")
        self.capacity, self.entries, self.hits, self.misses, self.evictions = capacity, OrderedDict(), 0, 0, 0

    def get(self, key: str, now: float | None = None) -> bool:
        if key in self.entries:
            until = self.entries[key]
            if until is None or now is None or now <= until:
                self.entries.move_to_end(key)
                self.hits += 1
                return True
            del self.entries[key]
        self.misses += 1
        return False

    def set(self, key: str, until: float | None = None) -> None:
        self.entries[key] = until
        self.entries.move_to_end(key)
        while len(self.entries) > self.capacity:
            self.entries.popitem(last=False)
            self.evictions += 1

    def has(self, key: str, now: float | None = None) -> bool:
        """Touches neither recency nor counters."""
        return key in self.entries and (now is None or self.entries[key] is None or now <= self.entries[key])

    def delete(self, key: str) -> bool:
        return self.entries.pop(key, self) is not self

    def clear(self) -> None:
        self.entries.clear()
        self.hits = self.misses = self.evictions = 0

    def resize(self, capacity: int) -> None:
        if capacity < 0:
            raise ValueError("capacity must not be negative")
        self.capacity = capacity
        while len(self.entries) > capacity:
            self.entries.popitem(last=False)
            self.evictions += 1

    def keys_in_order(self) -> list[str]:
        """Most recently used first."""
        return list(reversed(self.entries))

    @property
    def hit_rate(self) -> float:
        """In percent; 0 before any access."""
        return 100 * self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0


#: Blocks whose summaries one task goes through in order.
GROUP = 64


def _last_used(rows: DataFrame, capacity: int) -> DataFrame:
    """``block, seq, key``: of each block's keys the ``capacity`` used last, with their last use."""
    newest = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("seq")))
    return rows.groupBy("block", "key").agg(F.max("seq").alias("seq")).withColumn("r", newest).where(F.col("r") <= capacity).select("block", "seq", "key")


def _starts(last: DataFrame, blocks: int, capacity: int) -> DataFrame:
    """``block, seq, key``: the ``capacity`` keys used last before each block of ``last``, which is as of ``_last_used``.

    Groups of ``GROUP`` blocks are gone through at once, in order within each. What comes before a group is found in
    the same way from the groups' own summaries, so each level has a small part of the rows of the one below.
    """
    kinds = {f.name: f.dataType.simpleString() for f in last.schema}
    rows = last.select(F.floor(F.col("block") / GROUP).alias("group"), "seq", "key", "block")
    if blocks > GROUP:
        groups = _last_used(rows.select(F.col("group").alias("block"), "seq", "key"), capacity)
        before = _starts(groups, (blocks - 1) // GROUP + 1, capacity)
        rows = rows.union(before.select("block", "seq", "key", F.lit(-1).cast("long")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, group, at = OrderedDict(), None, -1
        for p in parts:
            out = []
            for g, seq, key, block in zip(p["group"].tolist(), p["seq"].tolist(), p["key"].tolist(), p["block"].tolist()):
                if g != group:
                    held, group, at = OrderedDict(), g, -1
                if block not in (-1, at):
                    at = block
                    out += [(block, s, k) for k, s in held.items()]
                held[key] = seq
                held.move_to_end(key)
                if len(held) > capacity:
                    held.popitem(last=False)
            if out:
                yield pd.DataFrame(out, columns=["block", "seq", "key"])

    return in_order(rows, "group", "seq").mapInPandas(run, f"block long, seq {kinds['seq']}, key {kinds['key']}")


def _accesses(trace: DataFrame, most: int, block_rows: int) -> DataFrame:
    """``block, seq, key, own``: each block's accesses in order, after those that fill a cache of ``most`` keys with what
    it holds when the block begins; these are not its ``own``."""
    ends = trace.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    if ends["a"] is None:
        return trace.select(F.lit(0).alias("block"), "seq", "key", F.lit(True).alias("own"))
    blocks = int((ends["b"] - ends["a"]) // block_rows) + 1
    rows = trace.select(F.floor((F.col("seq") - ends["a"]) / block_rows).alias("block"), "seq", "key")
    out = rows.withColumn("own", F.lit(True))
    if blocks > 1 and most:
        out = out.union(_starts(_last_used(rows, most), blocks, most).withColumn("own", F.lit(False)))
    return in_order(out, "block", "seq")


def _hits(capacities: list[int], parts: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Batches of own accesses out of ``_accesses``, and for each capacity which of them hit."""
    block, held = None, [OrderedDict() for _ in capacities]
    for p in parts:
        hits = [[] for _ in capacities]
        caches = [(h, c, x.append) for h, c, x in zip(held, capacities, hits)]
        for b, key in zip(p["block"].tolist(), p["key"].tolist()):
            if b != block:
                block = b
                for h in held:
                    h.clear()
            for h, c, tell in caches:
                if key in h:
                    h.move_to_end(key)
                    tell(True)
                else:
                    h[key] = None
                    if len(h) > c:
                        h.popitem(last=False)
                    tell(False)
        own = p["own"].to_numpy(dtype=bool)
        if own.any():
            yield p[own], [np.array(x, dtype=bool)[own] for x in hits]


def access_trace(trace: DataFrame, capacity: int, *, block_rows: int = 50_000) -> DataFrame:
    """``seq, key, hit`` for a trace ``(seq, key)`` of get-then-set accesses to one LRU cache.

    The trace is cut into blocks of about ``block_rows`` sequence numbers. The cache's content at a block's start is
    the ``capacity`` keys used last before it, found from summaries of the blocks; blocks are then simulated at once.
    """
    if capacity < 0:
        raise ValueError("capacity must not be negative")
    if capacity == 0:
        return trace.select("seq", "key", F.lit(False).alias("hit"))
    kinds = {f.name: f.dataType.simpleString() for f in trace.select("seq", "key").schema}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p, (hit,) in _hits([capacity], parts):
            yield pd.DataFrame({"seq": p["seq"], "key": p["key"], "hit": hit})

    return _accesses(trace, capacity, block_rows).mapInPandas(run, f"seq {kinds['seq']}, key {kinds['key']}, hit boolean")


def hit_rates(trace: DataFrame, capacities: list[int], *, block_rows: int = 50_000) -> DataFrame:
    """``capacity, hits, misses, evictions, final_size, hit_rate`` of each capacity, all in one pass; the rate in percent."""
    if min(capacities) < 0:
        raise ValueError("capacity must not be negative")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p, hits in _hits(capacities, parts):
            yield pd.DataFrame({"n": [len(p)], "hits": [[int(x.sum()) for x in hits]]})

    counts = _accesses(trace, max(capacities), block_rows).mapInPandas(run, "n long, hits array<long>")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.array(*[F.coalesce(F.sum(F.get("hits", F.lit(i))), F.lit(0)) for i in range(len(capacities))]).alias("hits"))
    each = sums.select("n", F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in capacities]).alias("capacity"), "hits")).alias("x")).select("x.capacity", "x.hits", "n")
    size = F.least(trace.agg(F.countDistinct("key")).scalar(), F.col("capacity")).cast("long")
    out = each.select("capacity", "hits", (F.col("n") - F.col("hits")).alias("misses"), size.alias("final_size"))
    return out.select("capacity", "hits", "misses", (F.col("misses") - F.col("final_size")).alias("evictions"), "final_size", F.coalesce(F.try_divide(F.col("hits") * 100.0, F.col("hits") + F.col("misses")), F.lit(0.0)).alias("hit_rate"))


def keys_in_order(trace: DataFrame, capacity: int) -> DataFrame:
    """``key, last_seq`` of the keys a cache of access-only traffic holds, most recent first."""
    return trace.groupBy("key").agg(F.max("seq").alias("last_seq")).orderBy(F.desc("last_seq")).limit(capacity)


def access_counts(trace: DataFrame, capacity: int, *, block_rows: int = 50_000) -> DataFrame:
    """``key, gets, cache_hits, access_count``: the last counts the reads that reached storage."""
    hit = F.col("hit").cast("long")
    return access_trace(trace, capacity, block_rows=block_rows).groupBy("key").agg(F.count("*").alias("gets"), F.sum(hit).alias("cache_hits"), F.sum(1 - hit).alias("access_count"))


def fold(trace: DataFrame, capacity: int) -> DataFrame:
    """``cache, seq, op, key, hit`` of a trace with deletes, clears and times to live: an ordered fold per cache.

    ``trace`` is ``cache, seq, op, key, ttl_ms, ts_ms`` with op GET, SET, DELETE, HAS or CLEAR. ``hit`` is null for SET
    and CLEAR. Deleting makes room, so a fold in order is the only exact way; caches run beside each other.
    """
    if capacity < 0:
        raise ValueError("capacity must not be negative")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, lru = None, None
        for part in parts:
            out = []
            for c, op, key, ttl, now in zip(part["cache"], part["op"], part["key"], part["ttl_ms"], part["ts_ms"]):
                if lru is None or c != cache:
                    cache, lru = c, Lru(capacity)
                if op == "SET":
                    lru.set(key, now + ttl if ttl == ttl and ttl else None)
                    out.append(None)
                elif op == "CLEAR":
                    lru.clear()
                    out.append(None)
                else:
                    out.append(lru.get(key, now) if op == "GET" else lru.has(key, now) if op == "HAS" else lru.delete(key))
            yield part[["cache", "seq", "op", "key"]].assign(hit=pd.Series(out, index=part.index, dtype=object))

    rows = trace.select("cache", "seq", "op", "key", F.col("ttl_ms").cast("double").alias("ttl_ms"), F.col("ts_ms").cast("double").alias("ts_ms"))
    return in_order(rows, "cache", "seq").mapInPandas(run, "cache string, seq long, op string, key string, hit boolean")
