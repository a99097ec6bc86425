import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import cache


def simulate(keys, capacity):
    lru, out = cache.Lru(capacity), []
    for k in keys:
        out.append(lru.get(k))
        lru.set(k)
    return out, lru


@pytest.mark.parametrize("capacity,block", [(1, 7), (5, 16), (40, 100), (3, 10_000), (0, 10)])
def test_blocks_agree_with_one_pass(spark, capacity, block):
    rng = random.Random(capacity)
    keys = [f"k{min(rng.randrange(30), rng.randrange(30))}" for _ in range(500)]
    got = cache.access_trace(spark.createDataFrame(list(enumerate(keys)), "seq long, key string"), capacity, block_rows=block).orderBy("seq").collect()
    assert [r["hit"] for r in got] == simulate(keys, capacity)[0]


def test_consumers_of_some_columns_over_many_blocks(spark):
    rng = random.Random(4)
    keys = [f"k{min(rng.randrange(30), rng.randrange(30))}" for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(keys)), "seq long, key string")
    hits, lru = simulate(keys, 7)
    assert cache.access_trace(df, 7, block_rows=100).count() == 400
    r = cache.hit_rates(df, [7], block_rows=100).first()
    assert (r["hits"], r["misses"], r["evictions"], r["final_size"]) == (lru.hits, lru.misses, lru.evictions, 7)
    got = {r["key"]: (r["gets"], r["cache_hits"], r["access_count"]) for r in cache.access_counts(df, 7, block_rows=100).collect()}
    assert got == {k: (keys.count(k), sum(h for h, x in zip(hits, keys) if x == k), sum(not h for h, x in zip(hits, keys) if x == k)) for k in set(keys)}


def test_rates_and_order(spark):
    keys = list("abcabdaacbe")
    hits, lru = simulate(keys, 3)
    df = spark.createDataFrame(list(enumerate(keys)), "seq long, key string")
    r = cache.hit_rates(df, [3]).first()
    assert (r["hits"], r["misses"], r["evictions"]) == (lru.hits, lru.misses, lru.evictions) and abs(r["hit_rate"] - lru.hit_rate) < 1e-9
    assert [x["key"] for x in cache.keys_in_order(df, 3).collect()] == lru.keys_in_order()
    assert cache.access_trace(df.limit(0), 3).count() == 0


def test_fold_with_deletes_and_expiry(spark):
    rows = [("n", 0, "SET", "a", None, 0), ("n", 1, "SET", "b", 5, 0), ("n", 2, "GET", "b", None, 5), ("n", 3, "GET", "b", None, 6), ("n", 4, "DELETE", "a", None, 7), ("n", 5, "HAS", "a", None, 8), ("n", 6, "CLEAR", None, None, 9), ("n", 7, "GET", "a", None, 10)]
    got = cache.fold(spark.createDataFrame(rows, "cache string, seq long, op string, key string, ttl_ms long, ts_ms long"), 2).orderBy("seq").collect()
    assert [r["hit"] for r in got] == [None, None, True, False, True, False, None, False]


def test_resize():
    lru = cache.Lru(3)
    for k in "abc":
        lru.set(k)
    lru.resize(1)
    assert lru.keys_in_order() == ["c"] and lru.evictions == 2
    with pytest.raises(ValueError):
        lru.resize(-1)


@pytest.mark.parametrize("step", [1, 1000])
def test_many_blocks_in_groups_and_gaps(spark, monkeypatch, step):
    """Summaries of blocks go through several levels; blocks without rows need none."""
    monkeypatch.setattr(cache, "GROUP", 3)
    rng = random.Random(step)
    keys = [f"k{rng.randrange(4)}" if i < 300 else f"k{min(rng.randrange(60), rng.randrange(60))}" for i in range(700)]
    df = spark.createDataFrame([(i if i < 350 else i + step * 10, k) for i, k in enumerate(keys)], "seq long, key string").repartition(5)
    got = cache.access_trace(df, 9, block_rows=10).orderBy("seq").collect()
    assert [r["hit"] for r in got] == simulate(keys, 9)[0] and [r["key"] for r in got] == keys
    rates = {r["capacity"]: (r["hits"], r["misses"], r["evictions"], r["final_size"]) for r in cache.hit_rates(df, [2, 0, 9, 30], block_rows=10).collect()}
    assert rates == {c: ((lru := simulate(keys, c)[1]).hits, lru.misses, lru.evictions, len(lru.entries)) for c in (2, 0, 9, 30)}


def test_one_pass_whatever_the_number_of_blocks_and_capacities(spark):
    """The table is read a fixed number of times: for the summaries, the accesses and the number of keys."""
    df = spark.range(4000).select(F.col("id").alias("seq"), (F.col("id") % 7).cast("string").alias("key"))
    plan = lambda block: cache.hit_rates(df, [1, 2, 3], block_rows=block)._jdf.queryExecution().optimizedPlan().toString()
    assert plan(500).count("Range (0, 4000") == 3 and plan(10).count("Range (0, 4000") <= 5
    assert plan(500).count("MapInPandas") == 2
    assert cache.hit_rates(df.limit(0), [3, 0]).select("capacity", "hits", "misses", "evictions", "final_size", "hit_rate").collect() == [(3, 0, 0, 0, 0, 0.0), (0, 0, 0, 0, 0, 0.0)]
