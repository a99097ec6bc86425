import random

import pytest
from pyspark.sql import functions as F

from tessera.config import FaultConfig, StoreConfig
from tessera.engine import KeyValueStore, VectorCollection, collection, store
from tessera.functions import text
from tessera.operators import cache, health, latency, lsm, rag, state
from tessera.sources.log import KV_LOG, Layout, append_kv_lines, read_kv_lines, segment_name, stream_kv_lines
from tessera.streaming import replay


def entries(spark, rows):
    return spark.createDataFrame([(s, e, i, None, None, q, t) for s, e, i, q, t in rows], lsm.ENTRY)


def test_compaction_ties_and_tombstones(spark):
    e = entries(spark, [(0, 0, "a", 1, False), (0, 1, "a", 1, True), (1, 0, "a", 1, False), (1, 1, "b", 4, False), (0, 2, "c", 2, False), (1, 2, "c", 3, True)])
    assert [(r["id"], r["seq"]) for r in lsm.compact(e).collect()] == [("b", 4)]
    assert lsm.compact_stats(e).first().asDict() == {"input_segments": 2, "deduplicated": 2, "dropped_tombstones": 2, "entry_count": 1}
    assert {r["segment_ord"]: r["entry_count"] for r in lsm.manifest(e).collect()} == {0: 3, 1: 3}
    trace = lsm.manager_trace(entries(spark, [(s, 0, f"k{s % 3}", s, False) for s in range(6)])).orderBy("step").collect()
    assert [r["compacted"] for r in trace] == [False, False, False, True, False, False] and trace[3]["live"] == 3
    assert not lsm.should_compact(1)


def test_replay_of_a_compaction_is_the_replay(spark):
    rng = random.Random(3)
    log = [(i, rng.choice(["upsert", "upsert", "delete"]), f"v{rng.randrange(9)}", [float(i)], "{}") for i in range(100)]
    df = spark.createDataFrame(log, "seq long, type string, id string, vector array<double>, metadata string")
    live = lambda d: {(r["id"], r["seq"]) for r in d.where("not tombstone").collect()}
    table = lsm.memtable(df)
    e = df.select((F.col("seq") % 3).cast("int").alias("segment_ord"), "seq", "type", "id", "vector", "metadata").select("segment_ord", F.col("seq").alias("entry_ord"), "id", "vector", "metadata", "seq", (F.col("type") == "delete").alias("tombstone"))
    assert live(table) == live(lsm.compact(e)) and lsm.is_full(table, 9) and not lsm.is_full(table, 10)


def test_transitions_like_a_fold(spark):
    rng = random.Random(5)
    calls = [(i, rng.choice(["a", "b"]), rng.random() < 0.55, i * 1000, 1.0) for i in range(300)]
    df = spark.createDataFrame(calls, "seq long, node_id string, ok boolean, ts_ms long, response_ms double")
    want = []
    for node in "ab":
        fails = good = 0
        healthy = True
        for seq, n, ok, _, _ in calls:
            if n != node:
                continue
            fails, good = (0, good + 1) if ok else (fails + 1, 0)
            if healthy and fails >= 3 or not healthy and good >= 2:
                healthy = not healthy
                want.append((seq, node, healthy))
    got = [tuple(r) for r in health.health_transitions(df).collect()]
    assert sorted(got) == sorted(want)


def test_breaker(spark):
    b = health.Breaker(FaultConfig(failure_threshold=2, recovery_ms=10, success_threshold=2))
    for t in (0, 1):
        b.record(False, t)
    assert b.state == health.OPEN and not b.admits(11) and b.admits(12) and b.state == health.HALF_OPEN
    b.record(True, 12)
    b.record(True, 13)
    assert b.state == health.CLOSED
    rows = [(1, "a", True, 0, "OPEN"), (2, "a", True, 1, None), (3, "a", False, 2, "CLOSED")]
    got = health.breaker_states(spark.createDataFrame(rows, "seq long, node_id string, ok boolean, ts_ms long, force string")).orderBy("seq").collect()
    assert [r["state"] for r in got] == ["OPEN", "CLOSED", "CLOSED"]


def test_retries_and_partitions(spark):
    waits, tries = [], []
    with pytest.raises(ZeroDivisionError):
        health.with_retries(lambda: tries.append(1) or 1 / 0, sleep=waits.append)
    assert len(tries) == 4 and waits == [0.1, 0.2, 0.4]
    assert health.with_retries(lambda: 1 / 0, sleep=waits.append, fallback=lambda: 7) == 7
    calls = spark.createDataFrame([("a", 5), ("a", 10_005), ("b", 5)], "node_id string, ts_ms long")
    cut = health.partition_events(spark.createDataFrame([("a", 5, None)], "node_id string, ts_ms long, duration_ms long"))
    assert [r["partitioned"] for r in health.under_partition(calls, cut).orderBy("node_id", "ts_ms").collect()] == [True, False, False]


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 1.0, 2.0, None], [float(i % 17) for i in range(500)]])
def test_percentiles(spark, values):
    got = latency.percentiles(spark.createDataFrame([(v,) for v in values], "x double"), "x").first()
    known = [v for v in values if v is not None]
    assert got["n"] == len(known) and [got[f"p{p}"] for p in (50, 95, 99)] == [latency.percentile_of(known, p) for p in (50, 95, 99)]


def test_chunks_and_codec(spark):
    rows = spark.createDataFrame([(1, " ".join(map(str, range(95)))), (2, "  \n"), (3, None), (4, "a b\tc")], "doc_id long, text string")
    got = rag.chunk(rows).orderBy("doc_id", "chunk").collect()
    assert [(r["doc_id"], r["chunk"], len(r["text"].split())) for r in got] == [(1, 0, 40), (1, 1, 40), (1, 2, 15), (4, 0, 3)]
    values = ['"a\\"b"', '{"k": 1}', "plain", "3", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(text.decode_value(F.col("v"))).collect()] == ['a"b', '{"k": 1}', "plain", "3", None]
    assert df.where(text.decode_document(F.col("v")).isNotNull()).count() == 0


def test_engine_end_to_end(spark, tmp_path):
    s = store(spark, str(tmp_path), "kv")
    assert s is store(spark, str(tmp_path), "kv")
    s.set("a", "1", 0)
    s.set("b", "2", 0, ttl_ms=5)
    assert s.get("a", 9) == "1" and s.get("b", 6) is None and s.exists("b", 5)
    assert s.delete("b", 9) and not s.delete("b", 10) and not s.delete("zz", 10)
    s.upsert_document("doc:1", "hello", [1.0, 0.0], 20, {"x": 1})
    s.upsert_document("doc:2", "there", [0.0, 1.0], 20)
    assert [r["key"] for r in s.query([1.0, 0.1], 30, 2, "doc:").collect()] == ["doc:1", "doc:2"]
    assert s.get_json("doc:1", 30)["metadata"] == {"x": 1}
    assert s.add_node("node-4") and not s.add_node("node-4") and s.remove_node("node-1") and s.placed(30).where("node_id is null").count() == 0
    again = KeyValueStore(spark, Layout(spark, str(tmp_path), "kv"))
    assert again._seq == s._seq
    s.clear(40)
    assert s.keys(50).count() == 0 and s.stats().first()["total_keys"] == 0
    for bad in (lambda: s.set("", "x", 0), lambda: s.set("k", None, 0), lambda: s.get("", 0)):
        with pytest.raises(ValueError):
            bad()


def test_store_parts_are_wired(spark, tmp_path):
    s = store(spark, str(tmp_path), "parts", StoreConfig(cache_capacity=2))
    s.write([("SET", f"k{i}", str(i), None, i) for i in range(4)])
    assert s.cache_keys() == ["k3", "k2"] and s.get("k3", 9) == "3" and s.get("k0", 9) == "0" and s.get("k0", 9) == "0"
    assert s.cache_keys() == ["k0", "k3"] and {r["key"]: r["access_count"] for r in s.access_stats().collect()} == {"k0": 1}
    assert s.cache_stats()["hits"] == 2 and s.get("k3", 2) is None
    s.configure(cache_capacity=1)
    assert len(s.cache_keys()) == 1
    s.configure(cache=False)
    assert s.cache_keys() == [] and s.get("k1", 9) == "1" and s.cache_keys() == []
    assert s.owner("k1") == s.placed(9).where("key = 'k1'").first()["node_id"]
    s.configure(sharding=False)
    assert s.owner("k1") is None and s.get("k1", 9) == "1"
    s.configure(sharding=True)
    assert s.operations().count() == 0 and s.add_replica("r1", is_master=True) and s.add_replica("r2") and not s.add_replica("r2")
    assert s.operations().count() == 4 and [r["op_id"] for r in s.operations(2).collect()] == ["op-4", "op-3"]
    assert s.mark_replica("r1", False) and s.replication_stats(99).first()["failover_events"] == 1 and s.replicas().where("is_master").count() == 2
    s.update_replication(limit=3, keep=2)
    assert s.operations().count() == 2
    s.configure(replication=False)
    assert s.operations().count() == 0 and s.remove_replica("r2") and not s.remove_replica("r2")
    s.clear_replicas()
    assert s.replicas().count() == 0
    s.partition_nodes(["node-1"], 0, 10)
    assert s.unhealthy_nodes(5) == ["node-1"] and s.unhealthy_nodes(10) == [] and len(s.node_health(10)) == 3
    assert s.set_breaker("node-2", "OPEN") and not s.set_breaker("zz", "OPEN") and {n["node_id"]: n["breaker"] for n in s.node_health(10)}["node-2"] == "OPEN"
    assert s.mark_node("node-1", False) and s.nodes(healthy_only=True).count() == 2 and s.add_node("node-9") and s.ring_stats().first()["rebalances"] == 1
    assert s.compact(9) == 4 and s.keys(9).count() == 4 and KeyValueStore(spark, s.layout)._seq == s._seq
    s.delete("k0", 9), s.delete("k3", 9)
    assert s.compact(10) == 2 and KeyValueStore(spark, s.layout)._seq == s._seq
    s.clear_nodes()
    assert s.nodes().count() == 0 and s.owner("k1") is None


def test_monitor():
    m = health.NodeMonitor(FaultConfig(failure_threshold=2, unhealthy_after=2, healthy_after=1, recovery_ms=10, success_threshold=1))
    assert m.register("a") and not m.register("a")
    fail = lambda: 1 / 0
    for t in (0, 1):
        with pytest.raises(ZeroDivisionError):
            m.execute("a", fail, t)
    assert m.healthy(1) == [] and m.breakers["a"].state == "OPEN" and m.stats(1)["open_breakers"] == 1
    with pytest.raises(RuntimeError):
        m.execute("a", lambda: 1, 2)
    assert m.execute("a", lambda: 1, 3, fallback=lambda: 2) == 2 and m.degradations == 1
    with pytest.raises(RuntimeError):
        m.execute("a", lambda: 1, 3, fallback=fail)
    assert m.execute("a", lambda: 1, 12) == 1 and m.healthy(12) == ["a"] and m.recoveries == 1
    tries = iter([0, 0, 1])
    assert m.retried(lambda: 1 / next(tries), 12, "a", sleep=lambda s: None) == 1 and m.retries == 2 and m.recoveries == 2 and m.stats(12)["error_rate"] == 50
    assert m.update(retry_delay_ms=1).retry_delay_ms == 1 and m.unregister("a") and not m.unregister("a")
    with pytest.raises(KeyError):
        m.execute("a", lambda: 1, 12)


def test_log_lines_are_numbered_by_file_and_place(spark, tmp_path):
    (tmp_path / "part-0.json").write_text('{"op":"SET","key":"a","value":"old","ts":1}\n')
    (tmp_path / "part-1.json").write_text("".join('{"op":"SET","key":"b","value":"%d","ts":2}\n' % i for i in range(3000)) + '{"op":"SET","key":"a","value":"new","ts":2}\n')
    log = read_kv_lines(spark, str(tmp_path))
    assert {r["key"]: r["value"] for r in state.replay(log).collect()} == {"a": "new", "b": "2999"}
    assert log.select("seq").distinct().count() == 3002 and read_kv_lines(spark, str(tmp_path)).agg(F.min("seq")).first()[0] == 1


def test_collection_end_to_end(spark, tmp_path):
    c = VectorCollection(spark, Layout(spark, str(tmp_path), "vec"))
    assert c.upsert([{"id": "a", "values": [1, 0], "metadata": {"t": 1}}, {"id": "b", "values": [0, 1]}, {"values": [1, 1]}], 0) == 2
    assert [r["id"] for r in c.query([1, 0.2], 5).collect()] == ["a", "b"] and [r["id"] for r in c.query([1, 0.2], 5, where={"t": 1}).collect()] == ["a"]
    with pytest.raises(ValueError):
        c.upsert([{"id": "c", "values": [1, 2, 3]}], 1)
    with pytest.raises(ValueError):
        c.query([1, 2, 3])
    assert c.delete(["a", "zz"], 2) == 1 and c.stats().first()["total_vectors"] == 1
    assert c.compact() == 1 and [r["id"] for r in c.query([1, 0.2], 5).collect()] == ["b"] and c.log().count() == 2
    assert VectorCollection(spark, c.layout)._seq == c._seq and collection(spark, str(tmp_path), "v") is collection(spark, str(tmp_path), "v")


def test_layout(spark, tmp_path):
    layout = Layout(spark, str(tmp_path), "c").init()
    assert layout.read_current() is None and segment_name(7) == "seg-000007" and segment_name(12345678) == "seg-12345678"
    for n in (1, 2):
        layout.write_current(segment_name(n))
        assert layout.read_current() == segment_name(n)


def test_stream_gives_the_batch_state(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choices(["SET", "DELETE", "CLEAR"], [9, 3, 0.3])[0], i) for i in range(200)]
    rows = [(i, op, None if op == "CLEAR" else f"k{rng.randrange(12)}", str(i), None, ts) for i, op, ts in rows]
    lines = str(tmp_path / "lines")
    for a in range(0, 200, 50):
        append_kv_lines(spark.createDataFrame(rows[a : a + 50], KV_LOG).coalesce(1), lines)
    assert read_kv_lines(spark, lines).count() == 200
    stream = stream_kv_lines(spark, lines, 1).select(F.col("ts").alias("seq"), "op", "key", "value", F.col("ttl").alias("ttl_ms"), F.col("ts").alias("ts_ms"))
    q = replay.start(stream, str(tmp_path / "state"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    want = {(r["key"], r["value"]) for r in state.replay(spark.createDataFrame(rows, KV_LOG)).collect()}
    assert {(r["key"], r["value"]) for r in state.replay(replay.state_log(spark, str(tmp_path / "state"))).collect()} == want
    assert len(replay.versions(spark, str(tmp_path / "state"))) <= 2




def test_breakers_and_caches_stream_through_batches(spark):
    """A node's calls pass through in batches, whatever the order they come in; no group is a data frame of its own."""
    rng = random.Random(2)
    t, rows = 0, []
    for i in range(600):
        t += rng.choice((1, 1, 40_000))
        rows.append((i, f"n{rng.randrange(3)}", rng.random() < 0.4, t))
    df = spark.createDataFrame(rows, "seq long, node_id string, ok boolean, ts_ms long").orderBy(F.desc("seq"))
    breakers, want = {}, {}
    for seq, node, ok, now in rows:
        b = breakers.setdefault(node, health.Breaker())
        if admitted := b.admits(now):
            b.record(ok, now)
        want[seq] = (node, admitted, b.state, b.failures)
    trace = df.select(F.col("node_id").alias("cache"), "seq", F.when(F.col("ok"), "GET").otherwise("SET").alias("op"), (F.col("seq") % 11).cast("string").alias("key"), F.lit(None).cast("long").alias("ttl_ms"), "ts_ms")
    caches, hits = {}, {}
    for seq, node, ok, _ in rows:
        lru = caches.setdefault(node, cache.Lru(4))
        hits[seq] = lru.get(str(seq % 11)) if ok else lru.set(str(seq % 11))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = health.breaker_states(df)
        assert {r["seq"]: tuple(r)[1:] for r in got.collect()} == want
        folded = cache.fold(trace, 4)
        assert {r["seq"]: r["hit"] for r in folded.collect()} == hits
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert not any("FlatMapGroups" in x._jdf.queryExecution().toString() for x in (got, folded))
