import hashlib

from pyspark.sql import functions as F

from tessera.config import ReplicationConfig, RingConfig
from tessera.functions.hashing import code_unit_hash, ring_hash
from tessera.operators import replicas, ring


def test_golden_hashes(spark):
    rows = spark.createDataFrame([("global",), ("user:42",), ("😀a",), ("",)], "k string").select("k", ring_hash(F.col("k")).alias("r"), code_unit_hash(F.col("k")).alias("h")).collect()
    assert [r["h"] for r in rows] == [1243020381, 147170163, 54959966, 0]
    assert all(r["r"] == int(hashlib.sha1(r["k"].encode()).hexdigest()[:8], 16) for r in rows)
    first = ring.vnodes(ring.nodes(spark)).where("node_id = 'node-1' and vnode = 0").first()
    assert first["hash"] == 1784018086


def sample(spark, n=10_000):
    return spark.range(n).select(F.concat(F.lit("sample_key_"), F.col("id").cast("string")).alias("key"))


def test_golden_distribution(spark):
    n = ring.nodes(spark)
    got = {r[0]: r[1] for r in ring.distribution(ring.place(sample(spark), ring.vnodes(n), 450), n).collect()}
    assert got == {"node-1": 2883, "node-2": 3784, "node-3": 3333}


def test_removing_a_node_moves_only_its_keys(spark):
    all_, two = ring.vnodes(ring.nodes(spark)), ring.vnodes(ring.nodes(spark, RingConfig(nodes=RingConfig().nodes[:2])))
    got = ring.moved(sample(spark, 2000), all_, two).collect()
    assert got and {r["node_before"] for r in got} == {"node-3"}


def test_no_or_one_healthy_node(spark):
    none = ring.vnodes(ring.nodes(spark, unhealthy=("node-1", "node-2", "node-3")))
    assert {r["node_id"] for r in ring.place(sample(spark, 50), none).collect()} == {None}
    one = ring.vnodes(ring.nodes(spark, unhealthy=("node-1", "node-2")))
    assert {r["node_id"] for r in ring.place(sample(spark, 50), one).collect()} == {"node-3"}


REPLICAS = "node_id string, is_healthy boolean, is_master boolean, replication_lag long, synced_ops long, insert_ord int"


def test_membership_fold(spark):
    rows = spark.createDataFrame([("a", True, True, 0, 0, 0), ("b", True, False, 0, 3, 1), ("c", True, False, 0, 3, 2)], REPLICAS)
    masters = lambda events: {r["node_id"] for r in replicas.fold_membership(rows, events).collect() if r["is_master"] and r["is_healthy"]}
    assert masters([]) == {"a"}
    assert masters([("unhealthy", "a")]) == {"b"}
    assert masters([("unhealthy", "a"), ("unhealthy", "a"), ("healthy", "a")]) == {"b"}
    assert masters([("remove", "a"), ("remove", "b")]) == {"c"}


def test_selection_without_candidates_and_log_trim(spark):
    rows = spark.createDataFrame([("a", False, True, 0, 0, 0)], REPLICAS)
    got = replicas.select_replicas(spark.createDataFrame([("k", "a"), (None, None)], "key string, node_id string"), rows).collect()
    assert [r["targets"] for r in got] == [[], []] and got[1]["key_hash"] == 1243020381
    size = 0
    for i in range(1, 3000):
        size += 1
        size = 500 if size > 1000 else size
        assert replicas.trimmed_size(i, ReplicationConfig()) == size
