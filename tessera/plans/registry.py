"""Registered queries of the store's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import IvfConfig, ReplicationConfig, RingConfig
from tessera.functions import text
from tessera.operators import cache, health, ivf, latency, lsm, rag, replicas, ring, state, vectors
from tessera.plans import fixtures as fx
from tessera.plans.oracles import ORACLES  # noqa: F401
from tessera.sources.log import append_kv_lines, read_kv_lines

QUERIES: dict = {}
LRU_CAPACITY = 50


def query(f):
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 0.0, 6) + 0.0 for c in cols})


# --- key-value store


@query
def kv_replay_state(spark: SparkSession, sf: str) -> DataFrame:
    return state.replay(fx.kv_log(spark, sf))


@query
def kv_ttl_live_keys(spark: SparkSession, sf: str) -> DataFrame:
    return state.keys(fx.kv_log(spark, sf), fx.AS_OF)


@query
def kv_get_batch(spark: SparkSession, sf: str) -> DataFrame:
    asked = fx.trace(spark, sf).select("seq", F.when(F.col("seq") % 7 == 0, F.concat("key", F.lit(":none"))).otherwise(F.col("key")).alias("key"))
    return state.get_batch(asked, state.replay(fx.kv_log(spark, sf), fx.AS_OF))


@query
def kv_exists_batch(spark: SparkSession, sf: str) -> DataFrame:
    return state.exists_batch(fx.keys(spark, sf), state.replay(fx.kv_log(spark, sf), fx.AS_OF))


@query
def kv_delete_existed(spark: SparkSession, sf: str) -> DataFrame:
    return state.delete_outcomes(fx.kv_log(spark, sf, clears=True))


@query
def kv_lines_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The log written as JSON lines, read back and replayed."""
    path = fx.work_dir(spark)
    append_kv_lines(fx.kv_log(spark, sf).orderBy("seq"), path)
    return state.replay(read_kv_lines(spark, path), fx.AS_OF).select("key", "value", "ts_ms")


@query
def kv_clear_barrier(spark: SparkSession, sf: str) -> DataFrame:
    return state.replay(fx.kv_log(spark, sf, clears=True)).select("key", "value", "seq")


@query
def kv_store_stats(spark: SparkSession, sf: str) -> DataFrame:
    return state.stats(fx.kv_log(spark, sf))


@query
def kv_key_distribution(spark: SparkSession, sf: str) -> DataFrame:
    n, r = fx.three_nodes(spark)
    live = state.keys(fx.kv_log(spark, sf), fx.AS_OF)
    return ring.key_lists(ring.place(live, r, 450), n).select("node_id", "key_count", F.array_join("keys", ",").alias("keys"))


@query
def kv_access_counts(spark: SparkSession, sf: str) -> DataFrame:
    return cache.access_counts(fx.trace(spark, sf), LRU_CAPACITY)


# --- ring


@query
def ring_vnodes(spark: SparkSession, sf: str) -> DataFrame:
    return fx.three_nodes(spark)[1].select("node_id", "vnode", "hash")


@query
def ring_place_keys(spark: SparkSession, sf: str) -> DataFrame:
    return ring.place(fx.keys(spark, sf), fx.three_nodes(spark)[1], 450)


@query
def ring_distribution_sample(spark: SparkSession, sf: str) -> DataFrame:
    n, r = fx.three_nodes(spark)
    sample = spark.range(10_000).select(F.concat(F.lit("sample_key_"), F.col("id").cast("string")).alias("key"))
    return ring.distribution(ring.place(sample, r, 450), n)


@query
def ring_failover(spark: SparkSession, sf: str) -> DataFrame:
    return ring.place(fx.keys(spark, sf), fx.three_nodes(spark, ("node-2",))[1], 450)


@query
def ring_moved_keys(spark: SparkSession, sf: str) -> DataFrame:
    four = ring.vnodes(ring.nodes(spark, fx.FOUR_NODES))
    return ring.moved(fx.keys(spark, sf), fx.three_nodes(spark)[1], four, 450, 600)


@query
def ring_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ring.ring_stats(fx.three_nodes(spark, ("node-2",))[1])


@query
def ring_remove_node(spark: SparkSession, sf: str) -> DataFrame:
    """The keys that move once node-2 is taken away."""
    left = RingConfig(nodes=tuple(n for n in RingConfig().nodes if n[0] != "node-2"))
    return ring.moved(fx.keys(spark, sf), fx.three_nodes(spark)[1], ring.vnodes(ring.nodes(spark, left)), 450, 300)


# --- replication


def _ops(spark: SparkSession, sf: str) -> DataFrame:
    return ring.place(fx.kv_log(spark, sf), fx.three_nodes(spark)[1], 450)


@query
def replica_select(spark: SparkSession, sf: str) -> DataFrame:
    got = replicas.select_replicas(ring.place(fx.keys(spark, sf), fx.three_nodes(spark)[1], 450), fx.replicas(spark))
    return got.select("key", "node_id", "key_hash", F.array_join("targets", ",").alias("targets"))


@query
def replica_sync_stats(spark: SparkSession, sf: str) -> DataFrame:
    return replicas.sync_stats(replicas.op_log(_ops(spark, sf), fx.replicas(spark)), fx.replicas(spark), fx.AS_OF)


@query
def replica_stats(spark: SparkSession, sf: str) -> DataFrame:
    log = replicas.op_log(_ops(spark, sf), fx.replicas(spark))
    return _rounded(replicas.replication_stats(log, replicas.sync_stats(log, fx.replicas(spark), fx.AS_OF), ReplicationConfig()), "average_lag")


@query
def replica_recent_ops(spark: SparkSession, sf: str) -> DataFrame:
    return replicas.recent(replicas.op_log(_ops(spark, sf), fx.replicas(spark)), 10).select("seq", "op", "key", "node_id", "ts_ms", "replica_count")


@query
def replica_promote_master(spark: SparkSession, sf: str) -> DataFrame:
    return replicas.promote(fx.replicas(spark)).select("node_id", "synced_ops")


@query
def replica_log_trim(spark: SparkSession, sf: str) -> DataFrame:
    return replicas.trimmed(replicas.op_log(_ops(spark, sf), fx.replicas(spark))).select("seq", "op", "key")


@query
def replica_membership(spark: SparkSession, sf: str) -> DataFrame:
    """A replica comes, the master fails, another goes, two recover; and how many masters were promoted."""
    events = [("add", "node-5"), ("unhealthy", "node-1"), ("remove", "node-3"), ("healthy", "node-4"), ("healthy", "node-1")]
    got = replicas.fold_membership(fx.replicas(spark), events)
    return got.withColumn("failovers", F.lit(replicas.failovers(fx.replicas(spark), events)).cast("long"))


# --- LRU cache


@query
def lru_access_trace(spark: SparkSession, sf: str) -> DataFrame:
    return cache.access_trace(fx.trace(spark, sf), LRU_CAPACITY)


@query
def lru_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(cache.hit_rates(fx.trace(spark, sf), [10, 50, 100]), "hit_rate")


@query
def lru_keys_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return cache.keys_in_order(fx.trace(spark, sf), LRU_CAPACITY)


@query
def lru_with_deletes(spark: SparkSession, sf: str) -> DataFrame:
    log = _ops(spark, sf).select(F.col("node_id").alias("cache"), "seq", F.when(F.col("seq") % 3 == 0, "GET").otherwise(F.col("op")).alias("op"), "key", "ttl_ms", "ts_ms")
    return cache.fold(log, LRU_CAPACITY)


# --- vectors


def _top(spark: SparkSession, sf: str, metric: str) -> DataFrame:
    got = vectors.top_k(fx.vectors(spark, sf), fx.query_vector(spark, sf), 10, metric=metric, include_metadata=False)
    return _rounded(got, "score")


@query
def vec_topk_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, "cosine")


@query
def vec_topk_dot(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, "dot")


@query
def vec_topk_l2(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, "l2")


@query
def vec_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(vectors.top_k_batch(fx.vectors(spark, sf), fx.vec_queries(spark, sf), 5), "score")


@query
def vec_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(vectors.top_k(fx.vectors(spark, sf), fx.query_vector(spark, sf), 5, where={"label": 3}), "score")


@query
def vec_topk_values(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors instead of metadata beside the scores."""
    got = vectors.top_k(fx.vectors(spark, sf), fx.query_vector(spark, sf), 10, metric="dot", include_metadata=False, include_values=True)
    return _rounded(got.select("id", "score", F.size("values").alias("dimension"), F.get("values", F.lit(0)).alias("first")), "score", "first")


@query
def vec_upsert(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.vectors(spark, sf)
    new = v.where("id % 3 = 0").select("id", F.transform("values", lambda x: -x).alias("values"), F.lit(None).cast("string").alias("metadata"), F.lit(1).cast("long").alias("seq"))
    got = vectors.upsert(v.withColumn("seq", F.lit(0).cast("long")), new)
    return _rounded(got.select("id", F.get("values", F.lit(0)).alias("first"), "metadata", "seq"), "first")


@query
def vec_delete_ids(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.vectors(spark, sf)
    ids = v.where("id % 5 = 0").select("id").union(v.where("id % 10 = 0").select("id"))
    return vectors.stats(vectors.delete(v, ids)).withColumn("deleted", vectors.deleted_count(v, ids).scalar())


@query
def vec_stats(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.stats(fx.vectors(spark, sf))


# --- inverted-file index


def _fixed_index(spark: SparkSession, sf: str) -> ivf.Ivf:
    """Cells around the mean vector of each label."""
    e = fx.table(spark, sf, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "x"))
    means = e.groupBy("label", "d").agg(F.avg("x").alias("x")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v")).orderBy("label")
    centroids = ivf.gathered(means.select("v.x"))
    v = fx.vectors(spark, sf)
    return ivf.Ivf(IvfConfig(nlist=len(centroids), nprobe=3), centroids, ivf.assign(v, centroids))


@query
def ivf_assign(spark: SparkSession, sf: str) -> DataFrame:
    return _fixed_index(spark, sf).postings.select("id", "cell_id")


@query
def ivf_status(spark: SparkSession, sf: str) -> DataFrame:
    return ivf.status(_fixed_index(spark, sf))


@query
def ivf_train_step(spark: SparkSession, sf: str) -> DataFrame:
    index = _fixed_index(spark, sf)
    step = ivf.lloyd_step(fx.vectors(spark, sf), index.centroids)
    return _rounded(step.select("cell_id", "n", F.posexplode("total").alias("d", "x")).withColumn("x", F.col("x") / F.col("n")), "x")


@query
def ivf_train(spark: SparkSession, sf: str) -> DataFrame:
    return ivf.status(ivf.train(fx.vectors(spark, sf), IvfConfig(nlist=16, max_iter=5)))


@query
def ivf_search(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ivf.search(_fixed_index(spark, sf), fx.vec_queries(spark, sf), 5), "score")


@query
def ivf_recall(spark: SparkSession, sf: str) -> DataFrame:
    q = fx.vec_queries(spark, sf)
    truth = vectors.top_k_batch(fx.vectors(spark, sf), q, 10, metric="l2")
    return _rounded(ivf.recall(ivf.search(_fixed_index(spark, sf), q, 10), truth), "macro", "micro")


@query
def ivf_remove(spark: SparkSession, sf: str) -> DataFrame:
    return ivf.status(ivf.remove(_fixed_index(spark, sf), fx.vectors(spark, sf).where("id % 4 = 0")))


@query
def ivf_add(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors added to an index that has the even ones, in the wrong cell."""
    full = _fixed_index(spark, sf)
    wrong = full.postings.where("id % 2 = 0").withColumn("cell_id", F.lit(0))
    return ivf.add(ivf.Ivf(full.config, full.centroids, wrong), fx.vectors(spark, sf)).postings.select("id", "cell_id")


@query
def ivf_brute_force(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ivf.brute_force(_fixed_index(spark, sf), fx.vec_queries(spark, sf), 5), "score")


@query
def ivf_save_load(spark: SparkSession, sf: str) -> DataFrame:
    path = fx.work_dir(spark)
    ivf.save(_fixed_index(spark, sf), path)
    again = ivf.load(spark, path)
    return again.postings.select("id", "cell_id", F.round(F.get("values", F.lit(0)) + 0.0, 6).alias("first"))


# --- segments


@query
def lsm_segment_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return lsm.manifest(fx.mem_entries(spark, sf))


@query
def lsm_segment_read(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.mem_entries(spark, sf)
    return lsm.read(e, e.where("cast(id as long) % 3 = 0").select("id")).select("id", "segment_ord", "seq", "metadata", "tombstone")


@query
def lsm_compact(spark: SparkSession, sf: str) -> DataFrame:
    return lsm.compact(fx.mem_entries(spark, sf)).select("id", "segment_ord", "seq", "metadata")


@query
def lsm_compact_stats(spark: SparkSession, sf: str) -> DataFrame:
    return lsm.compact_stats(fx.mem_entries(spark, sf))


@query
def lsm_manager_trace(spark: SparkSession, sf: str) -> DataFrame:
    return lsm.manager_trace(fx.mem_entries(spark, sf))


@query
def lsm_memtable(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.mem_entries(spark, sf).select("seq", F.when(F.col("tombstone"), "delete").otherwise("upsert").alias("type"), "id", "vector", "metadata")
    return lsm.memtable(log).select("id", "metadata", "seq", "tombstone")


# --- fault tolerance


@query
def health_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return health.health_transitions(fx.node_calls(spark, sf))


@query
def breaker_states(spark: SparkSession, sf: str) -> DataFrame:
    return health.breaker_states(fx.node_calls(spark, sf))


@query
def partitioned_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls while their node is cut off: node-2 for ten days, node-3 for as long as is usual."""
    day = 86_400_000
    cut = spark.createDataFrame([("node-2", fx.AS_OF - 20 * day, 10 * day), ("node-3", fx.AS_OF - 5 * day, None)], "node_id string, ts_ms long, duration_ms long")
    return health.under_partition(fx.node_calls(spark, sf).select("seq", "node_id", "ts_ms"), health.partition_events(cut)).select("seq", "node_id", "partitioned")


@query
def retry_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return health.retry_schedule(spark)


@query
def node_health(spark: SparkSession, sf: str) -> DataFrame:
    return health.node_health(fx.node_calls(spark, sf), ring.nodes(spark, RingConfig()))


@query
def ft_stats(spark: SparkSession, sf: str) -> DataFrame:
    calls = fx.node_calls(spark, sf)
    retries = calls.agg(F.count(F.when(~F.col("ok"), 1))).scalar()
    recoveries = health.health_transitions(calls).where("is_healthy").agg(F.count("*")).scalar()
    got = health.fault_stats(health.node_health(calls, ring.nodes(spark, RingConfig())), health.breaker_states(calls), retries, recoveries)
    return _rounded(got, "average_response_ms", "error_rate")


@query
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(latency.percentiles(fx.table(spark, sf, "events"), "value"), "mean", "p50", "p95", "p99")


# --- retrieval


@query
def rag_chunk(spark: SparkSession, sf: str) -> DataFrame:
    return rag.chunk(fx.table(spark, sf, "documents").select("doc_id", "text"))


@query
def rag_doc_codec(spark: SparkSession, sf: str) -> DataFrame:
    got = rag.documents(fx.rag_state(spark, sf))
    return got.select("key", F.md5("text").alias("text_md5"), F.size("embedding").alias("dimension"), "metadata")


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return rag.query(fx.rag_state(spark, sf), fx.query_vector(spark, sf, 7), 5, "doc:1")


@query
def rag_prefix_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_hits(spark, sf).select("key", F.md5("text").alias("text_md5"), "score"), "score")


@query
def rag_answer(spark: SparkSession, sf: str) -> DataFrame:
    return rag.answer(_hits(spark, sf))


@query
def kv_value_codec(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "events").select("event_id", text.decode_value(F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.to_json(F.array("event_type")).substr(F.lit(2), F.length("event_type") + 2)).otherwise(F.col("event_type"))).alias("value"))
