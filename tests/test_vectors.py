import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.config import IvfConfig
from tessera.functions import metrics
from tessera.operators import ivf, vectors
from tessera.plans import fixtures, registry

ROWS = "id long, values array<double>, metadata string, seq long"


def data(spark, n=60, d=6, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    return v, spark.createDataFrame([(i, [float(x) for x in v[i]], '{"label": %d}' % (i % 3), 0) for i in range(n)], ROWS)


@pytest.mark.parametrize("metric", metrics.METRICS)
def test_single_and_batch_agree_with_numpy(spark, metric):
    v, df = data(spark)
    want = np.argsort(-metrics.block_scores(metric, v[:2], v), axis=1, kind="stable")[:, :7]
    got = vectors.top_k_batch(df, df.where("id < 2").select(F.col("id").alias("query_id"), "values"), 7, metric=metric).orderBy("query_id", "rank").collect()
    assert [r["id"] for r in got] == want.ravel().tolist()
    assert [r["id"] for r in vectors.top_k(df, v[1].tolist(), 7, metric=metric).collect()] == want[1].tolist()


def test_k_zero_beyond_and_negative(spark):
    v, df = data(spark, 5)
    assert vectors.top_k(df, v[0].tolist(), 0).count() == 0 and vectors.top_k(df, v[0].tolist(), 99).count() == 5
    assert vectors.top_k_batch(df, df.select(F.col("id").alias("query_id"), "values").limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        vectors.top_k(df, v[0].tolist(), -1)


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0], None, 0) for i in (5, 3, 9)], ROWS)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, values array<double>")
    assert [r["id"] for r in vectors.top_k_batch(df, q, 2).orderBy("rank").collect()] == [3, 5]


def test_cosine_variants(spark):
    df = spark.createDataFrame([([1.0, 0.0, 2.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(metrics.cosine(F.col("a"), F.col("b"), "zero")).collect()] == [0.0, 0.0]
    assert abs(df.select(metrics.cosine(F.col("a"), F.col("b"), "truncate")).first()[0] - 1 / 5**0.5) < 1e-12
    with pytest.raises(Exception, match="dimensions"):
        df.select(metrics.cosine(F.col("a"), F.col("b"))).collect()


@pytest.mark.parametrize("wanted,ids", [({"a": 1}, [0, 4]), ({"a": "1"}, [1]), ({"a": True}, [2]), ({"a": None}, [3]), ({"b": None}, []), ({"a": 1, "b": "x"}, [4]), ({}, [0, 1, 2, 3, 4, 5, 6]), ({"a": [1]}, [])])
def test_filters_are_strict(spark, wanted, ids):
    meta = ['{"a": 1}', '{"a": "1"}', '{"a": true}', '{"a": null}', '{"a": 1.0, "b": "x"}', '{"a": [1]}', None]
    df = spark.createDataFrame([(i, [1.0], m, 0) for i, m in enumerate(meta)], ROWS)
    assert sorted(r["id"] for r in df.where(vectors.matches(F.col("metadata"), wanted)).collect()) == ids


def test_upsert_delete_validation(spark):
    _, df = data(spark, 4)
    batch = spark.createDataFrame([(1, [0.0] * 6, None, 2), (1, [9.0] * 6, None, 3), (None, [1.0] * 6, None, 4), (7, [], None, 5)], ROWS)
    good, bad = vectors.split_valid(batch, 6)
    assert good.count() == 2 and bad.count() == 2
    got = {r["id"]: r for r in vectors.upsert(df, good).collect()}
    assert len(got) == 4 and got[1]["values"][0] == 9.0 and got[1]["metadata"] == "{}"
    with pytest.raises(ValueError):
        vectors.split_valid(batch, 5)
    ids = spark.createDataFrame([(1,), (1,), (77,)], "id long")
    assert vectors.delete(df, ids).count() == 3 and vectors.deleted_count(df, ids).first()[0] == 1
    assert vectors.stats(df.limit(0)).first().asDict() == {"total_vectors": 0, "dimension": None}


def test_ivf_full_probe_is_exact_and_round_trips(spark, tmp_path):
    v, df = data(spark, 80)
    index = ivf.train(df, IvfConfig(nlist=8, nprobe=3, max_iter=6))
    q = df.where("id < 5").select(F.col("id").alias("query_id"), "values")
    exact = vectors.top_k_batch(df, q, 5, metric="l2")
    ids = lambda d: [(r["query_id"], r["rank"], r["id"]) for r in d.orderBy("query_id", "rank").collect()]
    assert ids(ivf.search(index, q, 5, nprobe=99)) == ids(exact)
    assert ivf.recall(ivf.search(index, q, 5, nprobe=8), exact).first()["macro"] == 1.0
    assert ivf.search(index, q, 5, nprobe=0).count() == 0
    assert sum(r["size"] for r in ivf.status(index).collect()) == 80
    ivf.save(index, str(tmp_path))
    again = ivf.load(spark, str(tmp_path))
    assert ids(ivf.search(again, q, 5)) == ids(ivf.search(index, q, 5)) and again.config.nlist == 8
    moved = ivf.add(index, df.where("id = 3").select("id", F.transform("values", lambda x: x + 50).alias("values")))
    assert moved.postings.where("id = 3").count() == 1 and moved.postings.count() == 80
    assert ivf.remove(index, df.where("id < 10").select("id")).postings.count() == 70
    with pytest.raises(ValueError):
        ivf.train(df.limit(0))


def test_lloyd_matches_numpy(spark):
    v, df = data(spark, 50)
    index = ivf.train(df, IvfConfig(nlist=4, max_iter=1))
    c = ivf.seeds(df, 4, IvfConfig().seed)
    cell = ivf.nearest("l2", v, c)[:, 0]
    assert np.allclose(index.centroids, [v[cell == i].mean(0) if (cell == i).any() else c[i] for i in range(4)])


def test_more_queries_than_one_part_holds(spark, small, monkeypatch):
    df = fixtures.vectors(spark, small)
    queries = df.where("id % 20 = 0").select(F.col("id").alias("query_id"), "values")
    whole = {tuple(r) for r in vectors.top_k_batch(df, queries, 5).collect()}
    monkeypatch.setattr(vectors, "QUERY_BOUND", 64 * 10)
    got = vectors.top_k_batch(df, queries, 5).collect()
    assert len(got) == 5 * queries.count() == 125
    assert {(r["query_id"], r["rank"], r["id"]) for r in got} == {r[:3] for r in whole}


def test_index_over_empty_partitions(spark):
    rows = [(i, [float(i % 5), float(i % 3) + 1]) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, values array<double>").repartition(20)
    index = ivf.train(df, IvfConfig(nlist=3, nprobe=3))
    q = spark.createDataFrame([(0, [1.0, 1.0])], "query_id long, values array<double>")

    def near(found):
        return [(r["id"], round(r["score"], 9)) for r in found.orderBy("rank").collect()]

    assert near(ivf.search(index, q, 12)) == near(ivf.brute_force(index, q, 12)) and len(index.centroids) == 3
    assert sorted(map(tuple, ivf.retrain(index).centroids)) == sorted(map(tuple, index.centroids))


def test_benchmark_and_shuffle(spark):
    v, df = data(spark, 40)
    index = ivf.train(df.select("id", "values"), IvfConfig(nlist=4, nprobe=4))
    got = ivf.benchmark(index, df.where("id < 5").select(F.col("id").alias("query_id"), "values"), 3)
    assert got["recall_macro"] == got["recall_at_10"] == 1 and got["speedup"] > 0
    a, b = ([r["id"] for r in vectors.shuffled(df, s).collect()] for s in (1, 2))
    assert a != b and sorted(a) == sorted(b) == list(range(40)) and a == [r["id"] for r in vectors.shuffled(df.repartition(5), 1).collect()]


@pytest.mark.parametrize("metric", metrics.METRICS)
def test_copies_of_a_vector_tie_and_small_blocks_agree(spark, monkeypatch, metric):
    """Equal vectors rank by id wherever they stand in a block; a task holds few scores at once."""
    v, _ = data(spark, 90, 7)
    v[30:] = v[np.arange(60) % 6]
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(90)], "id long, values array<double>")
    queries = df.where("id < 25").select(F.col("id").alias("query_id"), "values")
    near = metrics.pair_scores(metric, np.repeat(v[:25], 90, axis=0), np.tile(v, (25, 1))).reshape(25, 90)
    want = np.argsort(-near, axis=1, kind="stable")[:, :12]
    most, whole = [], metrics.Ranker.products
    monkeypatch.setattr(vectors, "PAIRS", 64)
    got = vectors.top_k_batch(df, queries, 12, metric=metric, block=16).orderBy("query_id", "rank").collect()
    assert [r["id"] for r in got] == want.ravel().tolist()
    assert [r["score"] for r in got] == np.take_along_axis(near, want, 1).ravel().tolist()
    monkeypatch.setattr(metrics.Ranker, "products", lambda self, at, right: most.append(len(at) * right.shape[1]) or whole(self, at, right))
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, run, schema: spark.createDataFrame(pd.concat(run([self.toPandas()])), schema))
    assert [r["id"] for r in vectors.top_k_batch(df, queries, 12, metric=metric, block=16).orderBy("query_id", "rank").collect()] == want.ravel().tolist()
    assert max(most) <= 64


def test_nan_ranks_first_and_hides_nothing(spark):
    rows = [(0, [float("nan"), 1.0]), (1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, values array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, values array<double>")
    for metric in ("dot", "l2"):
        want = [r["id"] for r in vectors.top_k(df, [1.0, 0.0], 3, metric=metric).collect()]
        assert [r["id"] for r in vectors.top_k_batch(df, q, 3, metric=metric).orderBy("rank").collect()] == want == [0, 1, 2]


def test_search_multiplies_blocks_and_agrees_with_pairs(spark, small):
    """No row for each pair of a query and a vector of its cells, and the scores of such rows."""
    index, queries = registry._fixed_index(spark, small), fixtures.vec_queries(spark, small)
    found = ivf.search(index, queries, 5)
    assert "Join" not in found._jdf.queryExecution().toString()
    pairs = ivf.probes(index, queries).join(index.postings, "cell_id")
    score = metrics.score("l2", F.col("values"), F.col("qv"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    want = pairs.select("query_id", "id", score.alias("score")).withColumn("rank", rank).where("rank <= 5")
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in want.select("query_id", "rank", "id", "score").collect()}


def test_index_has_a_cell_for_each_of_many_labels(spark, tmp_path, monkeypatch):
    rows = [(i, [float(i % 1100), float(i % 7)], i % 1100) for i in range(1300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sizes = {r["cell_id"]: r["size"] for r in registry.ivf_status(spark, str(tmp_path)).collect()}
    assert len(sizes) == 1100 and sum(sizes.values()) == 1300
    monkeypatch.setattr(ivf, "CENTROID_BOUND", 100)
    with pytest.raises(ValueError, match="bound"):
        registry._fixed_index(spark, str(tmp_path))


def test_nearest_in_small_parts(monkeypatch):
    rng = np.random.default_rng(3)
    v, c = rng.normal(size=(50, 4)), rng.normal(size=(9, 4))
    whole = [ivf.nearest(m, v, c, n) for m in metrics.METRICS for n in (1, 3)]
    monkeypatch.setattr(ivf, "SCORES", 20)
    assert all(np.array_equal(a, b) for a, b in zip(whole, [ivf.nearest(m, v, c, n) for m in metrics.METRICS for n in (1, 3)]))
    assert np.array_equal(whole[1][:, :1], whole[0])
