"""Inverted-file index over vectors: training, assignment, search, recall."""

from __future__ import annotations

import json
import time
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import IvfConfig
from tessera.functions import metrics
from tessera.operators import vectors as exact


#: Components of all centroids, and scores against them that a task holds at once.
CENTROID_BOUND, SCORES = 1 << 25, 1 << 22


@dataclass(frozen=True)
class Ivf:
    """Centroids in order of their cell numbers, and ``postings(cell_id, id, values)``."""

    config: IvfConfig
    centroids: np.ndarray
    postings: DataFrame | None = None

    def __post_init__(self):
        if self.centroids.size > CENTROID_BOUND:
            raise ValueError("centroids take more than their bound of 2^25 components")

    @property
    def dimension(self) -> int:
        return self.centroids.shape[1]

    def checked(self, dims: int) -> None:
        if not len(self.centroids):
            raise RuntimeError("the index is not trained")
        if dims != self.dimension:
            raise ValueError(f"vectors must have dimension {self.dimension}")


def seeds(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of the smallest hashes of id and seed, ties by id."""
    rows = vectors.select("id", F.col("values").cast("array<double>").alias("v"), F.xxhash64("id", F.lit(seed)).alias("h")).orderBy("h", "id").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.float64)


def gathered(rows: DataFrame) -> np.ndarray:
    """The vectors of the one column of ``rows``, in its order: all of them, or an error beyond the bound of centroids."""
    out, size = [], 0
    for (v,) in rows.toLocalIterator():
        out.append(np.array(v, dtype=np.float64))
        if (size := size + len(v)) > CENTROID_BOUND:
            raise ValueError("centroids take more than their bound of 2^25 components")
    return np.array(out)


def nearest(metric: str, vectors: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """Numbers of the ``n`` nearest centroids, ties to the lowest."""
    step, out = max(1, SCORES // max(1, len(centroids))), []
    for i in range(0, max(1, len(vectors)), step):
        far = -metrics.block_scores(metric, vectors[i : i + step], centroids)
        if n == 1 and far.size:
            out.append(np.where(np.isnan(far), np.inf, far).argmin(axis=1)[:, None])
        else:
            out.append(np.argsort(far, axis=1, kind="stable")[:, :n])
    return np.concatenate(out)


def assign(vectors: DataFrame, centroids: np.ndarray, metric: str = "l2", block: int = 4096) -> DataFrame:
    """``cell_id, id, values`` with the nearest centroid's number."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for i in range(0, len(p), block):
                part = p.iloc[i : i + block]
                cell = nearest(metric, np.stack(part["values"].to_numpy()), centroids)[:, 0]
                yield pd.DataFrame({"cell_id": cell.astype(np.int32), "id": part["id"], "values": part["values"]})

    return vectors.select("id", F.col("values").cast("array<double>").alias("values")).mapInPandas(run, f"cell_id int, id {kind}, values array<double>")


def lloyd_step(vectors: DataFrame, centroids: np.ndarray, metric: str = "l2") -> DataFrame:
    """``cell_id, n, total``: sums of each cell's vectors, added up within tasks before the shuffle."""
    dims = centroids.shape[1]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
        for p in parts:
            for i in range(0, len(p), 4096):
                v = np.stack(p["v"].iloc[i : i + 4096].to_numpy())
                cell = nearest(metric, v, centroids)[:, 0]
                np.add.at(total, cell, v)
                n += np.bincount(cell, minlength=len(n))
        if n.any():  # a task without rows has nothing to give, and an empty column of lists has no type
            yield pd.DataFrame({"cell_id": np.flatnonzero(n).astype(np.int32), "n": n[n > 0], "total": list(total[n > 0])})

    parts = vectors.select(F.col("values").cast("array<double>").alias("v")).mapInPandas(run, "cell_id int, n long, total array<double>")
    sums = [F.sum(F.get("total", F.lit(d))).alias(f"s{d}") for d in range(dims)]
    return parts.groupBy("cell_id").agg(F.sum("n").alias("n"), *sums).select("cell_id", "n", F.array(*[f"s{d}" for d in range(dims)]).alias("total"))


def train(vectors: DataFrame, config: IvfConfig = IvfConfig(), sample: int | None = None) -> Ivf:
    """Lloyd's iterations from hashed seeds.

    There are ``min(nlist, rows)`` cells. An empty cell keeps its centroid; training stops when no centroid moves by
    more than 1e-10 squared. Means are in double precision, and normalised if the configuration says so. ``sample``
    trains on about that many rows of the smallest hashes. Vectors ``(id, values)`` are indexed afterwards.
    """
    n = vectors.count()
    if not n:
        raise ValueError("training needs vectors")
    dims = [r[0] for r in vectors.select(F.size("values")).distinct().limit(2).collect()]
    if len(dims) != 1:
        raise ValueError("vectors must have one dimension")
    rows = vectors if sample is None or sample >= n else vectors.where(F.pmod(F.xxhash64("id", F.lit(config.seed + 1)), F.lit(1 << 40)) < int(sample / n * (1 << 40)))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)  # every iteration reads it
    centroids = seeds(rows, min(config.nlist, n), config.seed)
    for _ in range(config.max_iter):
        new = centroids.copy()
        for r in lloyd_step(rows, centroids, config.metric).toLocalIterator():
            mean = np.array(r["total"]) / r["n"]
            size = np.linalg.norm(mean)
            new[r["cell_id"]] = mean / size if config.normalize and size > 0 else mean
        moved = ((new - centroids) ** 2).sum(1).max()
        centroids = new
        if moved <= 1e-10:
            break
    rows.unpersist()
    return Ivf(config, centroids, assign(vectors, centroids, config.metric))


def retrain(index: Ivf, sample: int | None = None) -> Ivf:
    """A new index over the vectors that the postings hold, trained from the start with the same configuration."""
    return train(index.postings.select("id", "values"), index.config, sample)


def brute_force(index: Ivf, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, id, score``: exact search over all that the postings hold, whatever their cell."""
    return exact.top_k_batch(index.postings.select("id", "values"), queries, k, metric=index.config.metric)


def add(index: Ivf, vectors: DataFrame) -> Ivf:
    """Rows of ids that are there already replace them, whatever their cell."""
    new = assign(vectors, index.centroids, index.config.metric)
    old = index.postings.join(vectors.select("id").distinct(), "id", "left_anti").select("cell_id", "id", "values") if index.postings is not None else None
    return Ivf(index.config, index.centroids, new if old is None else old.union(new))


def remove(index: Ivf, ids: DataFrame) -> Ivf:
    return Ivf(index.config, index.centroids, index.postings.join(ids.select("id").distinct(), "id", "left_anti").select("cell_id", "id", "values"))


def asked_cells(index: Ivf, queries: DataFrame, nprobe: int | None = None) -> DataFrame:
    """``query_id, values, cells``: the cells each query looks into, nearest first, at most as many as there are."""
    n = max(0, min(index.config.nprobe if nprobe is None else nprobe, len(index.centroids)))
    qid = queries.schema["query_id"].dataType.simpleString()
    centroids, metric = index.centroids, index.config.metric

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if not len(p):
                continue
            v = np.stack(p["values"].to_numpy())
            if v.shape[1] != centroids.shape[1]:
                raise ValueError("vector dimensions differ")
            yield p.assign(cells=list(nearest(metric, v, centroids, n).astype(np.int32)) if n else [[]] * len(p))

    return queries.select("query_id", F.col("values").cast("array<double>").alias("values")).mapInPandas(run, f"query_id {qid}, values array<double>, cells array<int>")


def probes(index: Ivf, queries: DataFrame, nprobe: int | None = None) -> DataFrame:
    """``query_id, qv, cell_id``: a row for each cell that a query looks into."""
    return asked_cells(index, queries, nprobe).select("query_id", F.col("values").alias("qv"), F.explode("cells").alias("cell_id"))


def search(index: Ivf, queries: DataFrame, k: int = 10, nprobe: int | None = None) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` best of the probed cells, ties by id.

    With as many probes as cells this is the exact search. Tasks multiply blocks of a cell's vectors with the queries
    that look into the cell, as in ``vectors.top_k_batch``; a large cell is dealt to all tasks.
    """
    if not len(index.centroids) or index.postings is None:
        raise RuntimeError("the index is not trained")
    return exact.ranked(index.postings.select("cell_id", "id", "values"), asked_cells(index, queries, nprobe), k, metric=index.config.metric)


def status(index: Ivf) -> DataFrame:
    """``cell_id, size`` of every cell."""
    spark = index.postings.sparkSession
    sizes = index.postings.groupBy("cell_id").agg(F.count("*").alias("n"))
    cells = spark.range(len(index.centroids)).select(F.col("id").cast("int").alias("cell_id"))
    return cells.join(sizes, "cell_id", "left").select("cell_id", F.coalesce("n", F.lit(0)).cast("long").alias("size"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: ``macro``, the mean over queries of hits / max(true, 1), and ``micro``, all hits / all true."""
    hits = truth.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    per = hits.groupBy("query_id").agg(F.count("hit").alias("hits"), F.count("*").alias("n"))
    return per.agg(F.avg(F.col("hits") / F.greatest("n", F.lit(1))).alias("macro"), (F.sum("hits") / F.sum("n")).alias("micro"))


def benchmark(index: Ivf, queries: DataFrame, k: int = 10, nprobe: int | None = None) -> dict[str, float | None]:
    """Milliseconds a query of the exact and the probed search, how many times faster the latter is (None if it took
    no time), and its macro and micro recall."""
    n = max(queries.count(), 1)

    def timed(action) -> tuple[list, float]:
        began = time.perf_counter()
        return action(), (time.perf_counter() - began) * 1000 / n

    truth, exact_ms = timed(lambda: brute_force(index, queries, k).collect())
    found, ivf_ms = timed(lambda: search(index, queries, k, nprobe).collect())
    want: dict = {r["query_id"]: set() for r in truth}
    for r in truth:
        want[r["query_id"]].add(r["id"])
    hits = Counter(r["query_id"] for r in found if r["id"] in want.get(r["query_id"], ()))
    macro = sum(hits[q] / max(len(ids), 1) for q, ids in want.items()) / max(len(want), 1)
    micro = sum(hits.values()) / max(len(truth), 1)
    return {"exact_ms_per_query": exact_ms, "ivf_ms_per_query": ivf_ms, "speedup": exact_ms / ivf_ms if ivf_ms else None, "recall_macro": macro, "recall_at_10": micro}


def save(index: Ivf, path: str) -> None:
    """``centroids``, ``postings`` (partitioned by cell, so a probe prunes) and ``meta`` below ``path``."""
    spark = index.postings.sparkSession
    c = index.config
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(index.centroids)], "cell_id int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    index.postings.repartition("cell_id").write.mode("overwrite").partitionBy("cell_id").parquet(f"{path}/postings")
    spark.createDataFrame([(json.dumps({"nlist": len(index.centroids), "nprobe": c.nprobe, "metric": c.metric, "normalize": c.normalize}),)], "value string").write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Ivf:
    """The saved index; the number of iterations is not kept, and ``nlist`` is the number of centroids."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell_id").collect()
    return Ivf(IvfConfig(**meta), np.array([r["centroid"] for r in rows]), spark.read.parquet(f"{path}/postings").select("cell_id", "id", "values"))
