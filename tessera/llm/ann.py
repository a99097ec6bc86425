"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected at random to a few dimensions, shifted, and ordered along a Hilbert curve; several such
orderings are made, and Spark range-partitions each. A query meets the rows in a window around its place in every
ordering; the windows' finds are merged and ranked by exact distance. Equal vectors are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise


@dataclass(frozen=True)
class Curves:
    """Projections (dims x low) of each curve, with the offset and scale that put their values into the unit cube."""

    projections: tuple[np.ndarray, ...]
    low: tuple[np.ndarray, ...]
    span: tuple[np.ndarray, ...]
    shift: tuple[np.ndarray, ...]
    bits: int


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers below ``2**bits`` (Skilling's transform)."""
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(dims):
            on = (x[i] & bit) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(on, below, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], dtype=np.uint64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] & np.uint64(1 << level)) != 0, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= flip
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(level)) & np.uint64(1))
    return key.astype(np.int64)


def usable(vectors: DataFrame, vec_col: str, dims: int | None = None) -> DataFrame:
    """Rows whose vector is not null, not zero, and holds neither nulls nor non-finite components."""
    v = F.col(vec_col)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(good, F.lit(False)) & (F.lit(True) if dims is None else F.size(v) == dims))


def fit(vectors: DataFrame, vec_col: str, dims: int, *, curves: int = 6, low: int = 8, bits: int = 7, seed: int = 1, sample: int = 20_000) -> Curves:
    """Random curves; ranges come from at most about ``sample`` vectors, hashed (further values are clipped)."""
    rng = np.random.default_rng(seed)
    low = min(low, dims)
    projections = [np.linalg.qr(rng.normal(size=(dims, dims)))[0][:, :low] for _ in range(curves)]
    n = vectors.count()
    part = min(1.0, sample / max(n, 1))
    got = vectors.where(F.pmod(F.xxhash64(F.col(vec_col), F.lit(seed)), F.lit(1 << 40)) <= int(part * (1 << 40))).select(vec_col).limit(2 * sample).toPandas()[vec_col]
    seen = np.array([np.asarray(v, dtype=np.float64) for v in got]).reshape(-1, dims)
    places = [seen @ p for p in projections]
    lows = [y.min(0) if len(y) else np.zeros(low) for y in places]
    spans = [np.maximum(np.ptp(y, axis=0) if len(y) else np.ones(low), 1e-12) for y in places]
    return Curves(tuple(projections), tuple(lows), tuple(spans), tuple(rng.random(low) for _ in range(curves)), bits)


def _keys(model: Curves, v: np.ndarray) -> np.ndarray:
    out = []
    top = (1 << model.bits) - 1
    for p, low, span, shift in zip(model.projections, model.low, model.span, model.shift):
        unit = np.clip((v @ p - low) / span, 0, 1)
        out.append(hilbert_keys(np.floor((unit + shift) / 2 * top).astype(np.int64), model.bits))
    return np.stack(out, 1)


def classes(vectors: DataFrame, id_col: str, vec_col: str, keep: int) -> DataFrame:
    """``cls, vec, ids``: distinct vectors with their ``keep`` smallest ids; ``cls`` is the smallest.

    The ids are cut to ``keep`` within each task before the shuffle, so a vector that a third of all rows have costs
    no more than another.
    """
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).distinct().select("id", "vec", rank.alias("r")).where(F.col("r") <= keep)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("cls"), "vec", "ids")


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` from 0 in the order of ``curve, key, cls``, range-partitioned; each curve by itself."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, "curve", "key", "cls").sortWithinPartitions("curve", "key", "cls")
    placed = materialise(placed.withColumn("__at", F.monotonically_increasing_id()))
    pid = F.shiftright("__at", 33)
    counts = placed.groupBy(pid.alias("pid"), "curve").agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("curve").orderBy("pid")) - F.col("n")  # a row a partition and curve
    starts = counts.select("curve", F.col("pid").alias("__pid"), "first", before.alias("before"))
    return placed.join(starts.withColumnRenamed("curve", "__c"), (pid == F.col("__pid")) & (F.col("curve") == F.col("__c"))).withColumn("rank", F.col("__at") - F.col("first") + F.col("before")).drop("__at", "__pid", "__c", "first", "before")


def search(
    vectors: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", curves: int = 6, low: int = 8, bits: int = 7, window: float = 0.14, block: int = 2048, most_asked: int = 20_000, seed: int = 1
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest found, nearest first, ties to the smaller id.

    ``queries`` are rows of ``vectors``; a query's own id is no candidate. ``score`` is the Euclidean distance of the
    original vectors in double precision. A window reaches ``window`` times the number of distinct vectors to either
    side, so recall is alike at every size; half or more searches every row. Vectors that are null or zero, or hold a
    null or non-finite component, take no part as row or query, nor do those of another dimension than most have.
    Repeated rows of one id and vector count once; two vectors under one id are two candidates. An empty table gives
    no rows; other columns are not looked at.

    A task holds one block of vectors and at most about ``most_asked`` queries: more queries are dealt into parts by
    hash, and each block is scanned once for each part.
    """
    good = usable(vectors.select(id_col, vec_col).where(F.col(id_col).isNotNull()), vec_col)
    shape = good.groupBy(F.size(vec_col).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = shape["d"]
    good = good.where(F.size(vec_col) == dims)
    own = materialise(classes(good, id_col, vec_col, k + 1))
    n = own.count()
    model = fit(own, "vec", dims, curves=curves, low=low, bits=bits, seed=seed)

    def keyed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if not len(p):
                continue
            v = np.array([np.asarray(x, dtype=np.float64) for x in p["vec"]])
            keys = _keys(model, v)
            for c in range(keys.shape[1]):
                yield pd.DataFrame({"curve": np.int32(c), "key": keys[:, c], "cls": p["cls"], "vec": p["vec"]})

    placed = own.select("cls", "vec").mapInPandas(keyed, "curve int, key long, cls long, vec array<double>")
    ranked = materialise(_ranked(placed).withColumn("block", F.floor(F.col("rank") / block)))
    asked = usable(queries.select(id_col, vec_col).where(F.col(id_col).isNotNull()), vec_col, dims).select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).alias("vec")).distinct()
    # A query stands where its vector's class stands; equal queries search once.
    asked = materialise(asked.join(own.select("cls", "vec"), "vec").select("query_id", "cls"))
    parts = max(1, -(-asked.count() // most_asked))
    reach = max(k + 1, int(np.ceil(window * n)))
    at = ranked.join(asked.select("cls").distinct(), "cls").select("curve", "rank", F.col("cls").alias("q"), "vec")
    lo, hi = F.greatest(F.col("rank") - reach, F.lit(0)), F.least(F.col("rank") + reach, F.lit(n - 1))
    spread = at.select(F.col("curve").alias("at_curve"), "q", F.col("vec").alias("qv"), lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(F.floor(lo / block), F.floor(hi / block))).alias("at_block"))
    spread = spread.withColumn("at_part", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int"))

    def scan(key: tuple, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        q, cls, dist = [], [], []
        if len(rows) and len(asks):
            v, r, c = np.array(rows["vec"].tolist()), rows["rank"].to_numpy(), rows["cls"].to_numpy()
            for qid, qv, a, b in zip(asks["q"], asks["qv"], asks["lo"], asks["hi"]):
                inside = np.flatnonzero((r >= a) & (r <= b))
                d = np.sqrt(((v[inside] - np.asarray(qv)) ** 2).sum(1))
                best = inside[order := np.lexsort((c[inside], d))[: k + 1]]
                q += [qid] * len(best)
                cls += c[best].tolist()
                dist += d[order].tolist()
        return pd.DataFrame({"q": np.array(q, np.int64), "cls": np.array(cls, np.int64), "score": np.array(dist, np.float64)})

    blocks = ranked.select("curve", "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "rank", "cls", "vec")
    found = blocks.groupBy("curve", "block", "part").cogroup(spread.groupBy("at_curve", "at_block", "at_part")).applyInPandas(scan, "q long, cls long, score double")
    top = Window.partitionBy("q").orderBy("score", "cls")
    near = found.groupBy("q", "cls").agg(F.min("score").alias("score")).withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
    # Each class gives its smallest ids; a query then drops its own.
    ids = near.join(own.select("cls", "ids"), "cls").select("q", "score", F.explode("ids").alias("vec_id"))
    first = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    lists = ids.select("q", F.struct("score", "vec_id").alias("x"), first.alias("r")).where(F.col("r") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    out = asked.join(lists, asked["cls"] == lists["q"]).select("query_id", F.slice(F.filter("xs", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("xs"))
    return out.select("query_id", F.posexplode("xs").alias("i", "x")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").cast("long").alias("vec_id"), F.col("x.score").alias("score"))
