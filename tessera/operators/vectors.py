"""Vector collections: upsert, exact top-k, metadata filters, deletion and statistics."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import metrics

#: Queries that go to every task, in numbers of vector components.
QUERY_BOUND = 1 << 24
#: Scores that a task holds at once.
PAIRS = 1 << 21


def split_valid(batch: DataFrame, dimension: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of a batch ``(id, values, metadata)``.

    A row needs an id and a non-empty vector. All accepted rows must have one dimension, ``dimension`` if given, else
    a ValueError is raised before anything is written.
    """
    ok = F.coalesce((F.col("id").isNotNull()) & (F.col("id").cast("string") != "") & (F.size("values") > 0), F.lit(False))
    good = batch.where(ok)
    dims = [r[0] for r in good.select(F.size("values").alias("d")).distinct().limit(3).collect()]
    if dimension is not None and dims and dims != [dimension] or len(dims) > 1:
        raise ValueError(f"vectors must have dimension {dimension or sorted(dims)[0]}")
    return good, batch.where(~ok)


def upsert(current: DataFrame, batch: DataFrame) -> DataFrame:
    """``id, values, metadata, seq``: the newest row of each id; rows of a batch are in order of ``seq``."""
    new = batch.select("id", "values", F.coalesce("metadata", F.lit("{}")).alias("metadata"), "seq")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))
    return current.select("id", "values", "metadata", "seq").union(new).withColumn("__r", rank).where("__r = 1").drop("__r")


def matches(metadata: Column, wanted: dict | None) -> Column:
    """Whether all wanted members are strictly equal: 1 is not "1", true is not 1, null is not a missing member.

    Objects and arrays never match. ``metadata`` is JSON text. No wanted member matches every row.
    """
    if not wanted:
        return F.lit(True)
    v = F.try_parse_json(metadata)
    out = F.lit(True)
    for k, x in wanted.items():
        got = F.try_variant_get(v, f"$[{json.dumps(k)}]", "variant")
        kind = F.schema_of_variant(got)
        if x is None:
            one = F.is_variant_null(got)
        elif isinstance(x, bool):
            one = (kind == "BOOLEAN") & (F.try_variant_get(got, "$", "boolean") == x)
        elif isinstance(x, (int, float)):
            one = (kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & (F.try_variant_get(got, "$", "double") == float(x))
        elif isinstance(x, str):
            one = (kind == "STRING") & (F.try_variant_get(got, "$", "string") == x)
        else:
            one = F.lit(False)
        out = out & F.coalesce(one, F.lit(False))
    return out


def top_k(
    vectors: DataFrame, query: list[float], k: int = 10, *, metric: str = "cosine", where: dict | None = None, id_col: str = "id", vec_col: str = "values", include_metadata: bool = True, include_values: bool = False, on_mismatch: str = "error"
) -> DataFrame:
    """``id, score`` (and metadata, values) of the ``k`` nearest, best first, ties by id.

    Rows are filtered before they are scored, and each task hands on its own ``k`` best only.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    if not query:
        raise ValueError("a query needs components")
    rows = vectors
    if where:
        rows = rows.where(matches(F.col("metadata"), where)) if "metadata" in vectors.columns else rows.where(F.lit(False))
    value = metrics.score(metric, F.col(vec_col), F.array(*[F.lit(float(x)) for x in query]), on_mismatch) + 0.0
    keep = [F.col(id_col).alias("id"), value.alias("score")]
    keep += [F.col("metadata")] if include_metadata and "metadata" in vectors.columns else []
    keep += [F.col(vec_col).alias("values")] if include_values else []
    return rows.select(*keep).orderBy(F.desc("score"), "id").limit(k)


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, *, metric: str = "cosine", id_col: str = "id", vec_col: str = "values", block: int = 4096) -> DataFrame:
    """``query_id, rank, id, score`` of each query ``(query_id, values)``, ranks from 1.

    The queries go to every task, in parts of at most ``QUERY_BOUND`` components; a task multiplies blocks of at most
    ``block`` vectors with some of them at a time, ``PAIRS`` scores at most, and keeps ``k`` rows a query. Each part is
    one more pass over the vectors.
    """
    return ranked(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("values")), queries, k, metric=metric, block=block)


def ranked(vectors: DataFrame, queries: DataFrame, k: int, *, metric: str, block: int = 4096) -> DataFrame:
    """``top_k_batch`` of ``vectors(id, values)``; with ``vectors.cell_id`` and ``queries.cells``, lists of the cells that
    a query looks into, of the vectors in these cells only."""
    if k < 0:
        raise ValueError("k must not be negative")
    celled = "cell_id" in vectors.columns
    kind = vectors.schema["id"].dataType.simpleString()
    asked = queries.select("query_id", F.col("values").cast("array<double>").alias("values"), *["cells"] * celled)
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("values")), F.lit(0)).alias("d"), F.min(F.size("values")).alias("least")).first()
    if size["n"] and size["least"] != size["d"]:
        raise ValueError("queries must have one dimension")
    qid = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {qid}, id {kind}, score double"
    if not size["n"] or not k:
        return vectors.sparkSession.createDataFrame([], f"query_id {qid}, rank int, id {kind}, score double")
    dims, most = size["d"], max(1, QUERY_BOUND // max(1, size["d"]))
    # Dealt anew: a file's parts may be few and unlike, and each vector costs as many products as there are queries.
    rows = vectors.select("id", F.col("values").cast("array<double>").alias("v"), *["cell_id"] * celled).repartition("id")
    parts, held = [], []
    for row in asked.toLocalIterator():
        held.append(row)
        if len(held) == most:
            parts, held = [*parts, _best(rows, held, k, metric, dims, block, schema)], []
    if held:
        parts.append(_best(rows, held, k, metric, dims, block, schema))
    found = reduce(DataFrame.union, parts).withColumn("score", F.coalesce("score", F.lit(float("nan"))))  # pandas hands NaN on as null
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def _best(rows: DataFrame, part: list, k: int, metric: str, dims: int, block: int, schema: str) -> DataFrame:
    """Each task's ``k`` best of ``rows(id, v)``, or of ``rows(id, v, cell_id)`` in its cells, for each query of ``part``.

    Products of a few queries with a block of vectors pass on what may be among the ``k`` best; these few pairs are
    scored exactly.
    """
    q, names = np.array([r["values"] for r in part], dtype=np.float64).reshape(len(part), dims), pd.Series([r["query_id"] for r in part]).to_numpy()
    askers: dict | None = None
    if "cell_id" in rows.columns:
        cells = np.array([c for r in part for c in r["cells"]], dtype=np.int64)
        at = np.repeat(np.arange(len(part)), [len(r["cells"]) for r in part])[order := np.argsort(cells, kind="stable")]
        found, first = np.unique(cells[order], return_index=True)
        askers = dict(zip(found.tolist(), np.split(at, first[1:])))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranker, best = metrics.Ranker(metric, q), None
        kth, every = np.full(len(q), -np.inf), np.arange(len(q))
        fresh: list[pd.DataFrame] = []
        n = 0

        def settle() -> None:
            nonlocal best, fresh, n
            best = pd.concat([best, *fresh] if best is not None else fresh)
            best = best.sort_values(["q", "score", "id"], ascending=[True, False, True], na_position="first")
            nth = best.groupby("q", sort=False).cumcount().to_numpy()
            best, last = best[nth < k], best[nth == k - 1]
            # If the k-th is NaN, which ranks highest, only NaN can still come in.
            kth[last["q"]] = np.nan_to_num(last["score"].to_numpy(), nan=np.inf, posinf=np.inf, neginf=-np.inf)
            fresh, n = [], 0

        def compare(at: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
            nonlocal n
            right, largest = ranker.right(v)
            step = max(1, PAIRS // len(v))
            for i in range(0, len(at), step):
                some = at[i : i + step]
                s, margin = ranker.products(some, right), ranker.margin(some, largest)
                least = ranker.shifted(some, kth[some])
                if k < len(v) and (new := np.isneginf(least)).any():
                    least[new] = np.nan_to_num(np.partition(s[new], -k, axis=1)[:, -k] - margin[new], nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                x, y = np.nonzero(~(s < (least - margin)[:, None]))  # NaN ranks highest, as in the SQL order
                pairs = max(1, PAIRS // 2 // max(1, dims))
                for j in range(0, len(x), pairs):
                    a, b = some[x[j : j + pairs]], y[j : j + pairs]
                    fresh.append(pd.DataFrame({"q": a, "id": ids[b], "score": metrics.pair_scores(metric, q[a], v[b])}))
                    n += len(a)
                    if n > max(PAIRS // 8, k * len(q)):
                        settle()

        with np.errstate(all="ignore"):
            for p in parts:
                if any(len(x) != dims for x in p["v"]):
                    raise ValueError("vector dimensions differ")
                groups = [(every, p)] if askers is None else [(askers[c], g) for c, g in p.groupby("cell_id") if c in askers]
                for at, g in groups:
                    ids = g["id"].to_numpy()
                    for i in range(0, len(g), block):
                        compare(at, ids[i : i + block], np.stack(g["v"].iloc[i : i + block].to_numpy()))
                        if best is None:
                            settle()
            if fresh:
                settle()
        if best is not None:
            yield best.assign(query_id=names[best["q"]])[["query_id", "id", "score"]]

    return rows.mapInPandas(run, schema)


def shuffled(rows: DataFrame, seed: int, id_col: str = "id") -> DataFrame:
    """The rows in a seeded order by hash, ties by id: a permutation that reruns agree on."""
    return rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col)


def delete(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("id").distinct(), "id", "left_anti")


def deleted_count(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("deleted"))


def stats(vectors: DataFrame, vec_col: str = "values") -> DataFrame:
    """One row: number of vectors and their dimension, null if there are none."""
    return vectors.agg(F.count("*").alias("total_vectors"), F.max(F.size(vec_col)).alias("dimension"))
