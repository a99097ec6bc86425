"""Retrieval over documents kept as store values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import metrics, text


def chunk(docs: DataFrame, size: int = 40, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, chunk, text``: groups of ``size`` words, numbered from 0."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(text.chunks(F.col(text_col), size)).alias("chunk", "text"))


def documents(state: DataFrame, prefix: str | None = None) -> DataFrame:
    """``key, text, embedding, metadata`` of the document values whose key begins with the prefix."""
    rows = state if not prefix else state.where(F.col("key").startswith(prefix))
    return rows.select("key", text.decode_document(F.col("value")).alias("__d")).where(F.col("__d").isNotNull()).select("key", "__d.text", "__d.embedding", "__d.metadata")


def query(state: DataFrame, embedding: list[float], k: int = 5, prefix: str | None = None) -> DataFrame:
    """``key, text, score`` of the ``k`` nearest documents by cosine over the shorter length, ties by key."""
    if k < 0:
        raise ValueError("k must not be negative")
    asked = F.array(*[F.lit(float(x)) for x in embedding]) if embedding else F.array().cast("array<double>")
    scored = documents(state, prefix).select("key", "text", (metrics.cosine(F.col("embedding"), asked, "truncate") + 0.0).alias("score"))
    return scored.orderBy(F.desc("score"), "key").limit(k)


def answer(hits: DataFrame) -> DataFrame:
    """One row: the texts of the hits, best first, a line each."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "key", "text")))
    return hits.agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("answer"))
