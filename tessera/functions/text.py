"""Text and codec helpers of retrieval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOCUMENT = "text STRING, embedding ARRAY<DOUBLE>, metadata STRING"


def words(text: Column) -> Column:
    """Words between any Unicode white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+", -1), lambda w: w != "")


def chunks(text: Column, size: int = 40) -> Column:
    """Groups of up to ``size`` words, each joined by single blanks; a text without words gives none."""
    if size < 1:
        raise ValueError("size must be at least 1")

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(size))
        return F.filter(F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(size)), " ")), lambda c: c != "")

    # Bound by a lambda, the words are split once a text and not once a chunk.
    return F.element_at(F.transform(F.array(words(text)), cut), 1)


def encode_document(text: Column, embedding: Column, metadata: Column) -> Column:
    """A document as the JSON text of a store value; ``metadata`` is JSON text itself, null as an empty object."""
    return F.to_json(F.struct(text.alias("text"), embedding.cast("array<double>").alias("embedding"), F.coalesce(metadata, F.lit("{}")).alias("metadata")))


def decode_document(value: Column) -> Column:
    """The struct of a document value; null for values of any other form."""
    got = F.from_json(value, DOCUMENT)
    return F.when(got["embedding"].isNotNull(), got)


def decode_value(value: Column) -> Column:
    """A JSON value as its own text: strings lose their quotes, anything that is not JSON stays as it is."""
    quoted = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    return F.when(value.rlike(r'^\s*"'), F.coalesce(quoted, value)).otherwise(value)
