"""Mixing of sources to target weights by capped water-filling.

Every source asks for its weight's share of the mix. A source that would repeat more than ``max_epochs`` times is
clamped there, and what it leaves goes to the others by weight, until no more are above. Whole repetitions take every
document; the fractional one takes documents in the order of a seeded hash until the source's target is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, materialise

#: Hash buckets a source's documents are dealt into; the sampling error is at most one bucket of a source.
BUCKETS = 1 << 14


def word_count(text: Column) -> Column:
    """Number of words of a whole text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: float | None = None, *, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``sources(source, source_size, weight)`` with ``target``.

    ``total`` is the size of the mix; without it, ``share`` times all sizes. Each round clamps every source that is
    above its cap at the current level and lifts the level for the rest; only sums come to the driver. Sources of
    weight 0 or null, and of size 0, get target 0. If all are clamped, the mix stays below ``total``.
    """
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(0.0))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    if total is None:
        total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped_before = 0.0, -1
    while True:
        over = (weight > 0) & (weight * level >= cap)
        got = sources.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~over, weight)), F.lit(0.0)).alias("weight"),
            F.coalesce(F.sum(over.cast("int")), F.lit(0)).alias("n"),
        ).first()
        if got["n"] == clamped_before or got["weight"] <= 0:
            break
        clamped_before, level = got["n"], max(0.0, total - got["held"]) / got["weight"]
    if got["weight"] <= 0:
        level = float("inf")
    return sources.withColumn("target", F.when(weight > 0, F.least(cap, weight * F.lit(level))).otherwise(0.0))


def _unit(id_col: Column, seed: int) -> Column:
    """Bucket of a document, from 32 bits of a digest that other engines know too."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")
    return F.pmod(bits, F.lit(BUCKETS)).cast("int")


def mix(docs: DataFrame, targets: DataFrame, *, seed: int = 4, source_col: str = "source", size_col: str = "size", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``source_size``, ``target``, ``repeats`` and ``taken``, columns of these names replaced.

    ``targets`` holds ``source, source_size, target``, one row each. ``repeats`` is the whole repetitions, plus one
    for documents in the fractional sample: those whose hash bucket comes before the bucket at which the sizes
    gathered, in bucket order, are nearest to what is missing. ``taken`` is ``repeats * size``. The null source is a
    source like any other; a null size counts as 0. Documents of one id and source are taken alike, so repeated rows
    move the sum together; a document larger than all a source needs leaves it out or in, whichever is nearer.
    """
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0))
    own = docs.drop("source_size", "target", "repeats", "taken").withColumn("__bucket", _unit(F.col(id_col), seed)).withColumn("__size", size)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = targets.select(F.col("source").alias("__source"), "source_size", "target", F.floor(ratio).alias("__whole"), (F.col("target") - F.floor(ratio) * F.col("source_size")).alias("__rest"))
    # Sizes by source and bucket: at most BUCKETS rows a source, summed before the shuffle.
    sums = own.groupBy(F.col(source_col).alias("__s"), "__bucket").agg(F.sum("__size").alias("__n"))
    packed = sums.groupBy("__s").agg(F.sort_array(F.collect_list(F.struct("__bucket", "__n"))).alias("__by"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("cut"), F.lit(float("inf")).alias("off"))
    empty = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("cut"), F.abs(F.col("__rest")).alias("off"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["sum"] + x["__n"]
        off = F.abs(F.col("__rest") - total)
        return F.struct(total.alias("sum"), F.when(off < acc["off"], x["__bucket"]).otherwise(acc["cut"]).alias("cut"), F.least(off, acc["off"]).alias("off"))

    cuts = goal.join(packed, F.col("__source").eqNullSafe(F.col("__s")), "left").withColumn(
        "__cut", F.aggregate("__by", F.coalesce(empty, start), step, lambda a: a["cut"])
    )
    # A row a source, written out so that the join below stands alone: broadcast if small, else split where it is hot.
    cuts = materialise(cuts.select("__source", "source_size", "target", "__whole", F.coalesce("__cut", F.lit(-1)).alias("__cut")))
    out = own.join(cuts, F.col(source_col).eqNullSafe(F.col("__source")), "left")
    repeats = (F.col("__whole") + (F.col("__bucket") <= F.col("__cut")).cast("long")).cast("long")
    return out.withColumn("repeats", repeats).withColumn("taken", F.col("repeats") * F.col("__size")).drop("__bucket", "__size", "__source", "__whole", "__cut")


def sources_of(docs: DataFrame, *, source_col: str = "source", size_col: str = "size") -> DataFrame:
    """``source, source_size`` of each source, summed before the shuffle."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.col(size_col).cast("long"), F.lit(0))).alias("source_size"))


def cycled_weights(sources: DataFrame, weights: list[float]) -> DataFrame:
    """``sources`` with ``weight``: the given ones in turn, by code point order of the source, null last.

    The ranking sees one row a source.
    """
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
