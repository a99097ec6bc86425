"""SimHash fingerprints and their neighbours, in DataFrame functions only.

A text's terms are its distinct lower-cased words, weighted by length. Every term's hash votes, with its weight, for
or against each bit. Votes are counted two bits to a long, so a text costs one hash aggregation row.
"""

from __future__ import annotations

import itertools
import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PAIR = (1 << 32) | 1
_LOW = (1 << 32) - 1
#: Words longer than this weigh no more.
HEAVIEST = 12


def terms(text: Column) -> Column:
    """Distinct lower-cased words of a whole text; none for a null or blank one."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", -1)), "")


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, fp_a, fp_b``: the 128 bits of each row's text, as two longs, one row for each combination of keys.

    Rows of equal keys vote together. A bit is set if the terms with it outweigh those without; a text without words
    has no bit set.
    """
    words = rows.select(*keys, F.explode_outer(terms(F.col(text))).alias("__t"))
    words = words.select(*keys, F.xxhash64("__t", F.lit(1)).alias("__a"), F.xxhash64("__t", F.lit(2)).alias("__b"), F.when(F.col("__t").isNull(), 0).otherwise(F.least(F.length("__t"), F.lit(HEAVIEST))).cast("long").alias("__w"))
    votes = [F.sum(F.shiftright(h, i).bitwiseAND(F.lit(_PAIR)) * F.col("__w")).alias(f"{h}{i}") for h in ("__a", "__b") for i in range(32)]
    sums = words.groupBy(*keys).agg(F.sum("__w").alias("__all"), *votes)

    def packed(h: str) -> Column:
        out = F.lit(0).cast("long")
        for i in range(32):
            for count, bit in ((F.col(f"{h}{i}").bitwiseAND(F.lit(_LOW)), i), (F.shiftrightunsigned(f"{h}{i}", 32), i + 32)):
                mask = 1 << bit if bit < 63 else -(1 << 63)
                out = out.bitwiseOR(F.when(2 * count > F.col("__all"), F.lit(mask)).otherwise(F.lit(0).cast("long")))
        return out

    return sums.select(*keys, packed("__a").alias("fp_a"), packed("__b").alias("fp_b"))


def shown(a: Column, b: Column) -> Column:
    """The 128 bits as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def distance(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Hamming distance of (a, b) and (c, d)."""
    return F.bit_count(a.bitwiseXOR(c)) + F.bit_count(b.bitwiseXOR(d))


def likeness(a: Column, b: Column, c: Column, d: Column) -> Column:
    return 1 - distance(a, b, c, d) / F.lit(128.0)


def _longs(values: list[int | None]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def edited_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """Fingerprints of each document, of its edited text and of the next document.

    The edited text keeps the first ``n - floor(n/2)`` code points and takes the rest from the start of the next
    document by ascending id (null first, ties by text), the first one after the last. Columns: ``doc_id, n_chars,
    edited, fp_a, fp_b, edited_a, edited_b, next_a, next_b``. A null text counts as empty; a lone document is its own
    next one; repeated rows follow each other; an empty table stays empty; other columns are not looked at.

    Ids are cut into ``blocks`` ranges of about equal counts (four a shuffle partition); a block also gets a copy of
    the row that follows it. All the rest happens within blocks, after the one shuffle of the texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = rows.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], 20 * blocks)).first()[0] if blocks > 1 else []
    bounds = sorted(set(got or []))
    step = max(1, math.isqrt(len(bounds)))
    coarse = bounds[step - 1 :: step]

    def below(c: Column) -> Column:
        return F.coalesce(F.size(F.filter(c, lambda b: b < F.col("doc_id"))), F.lit(0))

    first = F.when(F.col("doc_id").isNull(), 0).otherwise(below(_longs(coarse)) if coarse else F.lit(0))
    rows = rows.withColumn("__c", first)
    rows = rows.withColumn("__block", (F.col("__c") * step + (F.when(F.col("doc_id").isNull(), 0).otherwise(below(F.slice(_longs(bounds), F.col("__c") * step + 1, F.lit(step)))) if bounds else F.lit(0))).cast("int")).drop("__c")
    heads = rows.groupBy("__block").agg(F.min("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("none")).orderBy("__block").collect()
    if not heads:
        heads = []
    at = {r["__block"]: i for i, r in enumerate(heads)}
    n = len(bounds) + 2
    # By block: the id that comes first in it, and the block before it (the last one's turn comes round again).
    leads = _longs([None if b not in at or heads[at[b]]["none"] else heads[at[b]]["id"] for b in range(n)])
    before = _longs([heads[at[b] - 1]["__block"] if b in at else 0 for b in range(n)])
    is_first = F.col("doc_id").eqNullSafe(F.get(leads, F.col("__block")))
    copies = F.when(is_first, F.array(F.struct(F.col("__block").alias("b"), F.lit(0).alias("ghost")), F.struct(F.get(before, F.col("__block")).cast("int").alias("b"), F.lit(1).alias("ghost")))).otherwise(
        F.array(F.struct(F.col("__block").alias("b"), F.lit(0).alias("ghost")))
    )
    dealt = rows.select("doc_id", "text", F.explode(copies).alias("__x")).select("doc_id", "text", F.col("__x.b").alias("block"), F.col("__x.ghost").alias("ghost"))
    order = Window.partitionBy("block").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    paired = dealt.select("block", "ghost", "doc_id", "text", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("follower"))
    chars = F.length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), chars - half), F.substring(F.coalesce("follower", F.lit("")), F.lit(1), half))
    both = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), edited.alias("t")))
    texts = paired.select("block", "rn", "ghost", "doc_id", chars.alias("n_chars"), F.explode(both).alias("__x"))
    texts = texts.select("block", "rn", "ghost", "doc_id", "n_chars", F.col("__x.which").alias("which"), F.col("__x.t").alias("t"))
    texts = texts.withColumn("sha", F.when(F.col("which") == 1, F.sha2(F.col("t"), 256)))
    prints = fingerprints(texts, ["block", "rn", "ghost", "doc_id", "n_chars", "which", "sha"], "t")
    pick = lambda c, w: F.max(F.when(F.col("which") == w, F.col(c)))
    one = prints.groupBy("block", "rn", "ghost", "doc_id", "n_chars").agg(
        pick("fp_a", 0).alias("fp_a"), pick("fp_b", 0).alias("fp_b"), pick("fp_a", 1).alias("edited_a"), pick("fp_b", 1).alias("edited_b"), pick("sha", 1).alias("edited_sha256")
    )
    turn = Window.partitionBy("block").orderBy("rn")
    out = one.select("*", F.lead("fp_a").over(turn).alias("next_a"), F.lead("fp_b").over(turn).alias("next_b"))
    return out.where("ghost = 0").drop("block", "rn", "ghost")


def _tables(prints: DataFrame, radius: int, spare: int) -> DataFrame:
    """``fp_a, fp_b, key``: each distinct fingerprint in each permuted table, keyed by the table and its bits.

    The 128 bits are cut into ``radius + spare`` blocks. Two fingerprints within the radius agree in at least ``spare``
    of them, so each choice of that many blocks is a table, and one of the tables has the pair.
    """
    n = radius + spare
    if not 1 <= spare <= n <= 64:
        raise ValueError("radius + spare must lie between 1 and 64")
    own = prints.where("fp_a is not null and fp_b is not null").select("fp_a", "fp_b").distinct()
    tables = F.array(*[F.struct(F.lit(k).alias("table"), F.xxhash64(*[_masked(F.col("fp_a"), F.col("fp_b"), m) for m in chosen]).alias("bits")) for k, chosen in enumerate(itertools.combinations(_masks(n), spare))])
    return own.select("fp_a", "fp_b", F.explode(tables).alias("key"))


def _masks(n: int) -> list[tuple[int, int]]:
    """The two longs' masks of each of ``n`` blocks of the 128 bits."""
    edge = [128 * i // n for i in range(n + 1)]
    out = []
    for lo, hi in zip(edge, edge[1:]):
        bits = ((1 << hi) - 1) ^ ((1 << lo) - 1)
        out.append((bits & ((1 << 64) - 1), bits >> 64))
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _masked(a: Column, b: Column, mask: tuple[int, int]) -> Column:
    parts = [c.bitwiseAND(F.lit(_signed(m)).cast("long")) for c, m in zip((a, b), mask) if m]
    return parts[0] if len(parts) == 1 else F.struct(*parts)


def _first_table(x: Column, y: Column, n: int, spare: int) -> Column:
    """The number of the first table in which two fingerprints meet, from the differing bits ``x, y``."""
    equal = []
    for a, b in _masks(n):
        parts = [c.bitwiseAND(F.lit(_signed(m)).cast("long")) == 0 for c, m in ((x, a), (y, b)) if m]
        equal.append(reduce(Column.__and__, parts))
    out = F.lit(None).cast("int")
    for k, chosen in reversed(list(enumerate(itertools.combinations(range(n), spare)))):
        out = F.when(reduce(Column.__and__, [equal[i] for i in chosen]), k).otherwise(out)
    return out


def near_counts(prints: DataFrame, radius: int = 6, *, spare: int = 2, block: int = 256) -> DataFrame:
    """``fp_a, fp_b, n_near``: of each distinct fingerprint, how many other ones lie within ``radius`` bits.

    Every pair is counted in the first permuted table in which it meets. A key's fingerprints are cut into blocks of
    about ``block`` by hash, and each pair of blocks is compared within one row's arrays, so no pair becomes a row and
    no group is larger than two blocks, however many fingerprints share a key. Null fingerprints take no part; an empty
    table gives no rows.
    """
    n = radius + spare
    keyed = _tables(prints, radius, spare)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size >= 2")
    # Merge joins: fingerprints are as many as rows, too many to broadcast through the driver.
    rows = keyed.join(sizes.hint("merge"), "key").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("fp_a", "fp_b", "key.table"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.struct("fp_a", "fp_b")
    groups = rows.groupBy("key", F.least("at", "other").alias("x"), F.greatest("at", "other").alias("y")).agg(
        F.collect_list(F.when(F.col("at") <= F.col("other"), side)).alias("left"), F.collect_list(F.when(F.col("at") >= F.col("other"), side)).alias("right")
    )
    table = F.col("key.table")

    def near(a: Column, b: Column) -> Column:
        x, y = a["fp_a"].bitwiseXOR(b["fp_a"]), a["fp_b"].bitwiseXOR(b["fp_b"])
        bits = F.bit_count(x) + F.bit_count(y)
        return (bits > 0) & (bits <= radius) & (_first_table(x, y, n, spare) == table)

    def counted(some: str, others: str) -> Column:
        found = F.transform(some, lambda a: F.struct(a["fp_a"].alias("fp_a"), a["fp_b"].alias("fp_b"), F.size(F.filter(others, lambda b: near(a, b))).alias("n")))
        return F.filter(found, lambda f: f["n"] > 0)

    # A block with itself has each pair on both sides already.
    both = F.when(F.col("x") == F.col("y"), counted("left", "right")).otherwise(F.concat(counted("left", "right"), counted("right", "left")))
    found = groups.select(F.explode(both).alias("f")).groupBy("f.fp_a", "f.fp_b").agg(F.sum("f.n").alias("n"))
    own = prints.where("fp_a is not null and fp_b is not null").select("fp_a", "fp_b").distinct()
    return own.join(found.toDF("__a", "__b", "n").hint("merge"), (F.col("fp_a") == F.col("__a")) & (F.col("fp_b") == F.col("__b")), "left").select("fp_a", "fp_b", F.coalesce("n", F.lit(0)).cast("long").alias("n_near"))


def near_pairs(prints: DataFrame, radius: int = 6, *, spare: int = 2) -> DataFrame:
    """All pairs of different fingerprints within ``radius`` bits: ``a1, b1, a2, b2, distance`` with (a1, b1) first.

    Pairs meet in the permuted tables. Equal fingerprints are one class beforehand; null ones take no part. The result
    is as large as there are pairs; where many fingerprints are alike, ``near_counts`` has their numbers alone.
    """
    keyed = _tables(prints, radius, spare)
    a, b = keyed.alias("a"), keyed.alias("b")
    before = (F.col("a.fp_a") < F.col("b.fp_a")) | ((F.col("a.fp_a") == F.col("b.fp_a")) & (F.col("a.fp_b") < F.col("b.fp_b")))
    far = distance(F.col("a.fp_a"), F.col("a.fp_b"), F.col("b.fp_a"), F.col("b.fp_b"))
    found = a.join(b, (F.col("a.key") == F.col("b.key")) & before & (far <= radius))
    return found.select(F.col("a.fp_a").alias("a1"), F.col("a.fp_b").alias("b1"), F.col("b.fp_a").alias("a2"), F.col("b.fp_b").alias("b2"), far.alias("distance")).distinct()
