"""URL lists by a cascade of Bloom filters.

A list entry is a host, with all its subdomains, and a path prefix. The keys under which a url could be listed are
its host's suffixes joined with its path's prefixes. The first Bloom filter holds the listed keys; the second holds
those keys of the whole corpus that the first wrongly admits; the third holds listed keys that the second admits,
and so on until nothing is left over. A key of the corpus is listed iff the number of filters that admit it, before
the first that does not, is odd: exact for every key the cascade was built over, without a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bloom import Bloom, admitted, build_bloom, hashed
from tessera.llm.common import materialise

ALLOW, BLOCK = "allow", "block"


def host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty if none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty if there is no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def keys(host_col: Column, path_col: Column, depths: list[int], labels: list[int]) -> Column:
    """Keys under which a url may be listed: suffixes of ``labels`` host labels and path prefixes of ``depths`` slashes.

    Only counts that some list entry has are tried, so their number is that of the entries' shapes, not the url's.
    """
    parts = F.split(host_col, r"\.", -1)
    tails = [F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in labels]
    steps = F.split(path_col, "/", -1)
    heads = [F.when(F.size(steps) > d, F.concat(F.array_join(F.slice(steps, 1, d), "/"), F.lit("/"))) for d in depths]
    return F.array_compact(F.array(*[F.concat(t, h) for t in tails for h in heads]))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...]
    exact: bool = True


def build(listed: DataFrame, universe: DataFrame, *, max_bits: int = 1 << 26, max_levels: int = 64) -> Cascade:
    """A cascade for ``listed(key)`` over ``universe(key)``; nulls and repeated keys do not matter.

    The first level's rate is set so that its false positives are about as many as the listed keys; later levels let
    half through. Listed keys outside the universe are kept too. ``max_bits`` bounds every filter, hence what is
    broadcast; a larger list raises ValueError and has to be joined instead.
    """
    listed = materialise(listed.where("key is not null").select("key").distinct())
    n = listed.count()
    if n == 0:
        return Cascade(())
    others = universe.where("key is not null").select("key").distinct().join(listed, "key", "left_anti")
    others = materialise(others)
    m = others.count()
    levels: list[Bloom] = []
    inside, outside, count, rate = listed, others, n, min(0.5, math.sqrt(0.5) * n / max(m, 1))
    while count and len(levels) < max_levels:
        bloom = build_bloom(inside, "key", count, rate, level=len(levels), max_bits=max_bits)
        outside = materialise(admitted(outside, "key", bloom, len(levels)))
        levels.append(bloom)
        # What must not be admitted becomes the next level's content, and the other way round.
        inside, outside, count, rate = outside, inside, outside.count(), 0.5
    if count:
        raise RuntimeError(f"keys left after {max_levels} levels")
    return Cascade(tuple(levels))


def contains(keys_col: Column, cascade: Cascade, session) -> Column:
    """Those of an array's keys that the cascade lists, in the array's order; a null array gives an empty one."""
    shared = session.sparkContext.broadcast(cascade)
    hashes = F.transform(F.coalesce(keys_col, F.array().cast("array<string>")), lambda k: F.array(*[h for i in range(len(cascade.levels)) for h in hashed(k, i)]))
    if not cascade.levels:
        return F.array().cast("array<string>")

    @F.pandas_udf("array<boolean>")
    def listed(batch: pd.Series) -> pd.Series:
        sizes = [len(x) for x in batch]
        rows = [h for x in batch for h in x]
        if not rows:
            return pd.Series([[] for _ in sizes])
        h = np.array([np.asarray(r, dtype=np.int64) for r in rows]).astype(np.uint64)
        passed, alive = np.zeros(len(h), dtype=np.int64), np.ones(len(h), dtype=bool)
        for i, bloom in enumerate(shared.value.levels):
            alive[alive] = bloom.admits(h[alive, 2 * i], h[alive, 2 * i + 1])
            passed += alive
        yes, out, at = passed % 2 == 1, [], 0
        for s in sizes:
            out.append(yes[at : at + s].tolist())
            at += s
        return pd.Series(out)

    return F.transform(F.filter(F.arrays_zip(keys_col.alias("key"), listed(hashes).alias("hit")), lambda x: x["hit"]), lambda x: x["key"])


@dataclass(frozen=True)
class UrlFilter:
    """A cascade for each verdict's list, and the shapes the list entries have."""

    block: Cascade
    allow: Cascade
    depths: list[int]
    labels: list[int]


def fit(urls: DataFrame, rules: DataFrame, *, url_col: str = "url", max_bits: int = 1 << 26) -> UrlFilter:
    """Cascades for ``rules(rule, verdict)`` over all keys of ``urls``.

    A rule is a host, then a path that begins and ends with a slash, such as ``example.org/a/``. Rules of any other
    form, or with a verdict other than allow or block, raise ValueError. A rule both allowed and blocked is blocked.
    """
    rules = rules.where("rule is not null")
    bad = rules.where(~F.col("rule").rlike(r"^[^/?#]+/([^?#]*/)?$") | ~F.coalesce(F.col("verdict"), F.lit("")).isin(ALLOW, BLOCK)).limit(1).collect()
    if bad:
        raise ValueError(f"not a rule: {bad[0]}")
    shapes = rules.select(F.size(F.split(F.substring_index("rule", "/", 1), r"\.")).alias("l"), (F.size(F.split("rule", "/")) - 1).alias("d"))
    shapes = shapes.agg(F.collect_set("l"), F.collect_set("d")).first()
    labels, depths = sorted(shapes[0]), sorted(shapes[1])
    known = urls.select(F.explode(keys(host(F.col(url_col)), path(F.col(url_col)), depths, labels)).alias("key")) if labels else urls.select(F.lit(None).cast("string").alias("key"))
    known = materialise(known.distinct())
    block = rules.where(F.col("verdict") == BLOCK).select(F.col("rule").alias("key"))
    allow = rules.where(F.col("verdict") == ALLOW).select(F.col("rule").alias("key")).join(block, "key", "left_anti")
    return UrlFilter(build(block, known, max_bits=max_bits), build(allow, known, max_bits=max_bits), depths, labels)


def judge(urls: DataFrame, model: UrlFilter, *, url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict``, columns of these names replaced.

    Of the rules that fit a url the longest wins, a block before an allow of the same length; without one, ``rule`` is
    null and the verdict is ``default``. A null url, or one without ``://``, has an empty host and path and no rule.
    """
    url, session = F.col(url_col), urls.sparkSession
    out = urls.withColumn("__h", host(url)).withColumn("__p", path(url))
    if not model.labels:
        return out.withColumns({"host": F.col("__h"), "path": F.col("__p"), "rule": F.lit(None).cast("string"), "verdict": F.lit(default)}).drop("__h", "__p")
    out = out.withColumn("__k", keys(F.col("__h"), F.col("__p"), model.depths, model.labels))
    out = out.withColumn("__b", contains(F.col("__k"), model.block, session)).withColumn("__a", contains(F.col("__k"), model.allow, session))
    tagged = F.concat(
        F.transform("__b", lambda k: F.struct(F.length(k).alias("n"), F.lit(1).alias("first"), k.alias("rule"), F.lit(BLOCK).alias("verdict"))),
        F.transform("__a", lambda k: F.struct(F.length(k).alias("n"), F.lit(0).alias("first"), k.alias("rule"), F.lit(ALLOW).alias("verdict"))),
    )
    out = out.withColumn("__best", F.array_max(tagged))
    return out.withColumns({"host": F.col("__h"), "path": F.col("__p"), "rule": F.col("__best.rule"), "verdict": F.coalesce(F.col("__best.verdict"), F.lit(default))}).drop("__h", "__p", "__k", "__b", "__a", "__best")
