"""Bloom filters built by aggregation, of a bounded size."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bloom:
    bits: np.ndarray = field(repr=False)
    size: int
    hashes: int

    def admits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), dtype=bool)
        for i in range(self.hashes):
            at = (a + np.uint64(i) * b) % np.uint64(self.size)
            out &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def hashed(key: Column, level: int = 0) -> list[Column]:
    """Two hashes a level; the second is odd, so its multiples reach many places."""
    return [F.xxhash64(key, F.lit(2 * level)).alias("a"), F.xxhash64(key, F.lit(2 * level + 1)).bitwiseOR(F.lit(1)).alias("b")]


def bits_needed(n: int, rate: float) -> tuple[int, int]:
    k = max(1, round(-math.log2(rate)))
    return max(64, math.ceil(n * k / math.log(2))), k


def build_bloom(members: DataFrame, key: str, n: int, rate: float, *, level: int = 0, max_bits: int = 1 << 26, fit: bool = False) -> Bloom:
    """A filter over ``n`` distinct keys; only set words, at most ``max_bits / 64`` of them, come to the driver.

    Where ``rate`` needs more bits than ``max_bits``, that is an error, or with ``fit`` the rate gives way.
    """
    size, k = bits_needed(n, rate)
    if fit and size > max_bits:
        size, k = max_bits, max(1, round(max_bits / n * math.log(2)))
    if size > max_bits:
        raise ValueError(f"a filter of {size} bits is needed, more than max_bits={max_bits}")

    def positions(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            x, y = p["a"].to_numpy().astype(np.uint64), p["b"].to_numpy().astype(np.uint64)
            at = np.unique(np.concatenate([(x + np.uint64(i) * y) % np.uint64(size) for i in range(k)]))
            if not len(at):
                continue
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.left_shift(np.uint64(1), at & np.uint64(63))
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            yield pd.DataFrame({"word": word[first], "mask": np.bitwise_or.reduceat(bit, first).astype(np.int64)})

    words = members.select(*hashed(F.col(key), level)).mapInPandas(positions, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    bits = np.zeros(size // 64 + 1, dtype=np.uint64)
    bits[words["word"].to_numpy(dtype=np.int64)] = words["mask"].to_numpy(dtype=np.int64).astype(np.uint64)
    return Bloom(bits, size, k)


def may_hold(bloom: Bloom, key: Column, spark: SparkSession, level: int = 0) -> Column:
    """Whether the filter admits a key; a null key is one like any other."""
    shared = spark.sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def admits(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(shared.value.admits(a.to_numpy().astype(np.uint64), b.to_numpy().astype(np.uint64)))

    return admits(*hashed(key, level))


def admitted(frame: DataFrame, key: str, bloom: Bloom, level: int = 0) -> DataFrame:
    """The rows whose key the filter admits."""
    return frame.where(may_hold(bloom, F.col(key), frame.sparkSession, level))


def narrowed(frame: DataFrame, key: str, wanted: DataFrame, wanted_key: str, *, max_bits: int = 1 << 26) -> DataFrame:
    """``frame`` without most of the rows whose key is not in ``wanted``, ahead of a join that drops the rest.

    The filter takes at most ``max_bits`` (8 MB), whatever the size. It admits one in 50 of the other keys while there
    are 7.7 million wanted ones or fewer, and more from there on; at 100 million it admits half.
    """
    n = max(wanted.count(), 1)
    return admitted(frame, key, build_bloom(wanted, wanted_key, n, 0.02, max_bits=max_bits, fit=True))
