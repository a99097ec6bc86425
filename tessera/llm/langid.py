"""Language identification by compression.

A language is a raw-content zstandard dictionary built from a bounded sample of its texts. A text is cut into
blocks, every block (lower-cased, its digits and marks blanked) is compressed with every dictionary, and the language with the smallest total wins. The cut
keeps the text's own history from drowning the dictionary; every block of a text counts, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release

UND = "und"
_LETTER = regex.compile(r"\p{L}")
#: Digits, marks and control characters tell no language: each becomes a blank.
_PLAIN = bytes(b if b >= 0x80 or bytes([b]).isalpha() else 0x20 for b in range(256))


def plain(text: str) -> bytes:
    """Lower-cased UTF-8 with blanks for all ASCII characters but letters."""
    return text.lower().encode("utf-8", "replace").translate(_PLAIN)


@dataclass(frozen=True)
class LanguageModel:
    """Dictionary bytes by language, in code point order of the languages."""

    dictionaries: tuple[tuple[str, bytes], ...]
    block: int = 4096
    level: int = 6
    short: int = 1024
    short_level: int = 12


def train(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_language: int = 96,
    chars_per_doc: int = 1200,
    max_languages: int = 256,
    seed: int = 9,
    block: int = 4096,
    level: int = 6,
) -> LanguageModel:
    """Build one dictionary per language from at most ``docs_per_language`` texts of it.

    The sample's bound is ``docs_per_language * chars_per_doc * max_languages`` characters: the documents of a
    language with the smallest seeded hashes of id and text, and of each a slice at a hashed place. Repeated rows count
    once; a null id is one like any other. Rows whose text or
    language is null, or whose text is empty, teach nothing. More than ``max_languages`` languages raise ValueError.
    No labelled row at all gives a model without languages, which predicts ``und`` for every text.
    """
    text, lang = F.col(text_col), F.col(lang_col).cast("string")
    rows = docs.where(text.isNotNull() & lang.isNotNull() & (F.length(text) > 0)).select(
        lang.alias("lang"), F.xxhash64(F.col(id_col), text, F.lit(seed)).alias("h"), text.alias("text")
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return LanguageModel((), block, level)
    # Each language is thinned to twice its quota by hash, so no language's rows meet in one task.
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2.0 * docs_per_language + 20) / max(n, 1)))])
    unit = F.pmod(F.col("h"), F.lit(1 << 40)) / float(1 << 40)
    start = F.pmod(F.shiftright("h", 20), F.greatest(F.lit(1), F.length("text") - chars_per_doc + 1)).cast("int") + 1
    picked = rows.where(unit < share[F.col("lang")]).select("lang", unit.alias("u"), "h", F.col("text").substr(start, F.lit(chars_per_doc)).alias("s"))
    picked = picked.groupBy("lang", "u", "h").agg(F.min("s").alias("s"))
    by: dict[str, list[tuple[float, str]]] = {}
    for r in picked.collect():
        by.setdefault(r["lang"], []).append((r["u"], r["s"]))
    return LanguageModel(
        tuple((k, b" ".join(plain(s) for _, s in sorted(by[k])[:docs_per_language])) for k in sorted(by)), block, level
    )


def _compressors(model: LanguageModel, level: int) -> list[zstandard.ZstdCompressor]:
    out = []
    for _, raw in model.dictionaries:
        # A dictionary shorter than 8 bytes is refused by the library; such a language compresses without one.
        if len(raw) < 8:
            out.append(zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False))
            continue
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


class Sizer:
    """Compressed size of whole texts under each language; short ones at a level that also finds short matches."""

    def __init__(self, model: LanguageModel):
        self.block, self.short = model.block, model.short
        self.by_level = {k: _compressors(model, k) for k in (model.level, model.short_level)}
        self.levels = model.level, model.short_level

    def __call__(self, text: str) -> np.ndarray:
        raw = plain(text)
        compressors = self.by_level[self.levels[len(raw) <= self.short]]
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in compressors], dtype=np.float64)


def decide(total: np.ndarray, temperature: float = 0.01) -> tuple[int, float, float]:
    """Index of the smallest size (ties to the first), its margin over the second, and a score from 0 to 1."""
    best = int(total.argmin())
    if len(total) == 1:
        return best, 1.0, 1.0
    rest = np.delete(total, best)
    return best, float((rest.min() - total[best]) / rest.min()), float(1 / (1 + np.exp(-(rest - total[best]) / (temperature * total[best])).sum()))


def identify(text: Column, model: LanguageModel, *, min_margin: float = 0.001) -> Column:
    """Struct ``lang, score, margin, rejected`` of each whole text.

    A null text, an empty one and one without a letter get ``und``, score 0, margin 0 and are rejected. A text whose
    two best languages differ by less than ``min_margin`` of the size keeps its best guess and is rejected. Equal
    sizes go to the language first by code point.
    """
    names = [k for k, _ in model.dictionaries]

    @F.pandas_udf("lang string, score double, margin double, rejected boolean")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sizes = Sizer(model)
        for part in parts:
            out = []
            for t in part:
                if t is None or not names or not _LETTER.search(t):
                    out.append((UND, 0.0, 0.0, True))
                    continue
                best, margin, score = decide(sizes(t))
                out.append((names[best], score, margin, margin < min_margin))
            yield pd.DataFrame(out, columns=["lang", "score", "margin", "rejected"])
        release()

    return scored(text)


def identify_languages(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", min_margin: float = 0.001) -> DataFrame:
    """``docs`` with ``lang_pred, lang_score, lang_margin, lang_rejected``; columns of these names are replaced.

    Every row stays, repeated ones too; an empty table stays empty.
    """
    got = docs.withColumn("__lang", identify(F.col(text_col), model, min_margin=min_margin))
    return got.withColumns({f"lang_{k}": F.col(f"__lang.{v}") for k, v in (("pred", "lang"), ("score", "score"), ("margin", "margin"), ("rejected", "rejected"))}).drop("__lang")
