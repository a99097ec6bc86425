"""Toxicity by a weighted finite-state pattern grammar.

A trie of weighted words and stems, some given and most learned, finds insults and threats. Only the clauses around
them are read, by one machine composed of five small transducers: insult, threat, target, negation and reported
speech. The first two give weight to a clause, the others change what is given: an insult counts in full beside
another one, more if it is aimed at a target and less by itself; a threat hardly counts before its target comes.
A document's score follows from its clauses.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

# The given words of each symbol, in English, German, French and Spanish.
INSULTS = "idiot moron stupid scum loser pathetic worthless disgusting trash clown dumb trottel abschaum dummkopf connard imbécile ordure estúpido imbécil basura".split()
THREATS = "kill murder destroy hurt beat töten umbringen vernichten tuer détruire frapper matar destruir golpear".split()
TARGETS = "you your yours he she they them him her these those du dich dein ihr euch sie tu toi vous ton ils elles tú usted ustedes ellos ellas".split()
NEGATIONS = "not no never neither nor without nicht kein keine nie niemals ne pas jamais non nunca jamás sin".split()
REPORTS = "said says say told wrote quoted claims claimed called reported sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split()

_CLAUSE = re.compile(r"[.!?;:\n]")
_TOKEN = re.compile(r"[^\W\d_]+")
SYMBOLS = PLAIN, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
NAMES = ("", "insult", "threat", "target", "negation", "report")
#: How many tokens an insult, a threat, a target and a negation reach.
REACH = 3


def _insult(state: int, symbol: int) -> tuple[int, float]:
    """Four fifths of an insult's weight if it stands alone, all of it within reach of another; a target after it adds 0.5."""
    if symbol == INSULT:
        return REACH, 1.0 if state else 0.8
    return max(0, state - 1) if symbol != TARGET else 0, 0.5 if symbol == TARGET and state else 0.0


def _threat(state: int, symbol: int) -> tuple[int, float]:
    """A fifth of a threat's weight until its target follows within reach, which adds 2."""
    if symbol == THREAT:
        return REACH, 0.2
    return max(0, state - 1) if symbol != TARGET else 0, 2.0 if symbol == TARGET and state else 0.0


def _target(state: int, symbol: int) -> tuple[int, float]:
    """Half as much again for insults and threats that follow a target within reach."""
    if symbol == TARGET:
        return REACH, 1.0
    return max(0, state - 1), 1.5 if symbol in (INSULT, THREAT) and state else 1.0


def _negation(state: int, symbol: int) -> tuple[int, float]:
    """Damps what is given within reach of a negation."""
    if symbol == NEGATION:
        return REACH, 1.0
    return max(0, state - 1), 0.3 if state else 1.0


def _report(state: int, symbol: int) -> tuple[int, float]:
    """Damps what is given after a verb of reported speech, to the end of the clause."""
    return int(state or symbol == REPORT), 0.5 if state else 1.0


def compose() -> tuple[list[list[int]], list[list[float]]]:
    """The product of the transducers: next state and weight by state and symbol, state 0 at a clause's start.

    What insult and threat give is added, and multiplied by what the other three say.
    """
    parts, sizes = (_insult, _threat, _target, _negation, _report), (REACH + 1,) * 4 + (2,)
    states = list(itertools.product(*map(range, sizes)))
    number = {s: i for i, s in enumerate(states)}
    go, weight = [], []
    for s in states:
        moves = [[f(x, symbol) for f, x in zip(parts, s)] for symbol in SYMBOLS]
        go.append([number[tuple(m[0] for m in row)] for row in moves])
        weight.append([(row[0][1] + row[1][1]) * math.prod(m[1] for m in row[2:]) for row in moves])
    return go, weight


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of whole words and of stems; slope and intercept of the score."""

    words: dict[str, float]
    stems: dict[str, float]
    slope: float = 2.0
    intercept: float = -3.0


class Grammar:
    """The trie and the composed machine of a model."""

    def __init__(self, model: ToxicityModel):
        import ahocorasick

        self.words, self.stems = model.words, model.stems
        self.lengths = sorted({len(s) for s in model.stems})
        self.trie = ahocorasick.Automaton()
        for k in {*model.words, *model.stems}:
            self.trie.add_word(k, k)
        if len(self.trie):
            self.trie.make_automaton()
        self.go, self.weight = compose()
        self.symbols = {w: s for s, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        self.threats = frozenset(THREATS)

    def lexical(self, token: str) -> float:
        """Weight of a token: its own entry's, or that of its heaviest stem."""
        if token in self.words:
            return self.words[token]
        return max((self.stems[token[:n]] for n in self.lengths if token[:n] in self.stems), default=0.0)

    def clauses(self, text: str) -> Iterator[str]:
        """Lower-cased clauses of the whole text in which some word begins like an entry of the trie."""
        low, done = text.lower(), 0
        if not len(self.trie):
            return
        for end, key in self.trie.iter(low):
            start = end - len(key) + 1
            if start < done or start and low[start - 1].isalpha() or key not in self.stems and end + 1 < len(low) and low[end + 1].isalpha():
                continue
            # The last clause's end is a mark itself, so no text is looked at twice.
            begin = max(low.rfind(c, done, start) for c in ".!?;:\n") + 1
            stop = _CLAUSE.search(low, end + 1)
            done = stop.start() if stop else len(low)
            yield low[begin:done]

    def symbol(self, token: str) -> tuple[int, float]:
        """The token's symbol and its entry's weight; 1 where it has no entry."""
        hit = self.lexical(token)
        if hit > 0:
            return THREAT if token in self.threats else INSULT, hit
        return self.symbols.get(token, PLAIN), 1.0

    def read(self, clause: str) -> tuple[float, str]:
        """A clause's weight, and the pattern that was read: its symbols but plain ones."""
        state, total, seen = 0, 0.0, []
        for token in _TOKEN.findall(clause):
            symbol, hit = self.symbol(token)
            total += self.weight[state][symbol] * (hit if symbol in (INSULT, THREAT) else 1.0)
            state = self.go[state][symbol]
            if symbol:
                seen.append(NAMES[symbol])
        return total, " ".join(seen)

    def clause_weight(self, clause: str) -> float:
        return self.read(clause)[0]

    def evidence(self, text: str | None) -> float:
        """Sum of the clauses' weights on a logarithmic scale; 0 for null and empty texts."""
        return math.log1p(sum(map(self.clause_weight, self.clauses(text)))) if text else 0.0


def _features(text: str) -> set[str]:
    """Distinct words, and beginnings of 4 to 6 letters marked by a star."""
    words = set(_TOKEN.findall(text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in (4, 5, 6) if len(w) > n}


def sample_hash(doc_id: Column, text: Column, seed: int = 2) -> Column:
    """What ``train`` samples by."""
    return F.xxhash64(doc_id, text, F.lit(seed))


def train(
    labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", hash_col: str | None = None, max_rows: int = 12_000, max_entries: int = 4000, min_docs: int = 6, min_share: float = 0.02, min_weight: float = 2.0, min_precision: float = 0.9, seed: int = 2
) -> ToxicityModel:
    """Learn entry weights and the score's scale from at most about ``max_rows`` labelled rows.

    The sample keeps the rows whose hash of id and text is below the share that gives ``max_rows``, repeated ones once.
    Where the rows come from a join, ``hash_col``, made by ``sample_hash`` before it, keeps texts that are not sampled out
    of the join. Rows with a null text or label teach nothing; a null id is one like any other. An entry is a word, or a stem of 4 to 6 letters, that at least ``min_docs`` toxic rows and
    ``min_share`` of them have (groups of copies alone do not make one) and whose smoothed log odds are at least
    ``min_weight``, if ``min_precision`` of the rows that have it are toxic; at most ``max_entries`` entries are kept, heaviest first, and none that another kept one covers. Without rows of both labels, so for an empty table, the given words
    alone make the model.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), (F.col(label_col) > 0).cast("int").alias("y"), (F.col(hash_col) if hash_col else sample_hash(F.col(id_col), F.col(text_col), seed)).alias("h"))
    n = rows.agg(F.approx_count_distinct("h", 0.01)).first()[0]
    kept = rows.where(F.pmod("h", F.lit(1 << 40)) < int(min(1.0, max_rows / max(n, 1)) * (1 << 40)))
    kept = materialise(kept.dropDuplicates(["h", "y"]).select("t", "y"))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Counts of a task are handed on once they get large, so a task's memory is bounded.
        by: tuple[Counter, Counter] = (Counter(), Counter())

        def rows_of() -> pd.DataFrame:
            keys = list({*by[0], *by[1]})
            return pd.DataFrame({"f": pd.Series(keys, dtype=object), "clean": pd.Series([by[0][k] for k in keys], dtype="int64"), "toxic": pd.Series([by[1][k] for k in keys], dtype="int64")})

        for p in parts:
            for t, y in zip(p["t"], p["y"]):
                by[y].update(_features(t))
                by[y][""] += 1
                if len(by[0]) + len(by[1]) > 400_000:
                    yield rows_of()
                    by[0].clear(), by[1].clear()
        yield rows_of()

    counts = kept.mapInPandas(count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = materialise(counts.where((F.col("toxic") >= min_docs) | (F.col("f") == "")))
    every = counts.where("f = ''").first()
    given = ToxicityModel({w: 2.0 for w in INSULTS + THREATS}, {})
    if every is None or not every["clean"] or not every["toxic"]:
        return given
    weight = F.log((F.col("toxic") + 0.5) / (every["toxic"] + 1.0)) - F.log((F.col("clean") + 0.5) / (every["clean"] + 1.0))
    entries = counts.where((F.col("f") != "") & (F.col("toxic") >= min_share * every["toxic"])).withColumn("w", weight)
    found = entries.where((F.col("w") >= min_weight) & (F.col("toxic") >= min_precision * (F.col("toxic") + F.col("clean")))).orderBy(F.desc("w"), "f").limit(max_entries).collect()
    share = {r["f"].rstrip("*"): 0 for r in found}
    for r in found:
        share[r["f"].rstrip("*")] = max(share[r["f"].rstrip("*")], r["toxic"])
    # Of beginnings that the same rows have, the longest counts: it says most about what was meant.
    narrower = {k[:n] for k, v in share.items() for n in (4, 5, 6) if n < len(k) and v >= 0.9 * share.get(k[:n], math.inf)}
    stems = {r["f"][:-1]: r["w"] for r in found if r["f"].endswith("*") and r["f"][:-1] not in narrower}
    shorter = lambda k: max((stems[k[:n]] for n in (4, 5, 6) if n < len(k) and k[:n] in stems), default=-1.0)
    keep = {k: w for k, w in stems.items() if w > shorter(k) + 0.7}
    seen = {r["f"]: r["w"] for r in entries.where(F.col("f").isin(INSULTS + THREATS)).collect()}
    words = {r["f"]: r["w"] for r in found if not r["f"].endswith("*") and r["w"] > shorter(r["f"]) + 0.7}
    # A given word keeps its weight unless the labels say otherwise.
    words |= {w: max(0.0, seen.get(w, 2.0)) for w in INSULTS + THREATS}
    model = ToxicityModel(words, keep)
    fit = kept.select(evidence(F.col("t"), model).alias("x"), "y").groupBy(F.round("x", 2).alias("x")).agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()
    slope, intercept = _logistic(np.array([r["x"] for r in fit]), np.array([r["n"] for r in fit], float), np.array([r["y"] for r in fit], float))
    return ToxicityModel(words, keep, slope, intercept)


def _logistic(x: np.ndarray, n: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept by Newton's method on grouped counts."""
    b = np.zeros(2)
    m = np.stack([x, np.ones_like(x)], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(m @ b, -30, 30)))
        step = np.linalg.solve(m.T @ (m * (n * p * (1 - p))[:, None]) + ridge * np.eye(2), m.T @ (y - n * p) - ridge * b)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(b[0], 0.0)), float(b[1])


def evidence(text: Column, model: ToxicityModel) -> Column:
    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar = Grammar(model)
        for part in parts:
            yield pd.Series([grammar.evidence(t) for t in part], dtype="float64")

    return run(text)


def score(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (score >= threshold), columns of these names replaced.

    Null and empty texts get the score of a text without hits. Every row stays.
    """
    p = 1 / (1 + F.exp(-(F.lit(model.slope) * evidence(F.col(text_col), model) + F.lit(model.intercept))))
    return docs.withColumn("score", p).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def matches(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per matched clause: ``doc_id, clause, pattern, weight``.

    The pattern names the clause's insults, threats, targets, negations and reports in order. Null and empty texts
    give no rows, repeated rows and equal clauses one each time, an empty table none; other columns are not looked at.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(model)
        for p in parts:
            out = [(d, c, pattern, weight) for d, t in zip(p["doc_id"], p["t"]) for c in grammar.clauses(t) for weight, pattern in [grammar.read(c)]]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "clause", "pattern", "weight"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).where("t is not null")
    return rows.mapInPandas(run, "doc_id long, clause string, pattern string, weight double")
