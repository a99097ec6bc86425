"""Packing of tokenised documents into fixed windows by the sum-of-squares rule.

Each partition packs its own documents in one pass. A document is cut into whole windows while it lasts; what is
left goes, online, to the fill level that makes the sum of squared counts of partially filled windows smallest,
found in an array with one counter per level. At the end of a partition the windows still open are merged by
cutting, so that a partition pads less than one window.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release

#: Words of these characters only are cut here instead of in the tokenizer's slower normaliser and splitter.
_PLAIN = re.compile("[!-~\u00a1-\u00ff]+")
#: Letters, then marks: the two never share a token.
_TAIL = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)")
_BLANK = re.compile("[ \n]")
_RUN = r"[!-/:-@\[-`{-~][.,][ \n]"


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code point from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class WordCache(dict):
    """Token ids, as little-endian bytes, of words between blanks.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in turn. Words
    met before are looked up. A new word of Latin-1 characters is cut by the tokenizer's own pattern and its parts go
    straight to the BPE model; any other word goes through the whole tokenizer. After ``limit`` words the cache
    starts anew, so memory is bounded.
    """

    def __init__(self, spec: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.limit, self.tokenizer = limit, Tokenizer.from_str(spec)
        pipe = json.loads(spec)
        if pipe.get("post_processor") is not None or any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in pipe["added_tokens"]):
            raise ValueError("a tokenizer that drops white space is needed")
        self.marks = [t["content"] for t in pipe["added_tokens"]]
        #: Texts in which lower case could change more than case: a letter and its mark could compose otherwise, and
        #: a special token could come about.
        self.odd = "(?i)" + "|".join(["[\u0300-\u036f]", *map(re.escape, self.marks)])
        self.is_odd = re.compile(self.odd).search
        split, level = pipe["pre_tokenizer"]["pretokenizers"]
        plain = [x["type"] for x in pipe["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"] and level["type"] == "ByteLevel" and not level["add_prefix_space"]
        self.cut = regex.compile(split["pattern"]["Regex"]).findall if plain and split["invert"] and split["behavior"] == "Removed" else None
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def _encode(self, word: str) -> list[int]:
        if self.cut and _PLAIN.fullmatch(word) and not any(m in word for m in self.marks):
            out: list[int] = []
            word = word.lower()
            for part in (word,) if word.isalpha() else self.cut(word):
                shown = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
                out += [t.id for t in self.model.tokenize(shown)]
            return out
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        if self.cut and word.isascii() and word.isalpha():
            self[word] = ids = self._bytes([t.id for t in self.model.tokenize(word.lower())])
            return ids
        tail = None if word.isalpha() else _TAIL.fullmatch(word)
        if tail and tail[1].isalpha():  # seldom kept whole: there are many more words with marks than without
            return self[tail[1]] + self[tail[2]]
        self[word] = ids = self._bytes(self._encode(word))
        return ids

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        got = array("I", ids)
        if sys.byteorder == "big":
            got.byteswap()
        return got.tobytes()

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string array without nulls."""
        texts = pc.ascii_lower(texts)
        apart = texts
        for mark in (". ", ", ", ".\n"):
            apart = pc.replace_substring(apart, mark, f" {mark}")
        # A sentence's mark is a token of its own unless it ends a run of marks.
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(texts, _RUN), texts, apart))
        words = lists.values.dictionary_encode()
        known = [self[w] for w in words.dictionary.to_pylist()]
        size = np.array([len(x) // 4 for x in known], dtype=np.int64)
        flat, first = np.frombuffer(b"".join(known), dtype="<u4"), np.cumsum(size) - size
        index = words.indices.to_numpy(zero_copy_only=False)
        n = size[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        all_ids = flat[np.repeat(first[index] - ends[:-1], n) + np.arange(ends[-1])]
        at = ends[lists.offsets.to_numpy()]
        return [all_ids[i:j] for i, j in zip(at[:-1], at[1:])]


def tokenised(cache: WordCache, texts: pa.Array, chunk: int = 1 << 20) -> Iterator[np.ndarray]:
    """Ids of each text of a string array, null as empty; about ``chunk`` bytes of text at a time.

    Lists of words and ids of a part take some sixteen times its bytes, so parts are small.
    """
    at, sizes = 0, pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    while at < len(texts):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), chunk, side="right")))
        part = pc.fill_null(texts.slice(at, n), "")
        at += n
        if sizes[at - n] <= 2 * chunk and not pc.any(pc.match_substring_regex(part, cache.odd)).as_py():
            yield from cache.ids(part)
            continue
        for text in part.to_pylist():
            out, i = [], 0
            while i < len(text):  # a very long text in pieces that end at a blank
                end = m.start() if (m := _BLANK.search(text, i + chunk)) else len(text)
                piece = text[i:end]
                if cache.is_odd(piece):
                    out += [np.array(cache.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4")]
                else:
                    out += cache.ids(pa.array([piece], pa.large_string()))
                i = end
            yield np.concatenate(out) if out else np.empty(0, "<u4")


class SumOfSquares:
    """Windows of one partition. ``place`` returns the pieces of windows that are finished."""

    def __init__(self, size: int, base: int, max_open: int = 4096):
        self.size, self.next, self.max_open = size, base, max_open
        self.count = np.zeros(size + 1, dtype=np.int64)  # open windows by level
        self.open: list[list[list]] = [[] for _ in range(size + 1)]  # windows by level: lists of (doc, start, ids, total)
        self.n_open = 0

    def _close(self, window: list) -> list[tuple]:
        seq, at, out = self.next, 0, []
        self.next += 1
        for doc, start, ids, total in window:
            out.append((doc, start, ids, total, seq, at))
            at += len(ids) // 4
        return out

    def place(self, doc, ids: bytes) -> list[tuple]:
        total, out, at, full = len(ids) // 4, [], 0, 4 * self.size
        while len(ids) - at >= full:
            out += self._close([(doc, at // 4, ids[at : at + full], total)])
            at += full
        s = (len(ids) - at) // 4
        if s:
            piece, n = (doc, at // 4, ids[at:], total), self.count
            # Change of the sum of squares for each level h that has a window with room: 2(N(h+s) - N(h)) + 2, and
            # 2 N(s) + 1 for a new window; level `size` is full and not counted.
            room = self.size - s
            gain = 2 * (n[s : self.size + 1] - n[: room + 1]) + 2
            gain[0] = 2 * n[s] + 1
            gain[room] = 1 - 2 * n[room] if room else gain[0]
            gain[1:][n[1 : room + 1] == 0] = np.iinfo(np.int64).max
            h = int(gain.argmin())
            if h == 0:
                window = [piece]
                self.n_open += 1
            else:
                window = self.open[h].pop()
                window.append(piece)
                n[h] -= 1
            if h + s == self.size:
                self.n_open -= 1
                out += self._close(window)
            else:
                n[h + s] += 1
                self.open[h + s].append(window)
            if self.n_open > self.max_open:
                out += self.merge(keep=self.max_open // 2)
        return out

    def merge(self, keep: int = 0) -> list[tuple]:
        """Fill the fullest open windows with what the emptiest hold, cutting where needed; leave ``keep`` open."""
        rest = [w for level in self.open for w in level]  # emptiest first
        level = [h for h in range(self.size + 1) for _ in self.open[h]]
        out: list[tuple] = []
        lo, hi = 0, len(rest) - 1
        while hi - lo + 1 > max(1, keep):
            gap = self.size - level[hi]
            while gap and lo < hi:
                doc, start, ids, total = rest[lo].pop()
                take = min(gap, len(ids) // 4)
                cut = len(ids) - 4 * take  # the tail goes, so the piece's own start stays
                rest[hi].append((doc, start + cut // 4, ids[cut:], total))
                if cut:
                    rest[lo].append((doc, start, ids[:cut], total))
                gap, level[lo] = gap - take, level[lo] - take
                level[hi] += take
                if not rest[lo]:
                    lo += 1
            if gap:
                break
            out += self._close(rest[hi])
            hi -= 1
        self.open, self.count, self.n_open = [[] for _ in range(self.size + 1)], np.zeros(self.size + 1, dtype=np.int64), 0
        for i in range(lo, hi + 1):
            self.open[level[i]].append(rest[i])
            self.count[level[i]] += 1
            self.n_open += 1
        return out

    def finish(self) -> list[tuple]:
        out = self.merge()
        for level in self.open:
            for w in level:
                out += self._close(w)
        self.open, self.n_open = [], 0
        return out


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 2048,
    end_id: int = 1,
    vocabulary_words: int = 400_000,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` holds the piece's token ids as unsigned 32-bit little-endian bytes. A document's ids are the tokenizer's,
    without special tokens, then ``end_id``; a null or empty text is ``end_id`` alone. Every id is in exactly one
    piece. Offsets in a sequence have no gaps. A null doc_id stays null, repeated rows are packed each for itself, an
    empty table gives no rows, other columns are not looked at. Sequence ids hold the partition's number in the upper
    bits: a task that runs again gives the same ids.

    Memory of a task: the batch, some 20 MB while a part of it is tokenised, the word cache and at most 4096 open windows.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], dtype="<u4").tobytes()

    def rows(out: list[tuple]) -> pa.RecordBatch:
        doc, start, ids, total, seq, at = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip((doc, start, [len(x) // 4 for x in ids], ids, total, seq, at), _SCHEMA.types)], schema=_SCHEMA
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(spec.value, vocabulary_words)
        windows, out, held = SumOfSquares(size, TaskContext.get().partitionId() << 40), [], 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), tokenised(cache, batch.column(1))):
                done = windows.place(doc, ids.tobytes() + end)
                out += done
                held += sum(len(x[2]) for x in done)
                if held > 1 << 22:
                    yield rows(out)
                    out, held = [], 0
        out += windows.finish()
        if out:
            yield rows(out)
        cache.clear()
        del out, windows
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
