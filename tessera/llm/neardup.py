"""Near-duplicate detection by bottom-k sketches from one hash function.

Documents with equal shingle sets are one class, and a class is looked at once. The smallest hashes of a class's
shingles are its sketch. A class retains the rarest of its sketch, enough for any two linked classes to have one in
common; the inverted lists of retained hashes give candidate pairs. The sketch of the union estimates a pair's
similarity, and those that may reach the threshold are verified on full sets. Verified links are joined into
components. No list gives all its pairs as rows: each meets single members first, and what is left unjoined is
compared inside tasks, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bloom import build_bloom, may_hold, narrowed
from tessera.llm.common import discard, materialise, release, spare

WIDTH = 5
#: Odd multipliers for the places of a shingle, and a finaliser's.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array, width: int = WIDTH, chunk: int = 1 << 20) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text of a string array, null as empty.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of fewer words than ``width`` has its
    whole sequence as its one shingle, a text without words none.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, side="right")) - at)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, n)))
        at += n
        offsets, words = lists.offsets.to_numpy(), lists.values
        if lists.offset or offsets[0]:
            words, offsets = words[offsets[0] : offsets[-1]], offsets - offsets[0]
        coded = words.dictionary_encode()
        known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
        h = known[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.uint64)
        # Empty strings stand for leading and trailing white space; they are no words.
        empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        if empty.any():
            kept = np.concatenate([[0], np.cumsum(~empty)])
            h, offsets = h[~empty], kept[offsets]
        run = np.zeros(max(0, len(h) - width + 1), dtype=np.uint64)
        for k in range(width):
            run += _mixed(h[k : len(h) - width + 1 + k] * _PLACES[k % len(_PLACES)] + np.uint64(k)) if len(run) else 0
        run = _mixed(run)
        for i, j in zip(offsets[:-1], offsets[1:]):
            if j - i >= width:
                yield np.unique(run[i : j - width + 1])
            elif j > i:
                own = np.array([j - i], dtype=np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
                for k in range(i, j):
                    own = _mixed(own + h[k : k + 1] * _PLACES[(k - i) % len(_PLACES)] + np.uint64(k - i))
                yield own
            else:
                yield np.empty(0, np.uint64)


def _sketched(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, d1, d2, sketch``: a digest of the set in two longs, its ``k`` smallest hashes."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, sketch = [], [], [], []
            for s in shingle_sets(batch.column(2), width):
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
                n.append(len(s)), d1.append(int(digest[0])), d2.append(int(digest[1])), sketch.append(s[:k].view(np.int64).copy())
            made = [pa.array(c, t) for c, t in zip((n, d1, d2, sketch), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "text_hash", "n_shingles", "d1", "d2", "sketch"])
        release()

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, sketch array<long>")


def _members(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    """``id, d1, d2, n, sketch, whole``: the ``k`` smallest hashes, and the whole set as bytes where it has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"id": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "n": pa.int64(), "sketch": pa.list_(pa.int64()), "whole": pa.binary()}
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))
        for batch in batches:
            rows, held = [], 0
            for i, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width)):
                whole = s.tobytes()
                d1, d2 = np.frombuffer(xxhash.xxh3_128_digest(whole), dtype=np.int64).tolist()
                rows.append((i, d1, d2, len(s), s[:k].view(np.int64).copy(), whole if len(s) > k else None))
                held += s.nbytes
                if held > 1 << 23:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, d1 long, d2 long, n long, sketch array<long>, whole binary")


def _common_least(n: Column, k: int, similarity: tuple[int, int], deviations: float) -> Column:
    """How many hashes of its sketch of ``k`` a set of ``n`` shares at least with the sketch of a set linked to it.

    Where the union of the two fits in ``k``, all that they share is in both. Else the union's ``k`` smallest are a
    sample of it without replacement, and the bound is ``deviations`` standard deviations below the mean.
    """
    num, den = similarity
    j, union = num / den, n * den / num
    spread = F.sqrt(F.lit(k * j * (1 - j)) * F.greatest(F.lit(0.0), union - k) / F.greatest(F.lit(1.0), union - 1))
    return F.greatest(F.lit(1), F.least(F.ceil(n * num / den), F.ceil(F.lit(k * j) - deviations * spread))).cast("long")


def _listed(classes: DataFrame, k: int, similarity: tuple[int, int], deviations: float) -> DataFrame:
    """``v, id, n``: inverted lists of two classes or more of the hashes that the classes retain.

    A class retains of its sketch the hashes that are rarest among all classes, so many that it lacks fewer than it
    shares with any class linked to it: two linked classes both retain the rarest of what they share. Of lists with the
    same members one stays.
    """
    postings = classes.select(F.explode("sketch").alias("v"), "id", "n")
    sizes = postings.groupBy("v").agg(F.count("*").alias("f")).where("f >= 2")
    own = Window.partitionBy("id")
    rows = postings.join(sizes, "v").withColumns({"at": F.row_number().over(own.orderBy("f", "v")), "met": F.count("*").over(own)})
    # Hashes of a single class come first in the order and are in no list.
    alone = F.least("n", F.lit(k)) - F.col("met")
    rare = materialise(rows.where(alone + F.col("at") <= F.least("n", F.lit(k)) - _common_least(F.col("n"), k, similarity, deviations) + 1).select("v", "id", "n"))
    member = F.xxhash64("id", F.lit(1)).cast("decimal(38)")
    lists = rare.groupBy("v").agg(F.count("*").alias("size"), F.sum(member).alias("s"), F.bit_xor(F.xxhash64("id")).alias("x")).where("size >= 2")
    lists = lists.groupBy("size", "s", "x").agg(F.min("v").alias("v"))
    out = materialise(rare.join(lists.select("v"), "v"))
    discard(rare)
    return out


def _alike(m: Column, n: Column, similarity: tuple[int, int]) -> Column:
    """Whether sets of ``m`` and ``n`` may be linked at all."""
    return similarity[1] * F.least(m, n) >= similarity[0] * F.greatest(m, n)


def _stars(listed: DataFrame, pivots: int, similarity: tuple[int, int]) -> DataFrame:
    """Pairs ``a, b, ca, cb`` of each member of a list in ``listed(v, id, n, c)`` with one chosen by hash.

    There are ``pivots`` orders to choose by, one for each list, so that lists with much the same members mostly choose
    the same ones, and a class meets a few.
    """
    key = F.xxhash64("id", F.pmod("v", F.lit(pivots)))
    lists = listed.groupBy("v").agg(F.min_by(F.struct("id", "n", "c"), key).alias("p"), F.min("c").alias("low"), F.max("c").alias("high"))
    met = listed.join(lists.where("low <> high").select("v", "p"), "v").where((F.col("c") != F.col("p.c")) & _alike(F.col("n"), F.col("p.n"), similarity))
    first = F.col("id") < F.col("p.id")
    one, two = F.struct("id", "c"), F.struct("p.id", "p.c")
    pairs = met.select(F.when(first, one).otherwise(two).alias("x"), F.when(first, two).otherwise(one).alias("y"))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.c").alias("ca"), F.col("y.c").alias("cb")).distinct()


def _dealt(rows: DataFrame, key: str, weight: Column, block: int, least: int) -> DataFrame:
    """``rows(key, id, c)`` in pairs of blocks: ``at`` is a row's own block, ``x <= y`` are the two that meet.

    Rows of one key, if they are of different ``c`` and ``least`` at least, are cut by hash into blocks of a ``weight``
    of about ``block``. Those of the key's largest ``c`` are in blocks of their own, which do not meet each other.
    """
    sizes = rows.groupBy(key, "c").agg(F.count("*").alias("m"), F.sum(weight).alias("w")).groupBy(key)
    sizes = sizes.agg(F.max(F.struct("m", "c", "w")).alias("most"), F.sum("m").alias("all"), F.sum("w").alias("w")).where(f"all > most.m and all >= {least}")
    sizes = sizes.selectExpr(key, "most.c as big", f"ceil(most.w / {block}) as nb", f"ceil((w - most.w) / {block}) as nr")
    rows = rows.join(sizes, key).withColumn("large", F.col("c") == F.col("big"))
    rows = rows.withColumn("at", F.when(F.col("large"), F.col("nr")).otherwise(F.lit(0)) + F.pmod(F.xxhash64("id", key), F.when(F.col("large"), F.col("nb")).otherwise(F.col("nr"))))
    # The others' blocks meet all blocks, those of the largest component only the others'.
    last = F.when(F.col("large"), F.col("nr")).otherwise(F.col("nr") + F.col("nb")) - 1
    rows = rows.withColumn("last", last).drop("big", "nb", "nr", "large")
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).withColumns({"x": F.least("at", "other"), "y": F.greatest("at", "other")}).drop("last", "other")


def _maybe_linked(group: pa.Table, sketches: pa.ChunkedArray, k: int, similarity: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """``i, j, sure, common``: the rows of a pair of blocks that may be linked and differ in ``c``, by their sketches.

    If both sketches are whole sets the pair is ``sure``: it is linked. ``common`` is how many hashes they share.
    """
    num, den = similarity
    at, x, n, c, least = (group.column(name).to_numpy() for name in ("at", "x", "n", "c", "least"))
    left = np.flatnonzero(at == x[0])
    right = left if x[0] == group.column("y")[0].as_py() else np.flatnonzero(at != x[0])
    common = shared_counts(sketches, left, right)
    m, o = n[left][:, None], n[right][None, :]
    sure = (m <= k) & (o <= k)
    keep = np.where(sure, den * common >= num * (m + o - common), common >= np.maximum(least[left][:, None], least[right][None, :]))
    keep &= (c[left][:, None] != c[right][None, :]) & (den * np.minimum(m, o) >= num * np.maximum(m, o))
    i, j = np.nonzero(keep)
    return left[i], right[j], sure[i, j], common[i, j]


def _reached(size: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a graph of ``size`` nodes with edges ``i, j``: each node's component, and the node it was reached from, or -1."""
    if not len(i):
        return np.arange(size), np.full(size, -1)
    meets = np.zeros((size, size), dtype=bool)
    meets[i, j] = meets[j, i] = True
    label, start = np.full(size, -1), np.full(size, -1)
    for first in range(size):
        if label[first] >= 0:
            continue
        label[first], waiting = first, [first]
        while waiting:
            u = waiting.pop()
            new = np.flatnonzero(meets[u] & (label < 0))
            label[new], start[new] = first, u
            waiting.extend(new.tolist())
    return label, start


def _blocked(listed: DataFrame, members: DataFrame, k: int, similarity: tuple[int, int], deviations: float, block: int) -> DataFrame:
    """Pairs ``a, b, ca, cb, sure`` for what is in one list of ``listed(v, id, n, c)`` and in different components.

    The rest of what lists may hold: all pairs are compared, sketch by sketch, inside tasks. A list is cut into blocks
    by hash, and each pair of blocks is one group, however long the list is. Pairs whose sketches are their whole sets
    are ``sure``, and of these a group gives only those that join components it had not joined yet. Of the others a
    group does not give the pairs: each class that has one is paired with one class that a chain of them leads to.
    So a group never gives more rows than it has.
    """
    rows = _dealt(listed, "v", F.lit(1), block, 3).withColumn("least", _common_least(F.col("n"), k, similarity, deviations))
    rows = rows.join(members.select("id", "n", "sketch"), ["id", "n"]).select("v", "x", "y", "at", "id", "n", "c", "least", "sketch")

    def run(group: pa.Table) -> pa.Table:
        ids, c = group.column("id").to_numpy(), group.column("c").to_numpy()
        i, j, sure, _ = _maybe_linked(group, group.column("sketch"), k, similarity)
        names, code = np.unique(c, return_inverse=True)
        label, start = _reached(len(names), code[i[sure]], code[j[sure]])
        joined = np.flatnonzero(start >= 0)
        i, j = i[~sure], j[~sure]
        apart = label[code[i]] != label[code[j]]
        i, j = i[apart], j[apart]
        chain, _ = _reached(len(names), label[code[i]], label[code[j]])
        asked = np.unique(np.concatenate([i, j]))
        asked = asked[np.argsort(ids[asked], kind="stable")]
        _, first, of = np.unique(chain[label[code[asked]]], return_index=True, return_inverse=True)
        hub = asked[first][of]
        asked, hub = asked[asked != hub], hub[asked != hub]
        ca, cb = np.concatenate([names[start[joined]], c[hub]]), np.concatenate([names[joined], c[asked]])
        a, b = np.concatenate([names[start[joined]], ids[hub]]), np.concatenate([names[joined], ids[asked]])
        return pa.table({"a": a, "b": b, "ca": ca, "cb": cb, "sure": pa.array(np.arange(len(a)) < len(joined), pa.bool_())})

    return rows.groupBy("v", "x", "y").applyInArrow(run, "a long, b long, ca long, cb long, sure boolean").distinct()


def _confirmed(pairs: DataFrame, members: DataFrame, k: int, similarity: tuple[int, int], deviations: float, weight: int = 1 << 21) -> DataFrame:
    """Links ``a, b`` of components, enough to join all that ``pairs(a, b, ca, cb, sure)`` of ``_blocked`` may join.

    Classes that a chain of pairs leads to are one group, cut into blocks of about ``weight`` hashes. Pairs of blocks
    are compared inside tasks, on whole sets where sketches leave it open, and only links that join something come out.
    """
    num, den = similarity
    open_ = pairs.where("not sure")
    asked = open_.select("a", "ca").union(open_.select("b", "cb")).toDF("id", "c").distinct()
    asked = asked.join(components(pairs.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).toDF("c", "g"), "c").join(members.select("id", "n"), "id")
    rows = _dealt(asked, "g", F.greatest(F.col("n"), F.lit(weight >> 10)), weight, 2).withColumn("least", _common_least(F.col("n"), k, similarity, deviations))
    # Where a sketch is the whole set, the set is not held again.
    sets = members.select("id", F.when(F.col("whole").isNull(), F.col("sketch")).alias("sketch"), "whole")
    rows = rows.join(sets, "id").select("g", "x", "y", "at", "n", "c", "least", "sketch", "whole")

    def run(group: pa.Table) -> pa.Table:
        c = group.column("c").to_numpy()
        sets = [np.frombuffer(w.as_buffer(), np.uint64) if w.is_valid else s.values.to_numpy().view(np.uint64) for s, w in zip(group.column("sketch"), group.column("whole"))]
        low = [s[:k] for s in sets]
        sketches = pa.LargeListArray.from_arrays(np.cumsum([0, *map(len, low)]), np.concatenate(low).view(np.int64))
        i, j, sure, common = _maybe_linked(group, pa.chunked_array([sketches]), k, similarity)
        up: dict[int, int] = {}

        def root(u: int) -> int:
            while (w := up.get(u, u)) != u:
                up[u] = up.get(w, w)
                u = w
            return u

        a, b = [], []
        for e in np.lexsort((-common, ~sure)):
            x, y = sets[i[e]], sets[j[e]]
            p, q = root(int(c[i[e]])), root(int(c[j[e]]))
            if p == q:
                continue
            if not sure[e]:
                both = len(np.intersect1d(x, y, assume_unique=True))
                if den * both < num * (len(x) + len(y) - both):
                    continue
            up[p] = q
            a.append(int(c[i[e]])), b.append(int(c[j[e]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    confirmed = rows.groupBy("g", "x", "y").applyInArrow(run, "a long, b long")
    return materialise(pairs.where("sure").select("ca", "cb").toDF("a", "b").union(confirmed).distinct())


def shared_counts(sketches: pa.ChunkedArray, left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """How many hashes each row of ``left`` shares with each of ``right``, both places in ``sketches``."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    lists = sketches.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    code = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
    place = [np.full(len(lists), -1), np.full(len(lists), -1)]
    place[0][left], place[1][right] = np.arange(len(left)), np.arange(len(right))
    met = np.ones(code.max(initial=-1) + 1, dtype=bool)
    for p in place:
        met &= np.bincount(code[p[row] >= 0], minlength=len(met)) > 0
    code, row = (np.cumsum(met) - 1)[code[met[code]]], row[met[code]]
    for start in range(0, int(met.sum()), width):
        within = (code >= start) & (code < start + width)
        r, v = row[within], code[within] - start
        sides = []
        for p, size in zip(place, out.shape):
            m = np.zeros((size, width), dtype=np.float32)
            has = p[r] >= 0
            m[p[r[has]], v[has]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest id that each id of ``edges(a, b)`` reaches; ``edges`` is best a written table.

    Every round maps each id to the smallest in its neighbourhood, twice over, and the edges with it; an edge whose
    ends meet is done. All tables live in the shared folder; nothing but counts comes to the driver.
    """
    edges, steps = edges.where("a <> b").select("a", "b"), []
    while edges.take(1):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        up = both.groupBy("u").agg(F.least("u", F.min("v")).alias("p"))
        over = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
        jumped = materialise(up.join(over, "p", "left").select("u", F.coalesce("q", "p").alias("p")))
        ends = edges.join(jumped.toDF("a", "x"), "a").join(jumped.toDF("b", "y"), "b").where("x <> y")
        left = materialise(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if steps:
            discard(edges)
        steps, edges = [*steps, jumped], left
    if not steps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = steps[0].toDF("id", "component")
    for s in steps[1:]:
        out = out.join(s.toDF("component", "__next"), "component", "left").select("id", F.coalesce("__next", "component").alias("component"))
    return out


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels(id, c)`` once the components ``c`` that ``edges(a, b)`` joins are one."""
    over = components(edges).toDF("c", "__to")
    out = materialise(labels.join(over, "c", "left").select("id", F.coalesce("__to", "c").alias("c")))
    discard(labels)
    return out


def _classified(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: tuple[int, int], retained: int, sketch: int, deviations: float, pivots: tuple[int, ...], block: int) -> DataFrame:
    """The rows of ``_sketched`` without sketches, with their ``component_id`` and ``kept``."""
    every = materialise(_sketched(docs, id_col, text_col, width, retained))
    classes = every.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2")
    classes = materialise(classes.agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    listed = _listed(classes, retained, similarity, deviations)
    labels = materialise(listed.select("id").distinct().withColumn("c", F.col("id")))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    wanted = classes.select("id", "d1", "d2").join(labels.select("id"), "id", "left_semi")
    members = _members(narrowed(rows, "__id", labels, "id"), "__id", "__text", width, sketch)
    members = materialise(members.join(wanted, ["id", "d1", "d2"], "left_semi").dropDuplicates(["id", "d1", "d2"]).drop("d1", "d2"))
    for n in pivots:
        links = _linked(_stars(listed.join(labels, "id"), n, similarity), members, sketch, similarity, deviations)
        labels = _merged(labels, links)
        discard(links)
    pairs = materialise(_blocked(listed.join(labels, "id"), members, sketch, similarity, deviations, block))
    links = _confirmed(pairs, members, sketch, similarity, deviations)
    labels = _merged(labels, links)
    discard(pairs, links, listed, members)
    joined = materialise(classes.select("d1", "d2", "id").join(labels, "id", "left").select(F.col("d1").alias("__d1"), F.col("d2").alias("__d2"), F.coalesce("c", "id").alias("__component")))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("__component", "doc_id")).otherwise(F.col("doc_id"))
    out = every.drop("sketch").join(joined, (F.col("d1") == F.col("__d1")) & (F.col("d2") == F.col("__d2")), "left").withColumn("component_id", component)
    out = materialise(out.select("doc_id", "text_hash", "n_shingles", "d1", "d2", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")))
    discard(every, classes, labels, joined)
    return out


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    similarity: tuple[int, int] = (3, 4),
    retained: int = 64,
    sketch: int = 512,
    deviations: float = 5.0,
    pivots: tuple[int, ...] = (1, 8),
    block: int = 1024,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Two documents are linked if the Jaccard similarity of their shingle sets is at least ``similarity`` (a fraction of
    two integers); ``component_id`` is the smallest id reachable over links, and ``kept`` tells that it is the row's
    own. A null, empty or blank text has no shingles and no links. A row of null id never gives a component its id:
    its component is that of its equal texts with an id, else null. Repeated rows and equal texts are one class,
    however many; texts that share an id share its component. An empty table stays empty; other columns are not
    looked at.

    Candidates: of the ``retained`` smallest hashes of its set each class posts the rarest, enough for any two linked
    classes to meet in a list. In each list the members meet one chosen member, once for each of ``pivots``; then all
    members of a list that are not joined yet are compared, sketch by sketch, in pairs of blocks of about ``block``.
    No list is cut, and no pair in a list is passed over but those that are in one component already.
    The union's ``sketch`` smallest hashes estimate the similarity, and what may reach the threshold is verified on
    whole sets. A link between classes is missed only if chance puts what their sketches share ``deviations`` standard
    deviations below its mean; for sets of up to three quarters of ``retained`` nothing is left to chance.
    """
    out = _classified(docs, id_col, text_col, width, similarity, retained, sketch, deviations, pivots, block)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: tuple[int, int] = (3, 4), max_bits: int = 1 << 26) -> DataFrame:
    """The rows of ``docs``, in all its columns, that are left if one document of each group of near duplicates stays.

    The one of smallest id stays. Of repeated rows, and of rows that share an id and their shingles, one stays (of
    smallest text hash); rows that share an id but differ in their shingles each stay if the id does. Rows of null id
    stay once for each shingle set that no row with an id has. Rows without shingles are no group's: they stay, once
    for each id. An empty table stays empty.

    Rows whose id is neither null, nor dropped, nor repeated pass without a shuffle: a filter of at most ``max_bits``
    tells most of them; the others are joined.
    """
    every = _classified(docs, id_col, text_col, width, similarity, 64, 512, 5.0, (1, 8), 1024)
    own = every.groupBy("d1", "d2", "doc_id").agg(F.min("text_hash").alias("text_hash"), F.max("kept").alias("kept"), F.max("component_id").alias("component_id"))
    stay = materialise(own.where((F.col("kept")) | (F.col("doc_id").isNull() & F.col("component_id").isNull())).select("doc_id", "text_hash").distinct())
    odd = materialise(every.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("kept").alias("kept")).where("n > 1 or not kept").select("doc_id"))
    discard(every)
    key, text_hash, kept_id, kept_hash = spare(docs, "key", "hash", "kept_id", "kept_hash")
    n = max(odd.count(), 1)
    odd_id = may_hold(build_bloom(odd, "doc_id", n, 0.02, max_bits=max_bits, fit=True), F.col(key), docs.sparkSession)
    rows = docs.withColumn(key, F.col(id_col).cast("long"))
    asked = rows.where(F.col(key).isNull() | odd_id).withColumn(text_hash, F.xxhash64(F.col(text_col).cast("string")))
    stay = stay.toDF(kept_id, kept_hash)
    asked = asked.join(stay, F.col(key).eqNullSafe(F.col(kept_id)) & (F.col(text_hash) == F.col(kept_hash)), "left_semi").dropDuplicates([key, text_hash])
    return rows.where(F.col(key).isNotNull() & ~odd_id).select(docs.columns).union(asked.select(docs.columns))


def _linked(pairs: DataFrame, members: DataFrame, k: int, similarity: tuple[int, int], deviations: float) -> DataFrame:
    """The components ``a, b`` of the ``pairs(a, b, ca, cb)`` whose full sets reach the similarity.

    The share of the union's ``k`` smallest hashes that both sets have estimates the similarity; it is exact if the
    sketches are the whole sets. What is ``deviations`` below or better is verified on whole sets.
    """
    num, den = similarity
    j = num / den
    small = members.select("id", "n", "sketch")
    rows = pairs.join(small.toDF("a", "na", "sa"), "a").join(small.toDF("b", "nb", "sb"), "b")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sure = [], []
            for m, n, x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6), batch.column(7)):
                x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                sure.append(m <= k and n <= k)
                if sure[-1]:
                    common = m + n - len(np.union1d(x, y))
                    keep.append(den * common >= num * (m + n - common))
                    continue
                merged = np.sort(np.concatenate([x, y]))
                start = np.r_[True, merged[1:] != merged[:-1]]
                twice = np.r_[~start[1:], False]
                union = np.flatnonzero(start)[:k]
                most = max(m, n) / j  # what the union holds at most, if they are linked
                spread = math.sqrt(len(union) * j * (1 - j) * max(0.0, most - len(union)) / max(1.0, most - 1))
                keep.append(twice[union].sum() >= len(union) * j - deviations * spread - 1)
            out = [*batch.columns[:4], pa.array(sure, pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, names=["a", "b", "ca", "cb", "sure"]).filter(pa.array(keep, pa.bool_()))
        release()

    kinds = "a long, b long, ca long, cb long"
    likely = materialise(rows.select("a", "b", "ca", "cb", "na", "nb", "sa", "sb").mapInArrow(estimate, f"{kinds}, sure boolean"))
    # Where a sketch is the whole set, the set is not held again.
    sets = members.select("id", "sketch", "whole").withColumn("sketch", F.when(F.col("whole").isNull(), F.col("sketch")))
    both = likely.where("not sure").join(sets.toDF("a", "sa", "wa"), "a").join(sets.toDF("b", "sb", "wb"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sx, wx, sy, wy in zip(*batch.columns[2:]):
                x, y = (np.frombuffer(w.as_buffer(), np.uint64) if w.is_valid else s.values.to_numpy().view(np.uint64) for s, w in ((sx, wx), (sy, wy)))
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["ca", "cb"]).filter(pa.array(keep, pa.bool_()))
        release()

    verified = both.select("ca", "cb", "sa", "wa", "sb", "wb").mapInArrow(verify, "ca long, cb long")
    out = materialise(likely.where("sure").select("ca", "cb").union(verified).toDF("a", "b").distinct())
    discard(likely)
    return out
