import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, neardup, urlfilter
from tessera.llm.queries import QUERIES, URL_RULES


def shingles(text):
    w = (text or "").encode().lower().split()
    return set(zip(*[w[k:] for k in range(5)])) or ({tuple(w)} if w else set())


def brute(rows):
    """Component of each id, by comparing every pair."""
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            common = len(a & b)
            if common and 100 * common >= 75 * (len(a) + len(b) - common):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def test_shingle_sets():
    texts = ["", None, "a b", "A  b\n", "a b c d e", "a b c d e f", "x " * 50, "é É\u00a0b c d e f"]
    assert [len(s) for s in neardup.shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]
    s = list(neardup.shingle_sets(pa.array(texts), chunk=1))
    assert (s[2] == s[3]).all()


@pytest.mark.parametrize("pivots", [(1, 8), ()])
def test_near_duplicates_like_brute_force(spark, pivots):
    rng = random.Random(len(pivots))
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=40)
    rows = []
    for g in range(12):
        base = rng.choices(vocab, k=rng.choice([3, 8, 30, 120])) + (passage if g % 3 == 0 else [])
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in neardup.near_duplicates(df, pivots=pivots).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == brute(rows)
    assert all(r["kept"] == (i == r["component_id"]) and r["n_shingles"] == len(shingles(dict(rows)[i])) for i, r in got.items())


@pytest.mark.parametrize("block", [16, 512])
def test_near_duplicates_of_texts_made_of_frequent_lines(spark, block):
    # Every line is in 46 texts or more; a text and its reverse are at the threshold and share frequent lines alone.
    rng = random.Random(3)
    lines = [" ".join(rng.choices([f"w{i}" for i in range(5000)], k=16)) for _ in range(24)]
    short = [" ".join(rng.choices([f"s{i}" for i in range(5000)], k=9)) for _ in range(12)]
    texts = [f"{a} {b}" for a in lines for b in lines if a != b] + [" ".join(x) for x in ((a, b, c) for a in short[:8] for b in short for c in short[:6]) if len(set(x)) == 3]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows)
    assert 250 < len(set(want.values())) < len(rows) - 250
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **({"block": block} if block != 512 else {})).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


@pytest.mark.parametrize("sketch", [32, 512])
def test_near_duplicates_of_all_sizes_at_the_threshold(spark, sketch):
    # Pairs just at or below 3/4, with sizes about those at which sketches stop being whole sets.
    rng = random.Random(9)
    rows = []
    for n in [*range(4, 130), 300, 520, 600, 700]:
        for cut in range(3):
            w = [f"w{rng.randrange(10**9)}" for _ in range(n + 4)]
            keep = max(1, (6 * n + 6) // 7 - cut) if n % 2 else max(1, (3 * n + 3) // 4 - cut)
            # The second text shares the first ``keep`` shingles, and is shorter or as long.
            rows += [" ".join(w), " ".join(w[: keep + 4] + ([f"x{rng.randrange(10**9)}" for _ in range(n - keep)] if n % 2 else []))]
    rows = list(enumerate(rows))
    want = brute_pairs(rows)
    assert 100 < len(set(want.values())) - len(rows) // 2 < 300
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), sketch=sketch).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def brute_pairs(rows):
    """Components where only rows 2k and 2k + 1 share anything."""
    return {i: c for k in range(0, len(rows), 2) for i, c in brute(rows[k : k + 2]).items()}


@pytest.mark.parametrize("block, weight", [(1024, 1 << 21), (16, 1 << 14)])
def test_blocks_give_no_pairs_of_sets_that_sketches_leave_open(spark, block, weight):
    # 60 sets in one list, each two at 0.7 and so below the threshold; two more are near the first and the last.
    rng = np.random.default_rng(4)
    common = rng.integers(0, 2**63, 700)
    sets = [np.concatenate([common, rng.integers(0, 2**63, 150)]) for _ in range(60)]
    sets = [np.unique(s.astype(np.uint64)) for s in [*sets, sets[0][40:], sets[59][40:]]]
    listed = spark.createDataFrame([(1, i, len(s), i) for i, s in enumerate(sets)], "v long, id long, n long, c long")
    members = spark.createDataFrame([(i, len(s), s[:256].astype(np.int64).tolist(), s.tobytes()) for i, s in enumerate(sets)], "id long, n long, sketch array<long>, whole binary")
    pairs = neardup._blocked(listed, members, 256, (3, 4), 5.0, block)
    assert pairs.count() < len(sets) * (1 if block == 1024 else 5)
    links = neardup._confirmed(pairs, members, 256, (3, 4), 5.0, weight)
    assert {frozenset(r) for r in links.collect()} == {frozenset((0, 60)), frozenset((59, 61))}


def test_query_like_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op5_neardup"](spark, small).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_one_of_each(spark, odd_docs, empty):
    long = " ".join(f"v{i}" for i in range(80))
    rows = [(1, long, "a"), (1, long, "a"), (2, long + " end", "b"), (None, "only here", "c"), (None, "only here", "c"), (None, long, "c"), (3, "", "d"), (4, None, None), (5, "x y", "e"), (5, "z", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __key string")
    got = neardup.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(got.collect(), key=str) == sorted({r for r in df.collect() if r["doc_id"] != 2 and not (r["doc_id"] is None and r["text"] == long)}, key=str)
    kept = neardup.one_of_each(odd_docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["0", "1", "2", "3", "6", "7", "None"]
    assert neardup.one_of_each(empty).count() == 0


def test_neardup_stage_of_long_texts_just_below_the_threshold(spark, monkeypatch):
    # Any two of 40 long texts are at 0.7, but the last is near the first.
    words = lambda n, p: " ".join(f"{p}{i}" for i in range(n))
    texts = [f"{words(704, 'w')} {words(146, f't{k}x')}" for k in range(39)]
    rows = [(k, t, "en", "a", len(t)) for k, t in enumerate([*texts, texts[0] + " more"])]
    made, blocked = [], neardup._blocked
    monkeypatch.setattr(neardup, "_blocked", lambda *a: made.append(blocked(*a).count()) or blocked(*a))
    got = corpus_pipeline.neardup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(39))
    # All pairs would be 779; lists may choose different classes to pair theirs with.
    assert 0 < made[0] < 5 * len(rows)


def test_near_duplicates_edges(spark, odd_docs, empty):
    got = neardup.near_duplicates(odd_docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 9 and by[4]["component_id"] == 0 and by[3]["kept"] and not by[4]["kept"] and by[1]["component_id"] == 1 and by[1]["n_shingles"] == 0
    assert neardup.near_duplicates(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    got = {r["id"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_hilbert_is_a_walk():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = ann.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_neighbours_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8))
    v[50:200] = v[50]
    rows = [(i, [float(x) for x in v[i]], "x") for i in range(300)] + [(1000, None, "x"), (1001, [0.0] * 8, "x"), (1002, [float("nan")] + [1.0] * 7, "x"), (1003, [1.0, 2.0], "x"), (None, [1.0] * 8, "x"), (5, [float(x) for x in v[5]], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in ann.search(df, df.where("vec_id % 50 = 0"), window=0.5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 50, 100, 150, 200, 250}
    for q, found in got.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [i for _, i, _ in sorted(found)] == sorted(range(300), key=lambda i: (d[i], i))[:10]
    whole = {(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, df.where("vec_id % 50 = 0"), window=0.5).collect()}
    assert whole == {(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, df.where("vec_id % 50 = 0"), window=0.5, most_asked=2, block=64).collect()}
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id in (1, 2, 3)")
    assert ann.search(few, few).count() == 6


def test_url_rules(spark):
    urls = ["http://a.example.net/en/1", "http://example.net/de/", "http://NET/x", "http://net", "http://x.org/fr/?q", "http://x.org/fr", "https://example.com/de/#a", "https://bexample.com/de/", None, "no scheme", "http://", "http://a/b://net/x", "http://a.b.example.net/en/", "http://x.net?/en/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    got = [(r["rule"], r["verdict"]) for r in urlfilter.judge(df, urlfilter.fit(df, rules)).orderBy("page_id").collect()]
    net, en, de, fr, no = ("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow")
    assert got == [en, net, net, no, fr, no, de, no, no, no, no, no, en, no]
    assert urlfilter.judge(df.limit(0), urlfilter.fit(df.limit(0), rules)).count() == 0
    assert urlfilter.judge(df, urlfilter.fit(df, rules.limit(0))).where("verdict <> 'allow' or rule is not null").count() == 0
    with pytest.raises(ValueError):
        urlfilter.fit(df, spark.createDataFrame([("no-slash", "block")], "rule string, verdict string"))


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where(F.crc32(F.col("key").cast("binary")) % 9 == 0)
    cascade = urlfilter.build(listed, keys)
    got = keys.select("key", urlfilter.contains(F.array("key"), cascade, spark).alias("in")).where(F.size("in") > 0)
    assert got.join(listed, "key", "left_anti").count() == 0 and got.count() == listed.count() and len(cascade.levels) > 2
    with pytest.raises(ValueError):
        urlfilter.build(listed, keys, max_bits=64)


def test_pipeline(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_neardup", "pii", "mixing", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() > 0.7 * before
    assert corpus_pipeline.STAGES[4][1](spark, docs, small).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.limit(0), small).count() == 0
