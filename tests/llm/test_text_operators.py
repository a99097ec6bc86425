import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, licenses, mixing, packing, pii, simhash, toxicity
from tessera.llm.queries import QUERIES


def words_tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def test_language_edges(spark, odd_docs, empty):
    model = langid.train(odd_docs)
    assert [k for k, _ in model.dictionaries] == ["de", "en"]
    got = {r["doc_id"]: r for r in langid.identify_languages(odd_docs, model).collect()}
    assert len(got) == 8 and got[0]["lang_pred"] == "en" and got[None]["lang_pred"] == "de" and got[0]["size"] == 7
    assert all(got[i]["lang_pred"] == "und" and got[i]["lang_rejected"] and got[i]["lang_score"] == 0 for i in (1, 2, 6, 7))
    assert langid.identify_languages(empty, model).count() == 0
    none = langid.train(empty)
    assert none.dictionaries == () and langid.identify_languages(odd_docs, none).where("lang_pred <> 'und'").count() == 0
    with pytest.raises(ValueError):
        langid.train(odd_docs, max_languages=1)


def test_tokens_equal_the_librarys():
    from tokenizers import Tokenizer

    path = words_tokenizer()
    spec = open(path, encoding="utf-8").read()
    tokenizer, cache = Tokenizer.from_str(spec), packing.WordCache(spec, limit=50)
    texts = ["", "Áé's don't I'LL été² ½ J\u030c <|endoftext|>x <|ENDoftext|> b\x85c \x1c 中文字 ΟΔΟΣ İ ß A\xadB 😀", "a..b ...c. d., e,f 12.5. g.\n", "\tx\r\n\x0b\x0cy", "K ķ 'sx ''s s'S x' é''s &&& of,&&& thnt.*** end", "Word. word, WORD.\nword " * 40]
    for chunk in (1, 64, 1 << 20):
        for t, ids in zip(texts, packing.tokenised(cache, pa.array(texts), chunk)):
            assert tokenizer.encode(t, add_special_tokens=False).ids == ids.tolist()


def test_tokens_of_a_batch_take_little_memory():
    import tracemalloc

    cache = packing.WordCache(open(words_tokenizer(), encoding="utf-8").read())
    rng, words = random.Random(1), "the quick brown fox jumps over a lazy dog, and sings.".split()
    rows = [" ".join(rng.choices(words, k=1000)) for _ in range(1600)]
    rows[::100] = [None] * 16
    want = {n: cache.tokenizer.encode(rows[n] or "", add_special_tokens=False).ids for n in (0, 1, 799, 1599)}
    texts, own = pa.array(rows), pa.default_memory_pool()
    pool = pa.proxy_memory_pool(own)
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        for n, ids in enumerate(packing.tokenised(cache, texts)):
            assert n not in want or ids.tolist() == want[n]
        peak = tracemalloc.get_traced_memory()[1] + pool.max_memory()
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(own)
    assert n == 1599 and texts.nbytes > 7e6 and peak < 3 * texts.nbytes


def check_packing(rows, size):
    seqs, by_doc = {}, {}
    for r in rows:
        assert r["length"] > 0 and len(r["ids"]) == 4 * r["length"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], bytes(r["ids"])))
    for pieces in seqs.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= size
    return seqs, by_doc


def test_packing_round_trip(spark, docs, odd_docs, empty):
    from tokenizers import Tokenizer

    path = words_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(docs.repartition(3, "doc_id"), path, size=256).collect()
    seqs, by_doc = check_packing(rows, 256)
    for r in docs.collect():
        want = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        pieces, at = sorted(by_doc[(r["doc_id"], len(want))]), 0
        for start, n, ids in pieces:
            assert start == at and np.frombuffer(ids, "<u4").tolist() == want[at : at + n]
            at += n
        assert at == len(want)
    assert sum(r["length"] for r in rows) > 0.99 * 256 * (len(seqs) - 3)
    odd = packing.pack(odd_docs, path).collect()
    check_packing(odd, 2048)
    assert sum(r["doc_tokens"] for r in odd if r["start"] == 0 and r["doc_id"] in (1, 2)) == 2
    assert packing.pack(empty, path).count() == 0


def test_sum_of_squares_bounds_open_windows():
    windows, rng, total, out = packing.SumOfSquares(64, 0, max_open=10), np.random.default_rng(1), 0, []
    for i in range(800):
        n = int(rng.integers(0, 200))
        total += n
        out += windows.place(i, b"abcd" * n)
        assert windows.n_open <= 11 and windows.count.sum() == windows.n_open
    out += windows.finish()
    assert sum(len(x[2]) for x in out) == 4 * total and total > 0.97 * 64 * windows.next


def test_mixing(spark, odd_docs, empty):
    sized = odd_docs.withColumn("size", mixing.word_count(F.col("text")))
    sources = mixing.cycled_weights(mixing.sources_of(sized), [5, 2, 1])
    assert [(r["source"], r["weight"]) for r in sources.orderBy(F.asc_nulls_last("source")).collect()] == [("a", 5.0), ("b", 2.0), ("c", 1.0), (None, 5.0)]
    got = mixing.mix(sized, mixing.water_fill(sources)).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(empty, mixing.water_fill(mixing.cycled_weights(mixing.sources_of(empty), [1]))).count() == 0


def test_water_filling_is_feasible_and_even(spark):
    rows = [("a", 100, 5.0), ("b", 10, 2.0), ("c", 1000, 1.0), ("d", 0, 5.0), ("e", 50, None)]
    got = {r["source"]: r["target"] for r in mixing.water_fill(spark.createDataFrame(rows, "source string, source_size long, weight double"), 300.0).collect()}
    assert got == {"a": 200.0, "b": 20.0, "c": 80.0, "d": 0.0, "e": 0.0}
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 50).alias("size"))
    t = mixing.water_fill(mixing.sources_of(docs).withColumn("weight", F.lit(1.0)), share=1.3)
    taken = mixing.mix(docs, t).agg(F.sum("taken"), F.first("target")).first()
    assert abs(taken[0] - taken[1]) <= 100


def test_toxicity(spark, odd_docs, empty):
    words = ["lorem", "ipsum", "dolor"]
    rows = [(i, f"{words[i % 3]} sit. You are a grumblefink{i % 4}. {words[i % 2]}", 1) if i % 4 == 0 else (i, f"{words[i % 3]} sit amet, {words[i % 2]}. The end", 0) for i in range(200)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert any(k.startswith("grumb") for k in {**model.words, **model.stems})
    tests = [("You grumblefink0!", 1), ("An idiot, you.", 1), ("lorem ipsum", 0), ("", 0), (None, 0)]
    got = toxicity.score(spark.createDataFrame(tests, "text string, y int"), model).collect()
    assert all((r["score"] >= 0.5) == (r["y"] == 1) for r in got)
    given = toxicity.train(empty.withColumn("toxic", F.lit(1)))
    assert toxicity.score(odd_docs, given).where("predicted = 0").count() == odd_docs.count() and toxicity.score(empty, given).count() == 0
    grammar = toxicity.Grammar(given)
    plain, negated, said, aimed, twice = (grammar.clause_weight(t) for t in ("what an idiot", "not an idiot", "it said idiot", "you idiot", "a stupid idiot"))
    assert negated < said < plain < aimed < twice
    threat, empty_threat, no_threat = (grammar.clause_weight(t) for t in ("we kill you", "we kill time", "we never kill you"))
    assert no_threat < threat and empty_threat < threat and threat > plain
    got = toxicity.matches(spark.createDataFrame([(1, "Fine. You idiot! Fine"), (2, None)], "doc_id long, text string"), given).collect()
    assert [(r["clause"], r["pattern"]) for r in got] == [(" you idiot", "target insult")]
    assert toxicity.matches(empty, given).count() == 0


def by_hand(model, text):
    """Evidence of a text by plain search in each clause's words, without tries or machines."""
    total = 0.0
    for clause in re.split(r"[.!?;:\n]", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+", clause)
        weight = [model.words[w] if w in model.words else max([model.stems[w[:n]] for n in range(1, len(w) + 1) if w[:n] in model.stems], default=0.0) for w in words]
        kind = ["threat" if h > 0 and w in toxicity.THREATS else "insult" if h > 0 else next((k for k, ws in (("target", toxicity.TARGETS), ("negation", toxicity.NEGATIONS), ("report", toxicity.REPORTS)) if w in ws), "") for w, h in zip(words, weight)]
        if not any(h > 0 for h in weight):
            continue

        def near(i, what, closed_by=None):
            for j in range(i - 1, max(-1, i - 4), -1):
                if kind[j] == what:
                    return True
                if closed_by and kind[j] == closed_by:
                    return False
            return False

        for i, k in enumerate(kind):
            given = 0.0
            if k == "insult":
                given = weight[i] * (1.0 if near(i, "insult", "target") else 0.8) * (1.5 if near(i, "target") else 1.0)
            elif k == "threat":
                given = weight[i] * 0.2 * (1.5 if near(i, "target") else 1.0)
            elif k == "target":
                given = 0.5 * near(i, "insult", "target") + 2.0 * near(i, "threat", "target")
            total += given * (0.3 if near(i, "negation") else 1.0) * (0.5 if "report" in kind[:i] else 1.0)
    return math.log1p(total)


def test_composed_machine_reads_like_a_plain_search(spark, docs):
    rng = random.Random(6)
    model = toxicity.ToxicityModel({"idiot": 2.0, "kill": 3.0, "loser": 1.0, "hurt": 1.5}, {"grumb": 1.2, "grumble": 0.7})
    words = "idiot kill loser hurt grumbles grumbly you them not never said reported the a house idiots x1y . ! ; \n ,".split(" ")
    texts = [" ".join(rng.choices(words, k=rng.randrange(30))) for _ in range(1500)] + [None, "", "idiot " * 30_000, "a" * 100_000, "you idiot " * 20_000 + "."]
    grammar = toxicity.Grammar(model)
    assert all(abs(grammar.evidence(t) - by_hand(model, t)) < 1e-9 for t in texts)
    held = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: r["x"] for r in docs.select("doc_id", toxicity.evidence(F.col("text"), model).alias("x")).collect()}
    assert all(abs(got[r["doc_id"]] - by_hand(model, r["text"])) < 1e-9 for r in held)


def test_toxicity_over_empty_partitions_null_ids_and_repeats(spark):
    rows = [(None if i % 3 else i, f"You are a grumblefink{i % 4}. w{i}" if i % 2 else f"The end w{i}", i % 2, "s") for i in range(60)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string").repartition(150)
    model = toxicity.train(df, max_rows=1000)
    got = toxicity.score(df, model).collect()
    assert len(got) == 120 and all(r["predicted"] == r["toxic"] for r in got)
    assert toxicity.matches(df, model).count() == 60


def test_toxicity_on_held_out_rows(spark, small):
    folder = small.replace("sf0.001", "sf0.1")  # smaller ones have too few labels; a sixth of the toxic ones are noise here
    got = QUERIES["op2_toxicity"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    toxic, clean = [[r["predicted"] for r in got if r["toxic"] == y] for y in (1, 0)]
    assert len(toxic) >= 10 and sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_language_contract(spark, small):
    texts = ["² ½ ³", "१२", "№ ٣", "a²", "中文", None, ""]
    model = langid.train(spark.createDataFrame([(None, f"the quick brown fox {i}", "en") for i in range(40)] + [(i, "der schnelle braune fuchs", "de") for i in range(40)], "doc_id long, text string, lang string"))
    assert [k for k, _ in model.dictionaries] == ["de", "en"]
    got = [r["lang_pred"] for r in langid.identify_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert [x == "und" for x in got] == [True, True, True, False, False, True, True]


def test_language_on_held_out_rows(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    got = QUERIES["op9_language_id"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    told = [r["lang_pred"] == r["lang"] for r in got if r["lang"] is not None and r["lang_pred"] != "und"]
    assert len(told) >= 150 and sum(told) >= 0.97 * len(told)


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def test_pseudonyms(spark, odd_docs, empty):
    texts = ["mail a.b23@mail7.example.com", "+1 (363) 555-6578 or 363-555-6578", "71.159.176.88", "4586479686998659", "4111 1111 1111 1111", "1985-02-17 17.02.1985 99.99.1999", "123-45-6789", "DE89 3704 0044 0532 0130 00", "password=e3b3ed3cc8548923d6", "4586479686998658", "999.1.1.1", "no data at all"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a = [r["text"] for r in pii.pseudonymise(df, "one").orderBy("doc_id").collect()]
    b = [r["text"] for r in pii.pseudonymise(df, "one").orderBy("doc_id").collect()]
    c = [r["text"] for r in pii.pseudonymise(df, "two").orderBy("doc_id").collect()]
    assert a == b and all(x != y and x != z for x, y, z in zip(a[:9], texts, c)) and a[9:] == texts[9:]
    assert all(luhn(x) % 10 == 0 for x in a[3:5]) and a[1][4:].replace("(", "").replace(") ", "-").split(" or ")[0] == a[1].split(" or ")[1]
    first, second, kept = a[5].split()
    assert first.split("-")[::-1] == second.split(".") and kept == "99.99.1999" and all(int(x) < 256 for x in a[2].split("."))
    odd = pii.pseudonymise(odd_docs, "k")
    assert odd.count() == 9 and odd.where("n_pseudonyms > 0").count() == 0 and odd.where("text is null").count() == 1 and pii.pseudonymise(empty, "k").count() == 0


def test_long_secrets_are_replaced_whole(spark):
    rows = [(n, "token=" + "aB3" * n + " end") for n in (60, 100, 5000)]
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").orderBy("doc_id").collect()
    for (n, old), r in zip(rows, got):
        assert len(r["text"]) == len(old) and r["n_pseudonyms"] == 1 and r["text"].startswith("token=") and r["text"].endswith(" end")
        # Letters and digits that stay are chance: 1 of 26 or 1 of 10.
        tail = [a == b for a, b in zip(r["text"][-94:-4], old[-94:-4])]
        assert sum(tail) < 30


def test_cards_beside_short_numbers(spark):
    texts = ["4111111111111111 123", "4111111111111111 12/27", "4111 1111 1111 1111 123", "12 4111-1111-1111-1111", "4111111111111111", "4111111111111112 123"]
    got = [r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    card = got[4]
    spelled = " ".join(card[i : i + 4] for i in range(0, 16, 4))
    assert card != texts[4]
    assert got == [f"{card} 123", f"{card} 12/27", f"{spelled} 123", "12 " + spelled.replace(" ", "-"), card, texts[5]]


def replaced(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pii.pseudonymise(df, key).orderBy("doc_id").collect()]


def test_spellings_of_one_value_stay_linked(spark):
    phones = replaced(spark, ["+49 30 1234567", "+493012 34567", "+49-30-123-4567", "030 1234567", "(030) 1234567", "030/1234567", "Tel: 030 123 4567"])
    digits = ["".join(c for c in x if c.isdigit()) for x in phones]
    assert digits[0].startswith("49") and len({x.removeprefix("49") if i < 3 else x.removeprefix("0") for i, x in enumerate(digits)}) == 1 and "1234567" not in "".join(digits) and phones[6].startswith("Tel: 0")
    a, b, c, d = replaced(spark, ["Anna.Bo7@Example.org", "anna.bo7@example.org", "café@example.com", "x@bücher.example.com"])
    assert a.lower() == b != "anna.bo7@example.org" and a[0].isupper() and b.endswith(".org") and "café" not in c and "bücher" not in d
    a, b = replaced(spark, ["token=deadbeef01", "token=DEADBEEF01"])
    assert a.lower() == b.lower() != "token=deadbeef01" and b[6:].upper() == b[6:]
    a, b = replaced(spark, ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"])
    assert a.replace(" ", "") == b


def test_plain_numbers_stay(spark):
    texts = ["rows 10 200 300 of 12 345 678 900", "1 234 567", "2001 2002 2003 2004", "3.141.592.653", "v1.2.3", "10-20-30", "08 30 45", "pages 100-200", "5551234567", "1999-2000 2001"]
    assert replaced(spark, texts) == texts


def test_adjacent_values_are_found_apart(spark):
    a, b, c = replaced(spark, ["+1 (980) 555-6268 151.159.223.204", "+1 (980) 555-6268", "151.159.223.204"])
    assert a == f"{b} {c}"


def test_long_text_clashing_names_and_a_key_out_of_sight(spark, capsys):
    long = "word " * 60_000 + "a.b@example.com " + "1" * 50_000
    df = spark.createDataFrame([(long, "f", "n", "k", 5), (None, "f", "n", "k", 5)], "text string, __found string, __new string, __key string, n_pseudonyms int")
    got = pii.pseudonymise(df, "a-very-secret-key")
    rows = got.collect()
    assert sorted(got.columns) == sorted(df.columns) and {r["n_pseudonyms"] for r in rows} == {0, 1} and all((r["__found"], r["__new"], r["__key"]) == ("f", "n", "k") for r in rows)
    new = next(r["text"] for r in rows if r["text"])
    assert len(new) == len(long) and "a.b@example" not in new and new[:300_000] == long[:300_000]
    got.explain("extended")
    assert "a-very-secret-key" not in capsys.readouterr().out


def test_pseudonyms_are_a_permutation(spark):
    every = spark.range(1000).select(F.array((F.col("id") / 100).cast("long"), (F.col("id") % 100 / 10).cast("long"), F.col("id") % 10).alias("v"))
    assert every.select(pii.feistel(F.col("v"), F.array(*[F.lit(10).cast("long")] * 3), F.lit("k"), "t").alias("x")).distinct().count() == 1000


def test_licences(spark, odd_docs, empty):
    name, whole = licenses.LICENSES[1]
    rows = [(1, "Copyright (c) 2020 Somebody\n\n" + whole.upper().replace(", ", " , ")), (2, whole + " And more."), (3, "Some text.\nlicensed under the APACHE licence, version 2.0\nmore"), (4, None)]
    l, n = licenses.known(spark, licenses.LICENSES), licenses.known(spark, licenses.NOTICES)
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), l, n).collect()}
    assert (got[1]["license"], got[2]["license"], got[3]["license"], got[3]["notices"], got[4]["notices"]) == (name, None, None, ["Apache-2.0"], [])
    texts = {k: t for k, t in licenses.LICENSES}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"} == set(texts)
    planted = [(i, ("\n\n* " + t.replace("license", "licence").upper().replace(", ", " , ")) if i % 2 else t + "  \n", "x") for i, t in enumerate(texts.values())]
    planted += [(100 + i, t[: len(t) // 2], "x") for i, t in enumerate(texts.values())]
    got = licenses.scan(spark.createDataFrame(planted, "doc_id long, text string, license string"), l, n).orderBy("doc_id").collect()
    assert [r["license"] for r in got] == [*texts, *[None] * len(texts)]
    odd = licenses.known(spark, [('A "quoted" \\ name', "long notice " * 90)])
    row = licenses.scan(spark.createDataFrame([(1, "one\n" + "long notice " * 90 + "\ntwo")], "doc_id long, text string"), l, odd).first()
    assert row["notices"] == ['A "quoted" \\ name']
    assert licenses.scan(odd_docs, l, n).where("license is null").count() == 9 and licenses.scan(empty, l, n).count() == 0


def test_simhash_edges_and_neighbours(spark, odd_docs, empty):
    got = simhash.edited_neighbours(odd_docs.select("doc_id", "text"), blocks=4).collect()
    assert len(got) == 9 and simhash.edited_neighbours(empty).count() == 0
    same = {(r["fp_a"], r["fp_b"]) for r in got if r["doc_id"] in (0, 4)}
    assert len(same) == 1 and {(r["fp_a"], r["fp_b"]) for r in got if r["doc_id"] in (1, 2, 6)} == {(0, 0)}
    one = simhash.edited_neighbours(odd_docs.where("doc_id = 0")).first()
    assert (one["next_a"], one["next_b"]) == (one["fp_a"], one["fp_b"])
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 40)]
    prints = {(x, y) for x in base[:20] for y in base[20:22]}
    prints |= {(x ^ sum(1 << int(b) for b in rng.choice(60, rng.integers(1, 9), replace=False)), y) for x, y in list(prints)}
    near = lambda p, q: bin((p[0] ^ q[0]) & (1 << 64) - 1).count("1") + bin((p[1] ^ q[1]) & (1 << 64) - 1).count("1") <= 6
    want = {(p, q) for p in prints for q in prints if p < q and near(p, q)}
    rows = simhash.near_pairs(spark.createDataFrame([*prints, *prints, (None, 1)], "fp_a long, fp_b long"), 6).collect()
    assert {((r["a1"], r["b1"]), (r["a2"], r["b2"])) for r in rows} == want
    table = spark.createDataFrame([*prints, *prints, (None, 1)], "fp_a long, fp_b long")
    number = {p: sum(p in pair for pair in want) for p in prints}
    for block in (3, 256):
        got = simhash.near_counts(table, 6, block=block).collect()
        assert {(r["fp_a"], r["fp_b"]): r["n_near"] for r in got} == number and len(got) == len(prints)
    assert simhash.near_counts(table.limit(0), 6).count() == 0


def test_bits_are_weighted_votes(spark, docs):
    """The fingerprint's bits, counted word by word from the terms' hashes."""
    rows = docs.select("doc_id", F.transform(simhash.terms(F.col("text")), lambda t: F.struct(F.xxhash64(t, F.lit(1)).alias("a"), F.xxhash64(t, F.lit(2)).alias("b"), F.least(F.length(t), F.lit(simhash.HEAVIEST)).alias("w"))).alias("t")).collect()
    want = {}
    for r in rows:
        bits = []
        for name in "ab":
            out = 0
            for bit in range(64):
                votes = sum(t["w"] if t[name] >> bit & 1 else -t["w"] for t in r["t"])
                out |= (votes > 0) << bit
            bits.append(out - (1 << 64) if out >= 1 << 63 else out)
        want[r["doc_id"]] = tuple(bits)
    got = {r["doc_id"]: (r["fp_a"], r["fp_b"]) for r in simhash.edited_neighbours(docs).collect()}
    assert got == want


def test_simhash_broadcasts_no_fingerprints(spark, small):
    from tessera.llm.queries import QUERIES

    got = QUERIES["op7_simhash"](spark, small)
    near = simhash.near_counts(spark.range(50).selectExpr("id as fp_a", "id as fp_b"))
    assert not any("BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString() for df in (got, near))
