import pytest

from tessera.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, small, duck, same, name):
    same(queries.QUERIES[name](spark, small), duck.sql(queries.ORACLES[name]))


def test_language_and_toxicity_on_held_out_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    got = queries.op9_language_id(spark, small).join(docs, "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.9 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in queries.op2_toxicity(spark, small).collect())


def test_nearest_neighbours_recall(spark, small):
    import numpy as np

    rows = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    v, ids = np.array([r["embedding"] for r in rows], dtype=float), [r["vec_id"] for r in rows]
    got = {}
    for r in queries.op1_ann(spark, small).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((v - v[ids.index(q)]) ** 2).sum(1))
        d[ids.index(q)] = np.inf
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11)) and all(abs(d[ids.index(i)] - s) < 1e-12 for _, i, s in found)
        hits += len({ids[i] for i in np.argsort(d, kind="stable")[:10]} & {i for _, i, _ in found})
    assert len(got) == 5 and hits >= 0.9 * 10 * len(got)


def test_edited_texts(spark, small):
    import hashlib

    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    got = {r["doc_id"]: r for r in queries.op7_simhash(spark, small).collect()}
    by_text = {}
    for i, (k, t) in enumerate(rows):
        n = len(t)
        edited = t[: n - n // 2] + rows[(i + 1) % len(rows)][1][: n // 2]
        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[k]["n_chars"] == n
        assert by_text.setdefault(t, got[k]["fingerprint"]) == got[k]["fingerprint"]
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) > 0.95 * len(got)
