"""The registered queries of the corpus operators, with the parameters meant for production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, langid, licenses, mixing, neardup, packing, pii, simhash, toxicity, urlfilter
from tessera.llm.common import materialise, remainder, table
from tessera.llm.oracles import ORACLES  # noqa: F401

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
SOURCE_WEIGHTS = [5.0, 2.0, 1.0]
#: Stands in for a secret that a deployment passes to ``pii.pseudonymise`` itself.
PII_KEY = "tessera-pseudonyms"


def word_tokenizer() -> str:
    """The public word-level vocabulary's file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest found of every vector whose id is divisible by 100, by exact distance.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows of null id. Ties go to
    the smaller id; of repeated ids the first by value counts. Empty tables give no rows; other columns are not read.
    """
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document, learned from labelled rows that are not held out.

    Null and empty texts get the score of a text without hits. Rows of null id are scored, and neither held out nor
    learned from; repeated rows stay. Without labels of both kinds the given words alone score.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    hashed = docs.withColumn("__hash", toxicity.sample_hash(F.col("doc_id"), F.col("text")))
    model = toxicity.train(hashed.join(labels, "doc_id"), hash_col="__hash")
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms for personal data; null and empty texts stay, repeated rows too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY).select("doc_id", "text", "n_pseudonyms")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes.

    A null text has size 0, a null source is one like any other, and a null id a bucket of its own. Repeated rows each
    count. Ties of sources are told apart by code point; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    docs = materialise(docs)
    sources = materialise(mixing.cycled_weights(mixing.sources_of(docs), SOURCE_WEIGHTS))
    got = mixing.mix(docs, mixing.water_fill(sources, share=1.5, max_epochs=2.0))
    return got.select("doc_id", "size", "source_size", "target", "taken")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document and whether it is the one kept; see ``neardup.near_duplicates``."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each whole text, the licence with that digest, and the licences that its lines name.

    Null, empty and blank texts have the empty text's digest and no licence; repeated rows stay.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = licenses.scan(docs, licenses.known(spark, licenses.LICENSES), licenses.known(spark, licenses.NOTICES))
    return got.select("doc_id", "text_digest", "license", F.array_join("notices", ",").alias("notices"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text, their likeness, and how many other fingerprints are near.

    A null text counts as empty; a text without words has no bit set. Null ids come first, ties go by text, repeated
    rows follow each other, and a lone document is its own next one. An empty table gives no rows.
    """
    got = materialise(simhash.edited_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text")))
    near = materialise(simhash.near_counts(got, radius=6))
    got = got.join(near.toDF("__a", "__b", "n_near").hint("merge"), (F.col("fp_a") == F.col("__a")) & (F.col("fp_b") == F.col("__b")))
    own, edited, following = [(F.col(f"{k}_a"), F.col(f"{k}_b")) for k in ("fp", "edited", "next")]
    return got.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        simhash.shown(*own).alias("fingerprint"),
        simhash.shown(*edited).alias("edited_fingerprint"),
        simhash.likeness(*own, *edited).alias("near_edited"),
        simhash.likeness(*own, *following).alias("near_next"),
        "n_near",
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of each page's url.

    A null url, and one without ``://``, has an empty host and path, no rule, and is allowed. Repeated rows stay; an
    empty table gives no rows; only ``page_id`` and ``url`` are read.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = urlfilter.fit(pages, spark.createDataFrame(URL_RULES, "rule string, verdict string"))
    return urlfilter.judge(pages, model).select("page_id", "host", "path", "rule", "verdict")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from rows that are not held out.

    Null texts and texts without a letter are ``und`` with score 0. Rows of null id are not held out; repeated rows
    stay. Equal sizes go to the first language by code point; without labelled rows all are ``und``.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.train(docs.where(~held_out))
    got = langid.identify_languages(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_margin", "lang_rejected")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of at most 2048 tokens.

    Null and empty texts are one end token; repeated rows are packed each, rows of null id as well. Sequences are
    numbered within the scan's partitions, so another split of the same files gives other numbers.
    """
    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), word_tokenizer(), size=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {
    "op1_ann": op1_ann,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_mixing": op4_mixing,
    "op5_neardup": op5_neardup,
    "op6_licenses": op6_licenses,
    "op7_simhash": op7_simhash,
    "op8_url_filter": op8_url_filter,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
}
