"""The corpus pipeline: language ID, near duplicates, personal data, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, mixing, neardup, packing, pii
from tessera.llm.common import bounded_batches, materialise, table
from tessera.llm.queries import PII_KEY, SOURCE_WEIGHTS, word_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL has no zstandard with dictionaries, so the first stage cannot be put in it.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; ``lang`` becomes what was found.

    Null texts and texts without letters are rejected. Rows of null id and repeated rows are judged like others; without
    any labelled row all are rejected. An empty table stays empty; columns beside those of documents go.
    """
    bounded_batches(spark)
    model = langid.train(docs.select("doc_id", "text", "lang"))
    got = langid.identify_languages(docs.select(*COLUMNS), model)
    return got.where(~F.col("lang_rejected")).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id.

    Of repeated rows one stays. Rows of null id stay once for each shingle set that no row with an id has; rows without
    shingles once for each id. An empty table stays empty; columns beside those of documents go.
    """
    bounded_batches(spark)
    return neardup.one_of_each(docs.select(*COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms and ``n_chars`` counted anew.

    Null and empty texts stay, rows of null id and repeated rows too; columns beside those of documents go.
    """
    return pii.pseudonymise(docs.select(*COLUMNS), PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those that it does not take go.

    A null source is one like any other, a null id a bucket of its own; repeated rows are taken each. A text without
    words has size 0 and follows its bucket. An empty table stays empty; columns beside those of documents go.
    """
    sized = docs.select(*COLUMNS, mixing.word_count(F.col("text")).alias("size"))
    small = materialise(sized.select("doc_id", "source", "size"))
    sources = materialise(mixing.cycled_weights(mixing.sources_of(small), SOURCE_WEIGHTS))
    mixed = mixing.mix(sized, mixing.water_fill(sources, share=1.5, max_epochs=2.0))
    return mixed.where("repeats > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as packed pieces of token ids.

    Null and empty texts are one end token; rows of null id and repeated rows are packed each. An empty table gives no
    pieces.
    """
    bounded_batches(spark)
    return packing.pack(docs, word_tokenizer(), size=2048, end_id=1)


STAGES = [
    ("language_id", language_stage),
    ("minhash_neardup", neardup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each over what the one before it wrote.

    Nulls, ties, repeated rows and empty tables fare as each stage says; extra columns go in the first.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
