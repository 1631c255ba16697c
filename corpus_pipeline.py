"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again before the next.

All stages take the columns of ``documents`` and give these alone, the last one but the text's ids in place of the text;
further columns of the input, whatever their names, are left behind.  Texts of any length are worked on whole, order
and ties don't matter, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, jaccard, langid, mixing, secrets
from plumbline.llm.queries import tokenizer, training_rows
from plumbline.sources.scratch import materialise, release

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Predict each document's language from its text; documents without one (``und``) go, ``lang`` is the prediction.

    A null text, or one without a letter, has no language; without any labelled text nothing has.  A null id, source or
    language doesn't matter, repeated rows go or stay each.
    """
    named = langid.identify(spark, docs, langid.train(training_rows(docs)))
    return named.where("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles at 0.8, the one with the smallest id stays, once.

    Rows that share an id stay with each of their texts if the id does.  Documents without an id stay, equal texts once.
    Empty and null texts are linked with nothing, so they stay.
    """
    first = jaccard.shingle_join(docs).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    named = docs.join(first, docs["doc_id"] == first["kept_id"]).select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null").select(*COLUMNS).dropDuplicates(["text"]))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind of secret in the place of each one found; every document stays, also repeated rows.

    A null text stays null, with a null count of characters.
    """
    masked = secrets.redact(secrets.find_secrets(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by target weights: a document comes as often as it is taken, 0 to 3 times.

    A null source is one of its own, last in order.  A text without words is never taken.  Repeated rows are taken
    together.
    """
    return mixing.mixed(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as little-endian unsigned 32-bit integers; a null text has none."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer("byte_bpe_50k.json"))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mask_secrets", mask_secrets), ("mix_sources", mix_sources), ("tokens", tokens)]

#: Models, 64-bit shingle joins and BPE aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is in the shared folder."""
    docs = read = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = materialise(stage(spark, docs, sf_dir), tag=f"pipeline-{name}")
        if docs is not read:
            release(docs)
        docs = out
    return docs
