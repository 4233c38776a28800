"""From raw documents to token ids: five stages, each over all that the one before kept.

Stages take nulls in any column, empty and very long texts, repeated rows and further
columns, and give an empty table for an empty table. All but the last return the columns
that they are given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_fusion.llm import parity_join, secret_links, sentence_pieces, template_leaks, word_language
from catalog_fusion.llm.tables import table
from catalog_fusion.scratch import materialize

#: Share of a text's words that its language has at least: most of them. Texts without letters have 0.
LANGUAGE_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which replaces ``lang``."""
    training = word_language.Training()
    sample = word_language.sample_labelled(docs.where(~word_language.held_out()), training)
    model = word_language.fit_language_field(sample, training)
    judged = word_language.identify_languages(docs, model, F.struct(*[docs[c] for c in docs.columns]))
    columns = [F.col("lang_pred" if c == "lang" else f"key.`{c}`").alias(c) for c in docs.columns]
    return judged.where(F.col("score") >= LANGUAGE_SHARE).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return parity_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return template_leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets and linked credentials masked."""
    return secret_links.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    key = F.struct("doc_id", "lang", "source")
    rows = sentence_pieces.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), key)
    return rows.select("key.*", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("SentencePiece encoding", token_ids),
]

#: The stages are models, iterations and tokenizers, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
