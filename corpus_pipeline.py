"""A corpus pipeline of five operators: from documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes what a stage returns
as Parquet in the shared checkpoint folder, reads it again as the next one's docs, and removes it
once the stage after it is written.

Language ID drops documents whose language is not known; line dedup shortens texts; SimHash keeps
the document of smallest doc_id of each group of near copies; mixing repeats or leaves out rows
towards the target weights; byte-level BPE encodes what is left.

Every stage takes nulls in any column, empty and very long texts, repeated rows, an empty table and
further columns; what it does with them is said below.

Text goes to Python in Arrow batches of about 2 MB, or of one longer text (``shared.small_batches``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vektorium.llm import bpe, langid, line_dedup, mixing, shared, simhash_jaccard

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents' own lang column; texts without a letter or with a score under 0.5 go.

    Null texts have no letter and go; a null lang is not learned from but predicted; where no row has a
    lang, every text with a letter stays; repeated rows stay or go together.
    """
    shared.small_batches(spark)
    return langid.accepted(docs, langid.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that match an earlier one (Jaccard 0.8), in order of doc_id, then place; n_chars follows the text.

    All rows stay; a text may become empty, a null text stays null (and n_chars with it); of repeated rows the
    first keeps its lines; a null doc_id comes before all others.
    """
    shared.small_batches(spark)
    out = line_dedup.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays; SimHash finds pairs, which must have Jaccard 0.8 or more of five-word shingles.

    The smallest doc_id stays; null, empty and blank texts are copies of one another; rows without doc_id stay;
    of rows that share doc_id and text one stays.
    """
    shared.small_batches(spark)
    return simhash_jaccard.representatives(docs, words=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out rows so that sources come near their targets.

    A null source is a source, the last one; null texts have size 0; equal rows stand for one another.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every row; a null text counts as empty."""
    import public_tokenizers

    shared.small_batches(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("language_id", language_id), ("line_dedup", lines), ("simhash", near_copies), ("mixing", mix), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    shared.prepare(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = shared.table(spark, sf_dir, "documents"), None
    with shared.settings(spark, **{shared.BATCH_KEY: spark.conf.get(shared.BATCH_KEY, str(shared.BATCH_BYTES))}):
        for k, (name, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}-{name}")
            docs = spark.read.parquet(f"{place}/{k}-{name}")
            if before:
                shared.remove(spark, before)
            before = f"{place}/{k}-{name}"
    return docs
