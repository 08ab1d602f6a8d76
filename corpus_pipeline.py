"""From raw documents to packed training sequences; each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm import langid, line_dedup, near_dedup, packing
from ratelens.llm.common import fresh, table
from ratelens.session import materialize

#: A document whose best language has less than this probability is rejected, as is one without a letter.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of no clear language. `lang` stays as it was given.

    A null or an empty text goes. Repeated rows are judged alike, a very long text whole; other columns, whatever their names, are
    passed on. Without any labelled row no language is known and every document goes; an empty table gives an empty one.
    """
    found = langid.language_column(docs, langid.fit(docs))
    sure = found["lang_pred"].isNotNull() & (found["lang_pred"] != langid.UNKNOWN) & (found["score"] >= LEAST_SCORE)
    (kept,) = fresh(docs, "sure")
    return docs.withColumn(kept, sure).where(F.col(kept)).drop(kept)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages of lines; no document goes.

    Null texts stay null, empty ones empty; of repeated rows each is treated alike. A column `removed_lines` is dropped, all others are passed on;
    `n_chars` is counted anew. Ties cannot arise, as the first place of a passage is the smallest document and line.
    """
    return line_dedup.remove_repeated_lines(docs).drop("removed_lines")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies.

    The one with the smallest id stays, of repeated rows any one; equal texts, also empty ones, are a group. Null texts stay. Very long texts are
    compared whole; all columns are passed on, whatever their names; an empty table gives an empty one.
    """
    return near_dedup.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place; ids as a checksum.

    Null and empty texts are one piece of the end token. Repeated rows are packed each by itself; a text longer than a sequence is cut into
    pieces. Other columns are not passed on; an empty table gives an empty one.
    """
    packed = packing.pack(docs)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: The classifier, the sketches and the tokenizer have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`; what a stage returns is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
