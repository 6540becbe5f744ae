"""Corpus preparation: each stage works on all that the one before has kept, written as Parquet and read again.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``; the last one encodes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caretrace.llm.common import staged, table
from caretrace.llm.exact import drop_exact_duplicates
from caretrace.llm.minhash import drop_near_duplicates
from caretrace.llm.mixing import apply_mix, mix_sources
from caretrace.llm.pieces import encode_documents
from caretrace.llm.quality import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below 0.3 go.

    Null and empty texts are scored like any other, long ones whole; rows that repeat an id or a text, and rows without an
    id, are scored each for itself. An empty table stays empty; other columns, whatever their names, are kept.
    """
    return keep_quality(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays.

    Null counts as empty, empty texts are a group like any other. Of rows that repeat id and text one stays, rows without
    an id lose to any id. An empty table stays empty; other columns are kept.
    """
    return drop_exact_duplicates(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays.

    Texts without a word are linked with nothing and stay. Of rows that repeat an id and a text one stays, rows without an
    id come after all others. Long texts count whole. An empty table stays empty; other columns are kept.
    """
    return drop_near_duplicates(docs, percent=85)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: no row, one or two.

    Documents without a word are taken as often as the whole part of their source's share says. A null source is a source,
    the last one; rows that repeat an id and a text are taken together. An empty table stays empty; other columns are kept.
    """
    return apply_mix(docs, staged(mix_sources(docs, weights=(5, 2, 1), share=1.5, most=2.0)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, begins, ends, ids_sha256, decoded_sha256) of every row of the mix, repeats included.

    ``begins`` and ``ends`` are the span of each piece in bytes of the text. Null and empty texts are the end id alone; long texts are encoded whole; null ids and sources are handed through. An
    empty table gives an empty result.
    """
    encoded = encode_documents(docs.withColumn("key", F.struct("doc_id", "source")), public_tokenizers.path("piece_bpe_32k.model"), id_col="key")
    return encoded.select(
        "key.doc_id",
        "key.source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        "begins",
        "ends",
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]
#: A trained classifier and random rounding are not SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
