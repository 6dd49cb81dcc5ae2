"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.llm import byte_bpe, jaccard_join, line_dedup, mixing, quality_crf
from pactlake.llm.common import discard, materialize, table

#: Labels are learned from documents whose crc32(doc_id) leaves another remainder.
LABEL_FOLDS, HELD_OUT = 3, 1
#: No source repeats more often than this while every source is read in full.
REPETITION_LIMIT = 2.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF scores under 0.5 go."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % LABEL_FOLDS
    model = quality_crf.fit(docs, table(spark, sf_dir, "labels").filter(fold != HELD_OUT))
    return quality_crf.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go; documents that lost lines and have nothing but blank ones left go with them.

    n_chars, where there is such a column, follows the text.
    """
    found = line_dedup.dedup_lines(docs)
    kept = found.filter((F.col("_n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates stays."""
    return jaccard_join.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources again as their weight asks."""
    return mixing.realise(docs, repetition_limit=REPETITION_LIMIT)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixed texts, with hashes of the ids and of the decoded bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_decode(docs, path, public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]

#: The trained model and the line and set joins have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`: doc_id, n_tokens, ids_sha256, decoded_sha256 and token_ids of every row of the mix.

    A null text scores as an empty one, has no lines and no shingles, and counts no tokens; so has an empty one. Very long
    texts are read whole by every stage. Repeated rows are one document to the line and shingle stages, stay as often as
    they stand where they are kept, and tie in the mix. An empty table gives an empty result. Without labels of both values every
    document scores 0.5 and stays. Further columns, whatever their names, pass through all stages but the last, which
    does not read them.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
