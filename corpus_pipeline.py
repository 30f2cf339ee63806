"""A cleaning pipeline over documents: toxicity, near duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. All take nulls in any column, empty and very long texts,
repeated rows and further columns; an empty table stays empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.llm import bpe, decontaminate, pii, simhash, toxicity
from kinespark.llm.common import discard, shared_folder, table
from kinespark.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted to the labels of this stage's documents, does not reject.

    Null and empty texts are scored as texts without words; equal texts are kept or dropped alike, repeated rows too.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id.

    Null texts and texts without words are copies of one another; of rows that repeat an id those whose texts are no
    copies stay; rows without an id go if a copy has one.
    """
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Null and empty texts have no words and stay; repeated rows are
    kept or dropped alike; without benchmark items all stay."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind; n_chars counts the new text.

    Null texts stay null, and so does their n_chars; no row is dropped.
    """
    return pii.redact_column(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes, a row for each row; null texts count as empty."""
    return bpe.round_trip(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("tokens", tokenize),
]

#: A fitted model, XXH64 and BPE are beyond SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what a stage leaves is written under spark.checkpoint.dir and read again.

    A stage's table is deleted once the next one is written; the last stage reads the last of them, which stays.
    """
    docs = table(spark, sf_dir, "documents")
    root = shared_folder(spark)
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{root}/pipeline-{uuid.uuid4().hex}-{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
            if before is not None:
                discard(before)
            before = docs
    return docs
