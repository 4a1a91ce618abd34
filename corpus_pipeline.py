"""Five stages from raw documents to tokens. Each takes (spark, docs, sf_dir) and returns a DataFrame; each is written
as Parquet and read again before the next. All but the last keep the columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmark.llm import mixing, ngram_join, pii, quality_rules, word_bpe
from glossmark.llm.common import documents, scratch_folder
from glossmark.llm.queries import tokenizer_definition

#: Near copies share five-word shingles to this percent.
WIDTH, PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Rows of one key stay or go by their own text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_rules.accepted(docs, labels)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return ngram_join.one_of_each(docs, WIDTH, PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and telling terms replaced; n_chars counts the new text."""
    return pii.sanitised(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the digests of ids and decoded text, for each row."""
    return word_bpe.encode(docs, tokenizer_definition(), keep=("source",))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_copies),
    ("PII", personal_data),
    ("mixing sources", source_mix),
    ("BPE", tokens),
]

#: Trees, lasso weights, tokenizer merges and components are beyond SQL: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with a table in the shared folder between them."""
    docs, folder = documents(spark, sf_dir), f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for step, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{step}")
        docs = spark.read.parquet(f"{folder}/{step}")
    return STAGES[-1][1](spark, docs, sf_dir)
