"""The corpus pipeline: five operators of the llm subpackage, one after another.

Each stage takes what its predecessor kept, and all but the last return the
columns of ``documents``. ``run`` writes each stage's rows to the shared folder
and reads them again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallframe.llm import bpe, lines, mixing, queries, simhash_wide, toxicity
from recallframe.llm.text import word_count
from recallframe.session import delete, scratch, shared_dir, table

#: A document goes if its score reaches this.
TOXIC = 0.5
#: Words of a shingle; copies of a similarity of 0.8 or more on these are near copies.
SHINGLE = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject. Learns from labels that aren't held out, on the stage's own documents."""
    model = toxicity.train(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, keep=True).where(F.col("score") < TOXIC).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less lines of recurring templates; n_chars follows the text."""
    cleaned = lines.dedup_lines(docs)
    counted = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", counted).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id (null last), of one id that with the smallest hash of the text."""
    return simhash_wide.one_of_each(docs, "doc_id", "text", SHINGLE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; told apart by id and text, as ids may be null or repeat."""
    keyed = docs.withColumn("__doc", F.xxhash64("doc_id", "text", "source"))
    mixed = mixing.mix(keyed.select(F.col("__doc").alias("doc_id"), "source", word_count(F.col("text")).alias("size")), share=1.5, weights=(3, 1, 2), cap=2)
    return mixing.mixed(keyed, mixed.select(F.col("doc_id").alias("__doc"), "copies"), "__doc").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, token ids and their number."""
    coded = bpe.encode(docs.select("doc_id", "source", "lang", "text"), "text", queries.RANKS, queries.PATTERN).drop("text")
    return coded.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe_encoding", encode),
]

#: Trained models and Newton steps have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's input and intermediate tables go once its rows are written."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            delete(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    return docs
