"""Registered queries of this subpackage, opN_<name>, over whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from recallframe.llm import bpe, fertility, ids, lines, merkle, mixing, phrases, ranking, rollup, shard, simhash, toxicity, urls
from recallframe.llm.text import word_count
from recallframe.session import cut, shared_dir, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, "text", RANKS, PATTERN).drop("text")
    return bpe.digests(bpe.decode(coded, "token_ids", RANKS, PATTERN))


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shard.assign(narrow, ["doc_id", "size", "text_crc32"], n_shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs)


def op4_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = fertility.judge(docs, "text", PIECES, "lang")
    return judged.select("doc_id", *fertility.BASE, "base_failed", "kept", "reason", *fertility.MEASURES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(rows, share=1.5, weights=(3, 1, 2), cap=2)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


URL_RULES = [
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
]


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "ratio")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(simhash.fingerprints(docs))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents under two tokenizers, takes out those labelled low in quality, moves one tokenizer on, and delivers each batch twice."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        "doc_id", "source", "lang", "text", F.length(text).cast("long").alias("n_chars"), F.octet_length(text).cast("long").alias("n_bytes"), word_count(F.col("text")).alias("n_words")
    )
    counted = cut(bpe.count_tokens(sized, "text", RANKS, PATTERN))

    def under(rows: DataFrame, tokenizer: str, count: str) -> DataFrame:
        return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(count).alias("n_tokens"), "n_chars")

    low = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    poor, good = counted.join(low, "doc_id", "left_semi"), counted.join(low, "doc_id", "left_anti")
    both = lambda rows: under(rows, "byte_bpe_50k", "n_tokens").unionByName(under(rows, "words_v1", "n_words"))
    batches = {
        "load": rollup.inserted(both(counted)),
        "low-quality": rollup.deleted(both(poor)),
        "words-to-bytes": rollup.revised(under(good, "words_v1", "n_words"), under(good, "utf8_bytes_v1", "n_bytes")),
    }
    totals = rollup.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    for batch_id, changes in [*batches.items(), *batches.items()]:
        totals.commit(batch_id, changes)
    return totals.totals()


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents to files and digests what is read back from them."""
    folder = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    ids.write(table(spark, sf_dir, "documents"), folder, TOKENIZER, end=0)
    return ids.digests(spark, folder).withColumnRenamed("doc", "doc_id")


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best collocations."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_shard": op2_shard,
    "op3_lines": op3_lines,
    "op4_fertility": op4_fertility,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_urls": op7_urls,
    "op8_simhash": op8_simhash,
    "op9_token_counts": op9_token_counts,
    "op10_merkle": op10_merkle,
    "op11_ids": op11_ids,
    "op12_ranking": op12_ranking,
    "op13_phrases": op13_phrases,
}
ORACLES: dict[str, str] = {"op2_shard": shard.oracle(16, 1), "op3_lines": lines.ORACLE, "op12_ranking": ranking.ORACLE, "op13_phrases": phrases.ORACLE}
