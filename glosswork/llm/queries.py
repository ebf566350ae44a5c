"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm import (
    bpe_tree, code_index, hash_ring, language_id, line_dedup, packing, page_text, passages, pii, quality, simhash,
    token_alignment, token_counts, whitening)
from glosswork.llm.common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query("op2_line_quality")
def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(documents(spark, sf_dir))


@query("op3_tree_bpe")
def op3_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_tree.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), result="digest")
    return coded.withColumnRenamed("id", "doc_id")


@query("op4_pii_spans")
def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(documents(spark, sf_dir))


@query("op5_text_density")
def op5_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op6_hash_ring")
def op6_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hash_ring.sharded_documents(documents(spark, sf_dir))
    return found.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


@query("op7_bounded_packing")
def op7_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), F.col(
        "tokens").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset")


@query("op8_line_dedup")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.dedup(documents(spark, sf_dir).select("doc_id", "text"), words=51, units=line_dedup.Units("line", 51))
    return found.select("doc_id", "text", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"),
                        F.size("cut").cast("long").alias("n_removed"), F.array_join(F.transform("cut", lambda s: F.concat_ws(
                            ":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("removed"))


@query("op9_simhash_components")
def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), words=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query("op10_code_index")
def op10_code_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_index.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, most=20)


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), most=8)
    # a sum beyond a long has no value in this digest; the operator itself returns a decimal
    return found.withColumnRenamed("id", "vec_id").withColumn("deviation", F.col("deviation").try_cast("long"))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


@query("op11_language_id")
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn(
        "held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2)
    model = language_id.learn(docs.where(~F.col("held_out")).select("lang", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")
