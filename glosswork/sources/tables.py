"""The Parquet tables as review tables: views that stand in for a review file."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.fixed_values import FIXTURE_THEMES

THEMES = [theme[0] for theme in FIXTURE_THEMES]
CELLS = ["T1_TABLE", "T2_SHOUTING", "T3_INSULT", "T5_SYMBOL_NOISE"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def theme_flags(text: Column, lowered: Column) -> dict[str, Column]:
    """0/1 per theme over the whole text. Plain texts are searched as bytes; only real patterns pay for
    a regular expression."""
    out = {}
    for name, needles, pattern, lower in FIXTURE_THEMES:
        where = lowered if lower else text
        hit = where.rlike(pattern) if pattern else None
        for needle in needles:
            test = F.contains(where, F.lit(needle))
            hit = test if hit is None else hit | test
        out[name] = hit.cast("int")
    return out


def coded_documents(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """One row per document: text-coded themes and plain columns, without the labels."""
    docs = table(spark, sf_dir, "documents").withColumn("_lowered", F.lower("text"))
    return docs.select(
        F.col("doc_id").alias("row_key"),
        F.col("source").alias("title"),
        *([F.col("text").alias("review_text")] if with_text else []),
        F.length("text").cast("bigint").alias("text_length"),
        F.col("lang").alias("division"),
        F.col("n_chars").cast("double").alias("n_chars"),
        F.when(F.col("doc_id") % 13 != 0, (F.col("n_chars") % 100).cast("double")).alias("age"),
        *[flag.alias(name) for name, flag in theme_flags(F.col("text"), F.col("_lowered")).items()],
    )


def reviews(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """The coded documents with a 1..5 rating (null if unlabelled).

    Themes are computed below the join, so only small columns are shuffled when the label table is
    too big to broadcast; the text travels only if asked for.
    """
    coded = coded_documents(spark, sf_dir, with_text)
    labels = table(spark, sf_dir, "labels")
    joined = coded.join(labels, F.col("row_key") == F.col("doc_id"), "left")
    quality, toxic = F.col("quality"), F.col("toxic")
    return joined.select(
        "row_key", "title", *(["review_text"] if with_text else []), "text_length", "division", "n_chars",
        (1 + 3 * quality + (1 - toxic)).cast("double").alias("rating"),
        F.when(quality.isNull(), "None").when(quality == 1, " Yes ").otherwise("no").alias("recommended_txt"),
        "age", *THEMES,
    )


def rated_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).na.drop(subset=["rating"])


def recorded_answers(coded: DataFrame) -> DataFrame:
    """Recorded labeller answers for coded rows: complete, cut off, or refused; with odd value types."""
    key, flag = F.col("row_key"), lambda name: F.col(name).cast("string")
    on = lambda name, yes, no: F.when(F.col(name) == 1, yes).otherwise(no)
    answer = (
        F.when(key % 11 == 0, "I cannot answer that")
        .when(key % 17 == 0, F.concat(F.lit('{"T1_TABLE": '), flag("T1_TABLE"), F.lit(', "T2_SHOUTING": ')))
        .otherwise(F.concat(
            F.lit('Sure! {"T1_TABLE": '), flag("T1_TABLE"),
            F.lit(', "T2_SHOUTING": "'), flag("T2_SHOUTING"),
            F.lit('", "T3_INSULT": '), on("T3_INSULT", "true", "false"),
            F.lit(', "T5_SYMBOL_NOISE": '), on("T5_SYMBOL_NOISE", "1.9", "0.4"),
            F.lit(', "T6_NUMBERS": "'), on("T6_NUMBERS", "1.0", "x"), F.lit('"} Done.')))
    )
    return coded.select("row_key", answer.alias("response"))


def priced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer: a larger table with a 1..5 target, categories and numbers."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("row_key"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("rating"),
        F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("balance"),
        F.col("o_orderstatus").alias("status"), F.col("c_mktsegment").alias("segment"),
    )


def odd_texts(df: DataFrame, variants: Mapping[int, Column], otherwise: Column, name: str) -> DataFrame:
    """A text column whose spelling changes with the row key, made from the row's own values."""
    out, size = None, len(variants) + 1
    for i, value in variants.items():
        test = F.pmod(F.col("row_key"), F.lit(size)) == i
        out = F.when(test, value) if out is None else out.when(test, value)
    return df.withColumn(name, out.otherwise(otherwise))
