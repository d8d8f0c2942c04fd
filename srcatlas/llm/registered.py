"""The registered queries of this package and their SQL: thin digests over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.llm.sql import SQL  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from srcatlas.llm import line_dedup

    return line_dedup.line_classes(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from srcatlas.llm import language_id

    return language_id.report(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from srcatlas.llm import secret_scan

    return secret_scan.report(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from srcatlas.llm import personal_data

    return personal_data.report(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from srcatlas.llm import jaccard_join

    return jaccard_join.groups(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from srcatlas.llm import byte_bpe

    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from srcatlas.llm import suffix_dedup

    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from srcatlas.llm import embedding_dedup

    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from srcatlas.llm import chat_format

    control = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    return chat_format.conversation_digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from srcatlas.llm import decontaminate

    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from srcatlas.llm import lexical_search

    return lexical_search.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from srcatlas.llm import toxicity

    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from srcatlas.llm import spelling_variants

    return spelling_variants.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_line_dedup": op4_line_dedup,
    "op5_language_id": op5_language_id,
    "op6_secret_scan": op6_secret_scan,
    "op7_personal_data": op7_personal_data,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_decontaminate": op10_decontaminate,
    "op11_lexical_search": op11_lexical_search,
    "op12_toxicity": op12_toxicity,
    "op13_spelling_variants": op13_spelling_variants,
}
