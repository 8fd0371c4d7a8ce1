"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_formatting, decontamination, ngram_join, packing, pii, quality_classifier, quality_rules, secret_scans, sharding, simhash, suffix_dedup
from . import queries_vectors
from .common import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(more)
    return chat_formatting.digest(chat_formatting.windows(turns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality_rules.ledger(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = quality_rules.POLICIES[0]
    failed = F.col("ledger.failed")
    return df.select(
        "doc_id",
        *[F.col(f"ledger.{m}").alias(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~quality_rules.kept_by(base, failed)).alias("base_failed"),
        (quality_rules.kept_by(base, failed) & quality_rules.kept_by(quality_rules.CURRENT, failed)).alias("kept"),
        failed.alias("failed_bits"),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove(table(spark, sf_dir, "documents", "doc_id", "text")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source")
    return sharding.place(docs, "doc_id", [f"shard-{i:03d}" for i in range(64)]).select("doc_id", "slot", "shard")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 poor, 2 good."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    rated = table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))
    model = quality_classifier.fit(quality_classifier.sample_rated(docs, rated))
    return quality_classifier.score(docs, model)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.digest(secret_scans.detect(table(spark, sf_dir, "documents", "doc_id", "text")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = pii.detect(table(spark, sf_dir, "documents", "doc_id", "text"))
    return pii.digest(found)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, roots = ngram_join.join(table(spark, sf_dir, "documents", "doc_id", "text"))
    return ngram_join.group_ids(rows, roots)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, roots = simhash.join(table(spark, sf_dir, "documents", "doc_id", "text"))
    return simhash.digest(rows, roots)


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_quality_rules": op2_quality_rules,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_packing": op4_packing,
    "op5_sharding": op5_sharding,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_decontamination": op7_decontamination,
    "op8_secret_scans": op8_secret_scans,
    "op9_pii": op9_pii,
    "op10_ngram_join": op10_ngram_join,
    **queries_vectors.QUERIES,
    "op13_simhash": op13_simhash,
}
