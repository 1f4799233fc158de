"""The registered queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import bpe, chat_trees, cotrain, exact_dedup, kd_shards, mixing, pii, quality_rules, simhash, substring_dedup
from quernel.llm.common import literal_rows, table


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards.kd_shards(table(spark, sf_dir, "documents"), n_shards=16)
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op2_cotrain_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cotrain.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("kept", F.col("score") >= 0.5)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), carry={"text_sha256": F.sha2("_text", 256)})


def op4_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(literal_rows(spark, [(-1, 0, "user", ok), (-1, 1, "assistant", ok)], conv_id="bigint", turn="bigint", role="string", text="string"))
    out = chat_trees.format_trees(chat_trees.linear(rows), unique=True)
    turns, loss = chat_trees.read_turns(F.col("formatted")), chat_trees.read_loss(F.col("formatted"), F.col("spans"))
    out = out.select("tree", "formatted", turns.alias("turns"), loss.alias("loss"))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kd_shards": op1_kd_shards,
    "op2_cotrain_quality": op2_cotrain_quality,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_chat_trees": op4_chat_trees,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_simhash": op7_simhash,
    "op8_pii": op8_pii,
    "op9_bpe": op9_bpe,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op4_chat_trees": chat_trees.ORACLE_SQL,
    "op6_mix_sources": mixing.ORACLE_SQL,
    "op5_substring_dedup": substring_dedup.ORACLE_SQL,
    "op10_quality_rules": quality_rules.oracle_sql(),
}
