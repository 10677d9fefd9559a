"""The registered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import shared_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")
    return judge(docs).select("doc_id", *(F.col(f"quality.{k}") for k in fields))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import read_token_shards, write_token_shards

    path = fresh_folder(spark, "token-shards")
    write_token_shards(table(spark, sf_dir, "documents"), path, default_tokenizer(), end_id=2)
    return read_token_shards(spark, path)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=5)
    return found.withColumnRenamed("id", "doc_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import placements

    placed = placements(table(spark, sf_dir, "documents"))
    return placed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "position", "position_2", "position_3")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("detections").cast("long").alias("n_detections"))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_warc, write_pages

    path = fresh_folder(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), path)
    records = read_warc(spark, path, "record_id string, record_type string, payload_digest string, refers_to string, payload_bytes long, measured_bytes long, measured_digest string")
    page = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as bigint)")
    # of responses what their decoded payloads give; a revisit has headers only
    return records.select(
        page("record_id").alias("page_id"), F.coalesce("measured_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("measured_digest", "payload_digest").alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"), (F.col("measured_digest") == F.col("payload_digest")).alias("verified"),
    )


def op6_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    placed = shard_documents(table(spark, sf_dir, "documents"), n_shards=16)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_rows")


def op7_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import site_line_dedup

    found = site_line_dedup(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "host", "n_lines", "n_dropped", "kept_text")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls, rule_table

    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark)).withColumnRenamed("id", "page_id")


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_license_scan": op1_license_scan,
        "op2_warc_archive": op2_warc_archive,
        "op3_quality_rules": op3_quality_rules,
        "op4_token_shards": op4_token_shards,
        "op5_near_dedup": op5_near_dedup,
        "op6_shard_documents": op6_shard_documents,
        "op7_site_line_dedup": op7_site_line_dedup,
        "op8_url_filter": op8_url_filter,
        "op9_decontaminate": op9_decontaminate,
        "op10_mix_sources": op10_mix_sources,
        "pipeline": corpus_pipeline.run,
    }


def oracles() -> dict[str, str]:
    from .oracles import ORACLES

    return ORACLES
