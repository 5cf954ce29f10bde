"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, exact_dedup, license_scan, media, mixing, packing, repair, sharding, simhash, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan, dealt out if it keeps fewer tasks busy than there are cores, before work that Python does.

    Partitions of a scan are byte ranges of files, and all rows of a row group go to the range that holds its middle; so a
    small table is counted by its rows: those in its fullest partition are what the slowest task would have to do."""
    n = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() > 4 * n:
        return scan
    held = [r["count"] for r in scan.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    return scan.repartition(n) if held and (len(held) < n or max(held) > 2 * sum(held) / n) else scan


def tokenizer(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern of a public vocabulary: of the installed package, or of the folder in /opt/tokenizers."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        sys.path.append(os.path.dirname(os.path.realpath("/opt/tokenizers")))
        import public_tokenizers
    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), *tokenizer(), keep_ids=False)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.default_rules(spark))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.telephony_columns(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), keep_audio=False)


def op10_chat_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.neighbouring_pairs(table(spark, sf_dir, "conversations"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.packed_documents(docs, tokenizer("word_bpe_49k.json")[0], keep_ids=False)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = [op1_toxicity, op2_mixing, op3_bpe, op4_exact_dedup, op5_license_scan, op6_url_filter, op7_sharding, op8_simhash, op9_media, op10_chat_preference, op11_packing, op12_repair, pipeline]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.ORACLE, "op6_url_filter": url_filter.ORACLE, "op10_chat_preference": chat_format.ORACLE}
