"""A pipeline over documents: each stage is one operator, and what it decides takes effect.

toxicity           documents that score 0.7 or more go
exact_dedup        of equal texts the smallest identifier stays
simhash_near_dedup of each component of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, found
                   by fingerprints and compared in full, the smallest identifier stays
mixing             the documents are mixed to target weights: a row for each piece and slot, the text is the piece's
byte_bpe           every piece is encoded and decoded

Nulls, empty texts, ties, repeated rows, empty tables and columns with any names have the results that each operator's
module states; all stages but the last return the columns of documents, by place, and the rows they keep as they were
(mixing cuts texts into pieces, and n_chars, if there is one, is then the piece's).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mossgraph.llm import bpe, exact_dedup, mixing, simhash, toxicity
from mossgraph.llm.common import ensure_checkpoint_dir
from mossgraph.llm.queries import tokenizer


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(docs, placed=False)
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else mixed


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, *tokenizer(), keep_ids=False)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The toxicity stage learns a model, which SQL can't express; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over documents, each written as Parquet to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{spark.sparkContext.applicationId}-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
