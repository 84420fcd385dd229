"""The corpus pipeline: documents to token ids in five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridiff.llm import common, decontaminate, language_id, near_dedup, sentencepiece_codec, substring_dedup

#: SQL can express neither the language model nor the segmentation; tests hold the stages against brute force.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a recognised language go."""
    return language_id.keep_identified(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each component the document with the smallest doc_id stays."""
    return near_dedup.deduplicate(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: words of passages that start in an earlier document go, and documents of which nothing is left."""
    return substring_dedup.removed_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a leaked item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding with merge-dropout: doc_id, n_tokens, ids, and the digest of what the ids decode to."""
    model = sentencepiece_codec.default_model()
    ids = sentencepiece_codec.encode(docs, model)
    digest = sentencepiece_codec.decode_digest(ids, model)
    return digest.select("doc_id", "n_tokens", "ids", "ids_crc32", "decoded_sha256")


STAGES = [
    ("language_id", identify),
    ("near_dedup", near),
    ("substring_dedup", repeats),
    ("decontamination", benchmark),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if stage is STAGES[-1][1] else common.materialize(out, f"stage-{name}")
    return docs
