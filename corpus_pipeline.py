"""The corpus pipeline: five stages from raw documents to token ids.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame; all but the last keep the columns of ``docs``. The result of each is written as
Parquet and read back as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import table, written
from lattica.llm.hyperminhash import keep_one
from lattica.llm.pii import redact
from lattica.llm.quality import keep_good
from lattica.llm.sentencepieces import encode_decode
from lattica.llm.simhash_decontam import decontaminate

#: No SQL: the classifier is fitted and the segmentation is a library's.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at 0.8 or more."""
    return keep_one(docs, width=5, percent=80, tag="pipeline-near")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is similar to a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets and ``n_chars`` brought up to date."""
    out = redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the digest of the decoded text of every document."""
    out = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "source"])
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_redaction", pii_redaction),
    ("sentencepiece_ids", sentencepiece_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
