"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

1. quality: rows whose text the line field scores below 0.5 go.
2. near_dedup: of each group of near-duplicates (five-word shingles, similarity 0.8 or more; SimHash
   proposals, then an exact shingle-prefix search) the row with the smallest doc_id stays.
3. decontaminate: rows contaminated by a benchmark item go.
4. secrets: secrets in the texts are masked; every row stays.
5. encode: ids of the byte-level BPE for every text that is left.

Stages 1 to 4 return the columns of ``documents``. Null texts count as empty, and an empty table goes
through. Between stages the rows are written as Parquet to the shared folder and read again, so a
lost executor never costs more than its stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.llm import bpe, decontaminate, quality, secrets, similar
from verdigraph.runtime import discard, durable, table


#: Bytes of one generation of a task's memo in the last stage: workers of all stages live on beside it.
ENCODE_MEMO = 16 << 20


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that the quality field, fitted on ``labels``, scores 0.5 or more."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates."""
    return similar.keep_one_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that no benchmark item contaminates."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in every text; ``n_chars`` follows the text."""
    return secrets.redact(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and a mark that decoding them gives the text back."""
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), ENCODE_MEMO)
    return out.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.col("ids").alias("token_ids"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("encode", encode_stage),
]

#: No SQL here can fit the quality field; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, durable(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
