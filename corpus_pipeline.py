"""Documents made ready for training, in stages; each stage is written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import mixing, pii, quality, simhash_dedup
from panelcast.llm.bpe import ByteBpe, n_tokens
from panelcast.llm.text import fresh_name
from panelcast.sources.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others the failing lines."""
    return quality.clean(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash_dedup.drop_near_copies(docs, Scratch(spark))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind."""
    return pii.redact(docs, Scratch(spark))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs, Scratch(spark))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed, little-endian, 32 bits) beside the columns of the documents, and the sums
    of the ids and of the bytes that they decode to. Columns of these names are replaced."""
    import public_tokenizers

    bpe = ByteBpe(
        spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    both = fresh_name(docs, "both")
    results = {
        "ids": F.col(f"{both}.ids"),
        "n_tokens": n_tokens(f"{both}.ids"),
        "ids_sha256": F.sha2(f"{both}.ids", 256),
        "decoded_sha256": F.sha2(f"{both}.decoded", 256),
    }
    return docs.withColumn(both, bpe.encode_and_decode("text")).select(
        *[c for c in docs.columns if c.lower() not in results],
        *[value.alias(name) for name, value in results.items()],
    )


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

# Fingerprints, trained detectors and token ids have no SQL form; tests/llm compares the stages
# with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` after all stages."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
