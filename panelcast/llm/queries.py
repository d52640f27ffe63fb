"""The numbered operators as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.bpe import ByteBpe, n_tokens
from panelcast.llm.conversations import Repair, damage
from panelcast.llm.fingerprint import count_near, edited_with_next, likeness
from panelcast.llm.html import extract
from panelcast.llm.lexical import search
from panelcast.llm.licenses import scan_licenses
from panelcast.llm.linear_bpe import LinearBpe, joined_ids
from panelcast.llm.mixing import mix
from panelcast.llm.pii import KINDS, as_text, find_spans
from panelcast.llm.quality import judge
from panelcast.llm.simhash_dedup import fingerprint_digits, near_groups
from panelcast.llm.url_filter import judge_urls
from panelcast.llm.warc import read_archives, with_revisits, write_archives
from panelcast.sources.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    # The texts themselves are not stored again.
    spanned, base, added = find_spans(docs, Scratch(spark), keep_text=False)

    def count_of(kind: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    counts = [count_of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spanned.select(
        "doc_id",
        *counts,
        F.sha2(as_text(F.col(base)), 256).alias("base_sha256"),
        as_text(F.concat(base, added)).alias("spans"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields += ["base_failed", "kept", "n_failed_lines", "kept_chars"]
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", *[f"judged.{f}" for f in fields])


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(_table(spark, sf_dir, "documents"), Scratch(spark))
    return groups.select(
        "doc_id", fingerprint_digits(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    rows = with_revisits(_table(spark, sf_dir, "pages"))
    manifest = scratch.save(write_archives(rows, scratch.folder("archives")), "manifest")
    return (
        read_archives(manifest, with_payload=False)
        .filter("kind = 'record'")
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).drop("url")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), Scratch(spark))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/block/name``. Short ones are licence files; of these, those
    with an even id lie one directory higher."""
    docs = _table(spark, sf_dir, "documents")
    short, even = F.length("text") <= 300, F.col("doc_id") % 2 == 0
    name = F.concat(F.when(short, F.lit("LICENSE.")).otherwise(F.lit("text.")), F.col("doc_id"))
    block = F.when(~(short & even), F.floor(F.col("doc_id") / 64).cast("string"))
    path = F.concat_ws("/", "source", "lang", block, name)
    files = docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")
    return scan_licenses(files, Scratch(spark)).withColumnRenamed("file_id", "doc_id")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = _table(spark, sf_dir, "documents")
    edited = scratch.save(edited_with_next(docs, scratch), "fingerprints")
    return count_near(edited, F.col("doc_id") % 100 == 0).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint_digits(F.col("fp")).alias("fingerprint"),
        fingerprint_digits(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "n_near",
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bpe = ByteBpe(
        spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", bpe.encode_and_decode("text").alias("b")).select(
        "doc_id",
        n_tokens("b.ids").alias("n_tokens"),
        F.sha2("b.ids", 256).alias("ids_sha256"),
        F.sha2("b.decoded", 256).alias("decoded_sha256"),
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = (_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return search(documents, items, Scratch(spark))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bpe = LinearBpe(spark, public_tokenizers.path("byte_bpe_50k.json"))
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", bpe.encode_and_decode("text").alias("b")).select(
        "doc_id",
        F.size("b.ids").cast("long").alias("n_tokens"),
        F.sha2(joined_ids("b.ids"), 256).alias("ids_sha256"),
        F.sha2("b.decoded", 256).alias("decoded_sha256"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return Repair(damage(conversations), conversations, Scratch(spark)).digests()


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_pii": op2_pii,
        "op3_quality_rules": op3_quality_rules,
        "op4_simhash_dedup": op4_simhash_dedup,
        "op5_warc": op5_warc,
        "op6_url_filter": op6_url_filter,
        "op7_source_mix": op7_source_mix,
        "op8_license_scan": op8_license_scan,
        "op9_fingerprints": op9_fingerprints,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_lexical_search": op11_lexical_search,
        "op12_bpe": op12_bpe,
        "op13_conversation_repair": op13_conversation_repair,
    }
