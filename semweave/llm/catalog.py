"""Registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semweave.llm import (
    chat_format,
    decontamination,
    filter_audit,
    language_model,
    licenses,
    line_dedup,
    mixing,
    near_dedup,
    ranking,
    repetition,
    token_counts,
    whitening,
    wrapper,
)
from semweave.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@register("op1_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents (five-word shingles, Jaccard 0.75)."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@register("op2_language_model")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under the hierarchical Pitman-Yor model of the training documents."""
    return language_model.score_documents(table(spark, sf_dir, "documents"))


@register("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, repeated-substring measures and the verdict for all documents."""
    return repetition.quality_rules(table(spark, sf_dir, "documents"))


@register("op4_mix_sources", mixing.MIX_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their places in a mix of sources by the square root of their sizes."""
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))


@register("op5_line_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated and nearly repeated lines."""
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), exact_chars=1)
    return out.select("doc_id", F.col("_sw_lines").alias("n_lines"), F.col("_sw_repeats").alias("n_repeat_lines"),
                      F.col("_sw_near").alias("n_near_lines"), F.length("text").cast("long").alias("n_chars"), "text")


@register("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from the labels that are not held out."""
    return ranking.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op7_html_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return wrapper.extract(table(spark, sf_dir, "pages"))


@register("op8_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the benchmark item they hold, if any."""
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families named in all documents."""
    out = licenses.scan(table(spark, sf_dir, "documents"))
    return out.withColumn("families", F.array_join("families", ","))


@register("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of all documents for the 32k piece vocabulary."""
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("piece_bpe_32k.model"))


@register("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable vectors on the first eight whitened components, with exact deviations."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@register("op12_chat_format", chat_format.CHAT_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations, read back from the output."""
    return chat_format.chat_digests(table(spark, sf_dir, "conversations"))


@register("op13_filter_audit", filter_audit.AUDIT_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source at every step of all their orders."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
