"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, source mixing.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame that is written as Parquet and read again
as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semweave.llm import decontamination, line_dedup, mixing, near_dedup, repetition
from semweave.llm.common import table
from semweave.session import ensure_checkpoint_dir, materialize, ship_package


WORD = "[^\\x20\\x09-\\x0D]"


def _prepared(spark: SparkSession) -> None:
    ship_package(spark)
    ensure_checkpoint_dir(spark)


def _keep(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id has a verdict ``kept`` (ids that are null never match)."""
    kept = verdicts.where("kept").select(F.col("doc_id").alias("_sw_id")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["_sw_id"], "left_semi")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the repetition rules reject.

    Null and empty texts have too few words and go; long texts are judged
    whole. Verdicts go by id: rows without one go, rows that share one stay
    together if one of them stays. Equal texts get equal verdicts. An empty
    table gives an empty one; further columns are kept.
    """
    _prepared(spark)
    return _keep(docs, repetition.quality_rules(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated lines (of any length) and nearly repeated ones (from 30 code points) out of the texts.

    A document that had words and has none left goes: all it held stands in
    earlier documents. Null and empty texts and rows without an id stay as
    they are; of ties and repeated rows the first line (by id, then place)
    stays. An empty table gives an empty one; further columns are kept.
    """
    _prepared(spark)
    out = line_dedup.line_dedup(docs, exact_chars=1)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_sw_repeats") + F.col("_sw_near") > 0,
                                               F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    emptied = (F.col("_sw_repeats") + F.col("_sw_near") > 0) & ~F.col("text").rlike(WORD)
    return out.where(~F.coalesce(emptied, F.lit(False))).select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near-duplicates.

    Documents without words are linked with nothing and stay. Of equal texts
    the smallest id stays, with all rows of that id; rows without an id go.
    An empty table gives an empty one; further columns are kept.
    """
    _prepared(spark)
    return _keep(docs, near_dedup.near_duplicates(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item.

    Null and empty texts hold none and stay, long ones are searched whole;
    items that are null or empty are ignored. Rows that share an id stay
    together if one of them stays, rows without an id go. An empty table
    gives an empty one; further columns are kept.
    """
    _prepared(spark)
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _keep(docs, found.withColumn("kept", ~F.col("contaminated")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their places in the mix of sources.

    No row is left out: a null source is the empty one, a null id counts as
    the text 'null', rows of one id get neighbouring places. An empty table
    gives an empty one; further columns are kept.
    """
    _prepared(spark)
    return mixing.mix_sources(docs, text_col="text")


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_dedup_stage),
          ("decontamination", decontamination_stage), ("mixing", mixing_stage)]

#: The stages are not SQL; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
