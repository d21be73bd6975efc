"""JSON-lines paper source and the cleaning/filter chain.

Only three keys are read; the schema is fixed, never inferred, so the
JSON reader prunes everything else while parsing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semweave.functions.text import year_from_date, strip_text, word_count

PAPER_SCHEMA = T.StructType([
    T.StructField("update_date", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()),
])


def read_papers(spark: SparkSession, path: str, mode: str = "dropmalformed",
                id_col: str | None = None, with_rejects: bool = False) -> DataFrame:
    """Scan JSON-lines papers.

    ``mode``: ``"dropmalformed"`` skips lines that are not JSON objects,
    ``"failfast"`` raises on the first one. With ``with_rejects`` the scan
    is PERMISSIVE and a boolean ``rejected`` column marks bad lines so they
    can be counted (blank lines are skipped by the reader and not counted).
    With ``id_col`` the records' own key becomes ``paper_id``; without one
    ``paper_id`` is a 63-bit hash of the record itself, so it stays the same
    whatever files are added and equal records share it.
    """
    base = PAPER_SCHEMA.fields
    if id_col is not None:  # records carry their own key
        base = [T.StructField(id_col, T.LongType())] + base
    reader = spark.read.schema(T.StructType(base))
    if with_rejects:
        schema = T.StructType(base + [T.StructField("_corrupt_record", T.StringType())])
        df = (spark.read.schema(schema).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
        # the reader refuses plans that need only the corrupt-record column;
        # tying the flag to a data column keeps a real column in the scan
        keep = F.length(F.coalesce(F.col("update_date"), F.lit(""))) >= 0
        df = df.withColumn("rejected", F.col("_corrupt_record").isNotNull() & keep).drop("_corrupt_record")
    else:
        opt = {"dropmalformed": "DROPMALFORMED", "failfast": "FAILFAST"}[mode]
        df = reader.option("mode", opt).json(path)
    if id_col is not None:
        return df.withColumnRenamed(id_col, "paper_id")
    key = F.xxhash64(*[F.coalesce(F.col(f.name), F.lit("\0")) for f in PAPER_SCHEMA.fields])
    return df.select(key.bitwiseAND(F.lit(2 ** 63 - 1)).alias("paper_id"), *df.columns)


def clean_papers(raw: DataFrame, min_year: int = 0, min_words: int | None = None,
                 null_date: str = "zero", id_col: str = "paper_id") -> DataFrame:
    """``(paper_id, year, title, abstract, n_words)`` after the scan filters.

    Order of predicates follows the cheap-first rule: year, then the
    non-empty stripped abstract, then the word-count filter.
    """
    year = year_from_date(F.col("update_date"), null_date=null_date)
    df = (raw.select(F.col(id_col).cast("long").alias("paper_id"),
                     year.alias("year"),
                     F.coalesce(F.col("title"), F.lit("")).alias("title"),
                     strip_text(F.col("abstract")).alias("abstract"))
          .filter(F.col("year").isNotNull() & (F.col("year") >= F.lit(min_year)))
          .filter(F.col("abstract") != F.lit("")))
    df = df.withColumn("n_words", word_count(F.col("abstract")))
    if min_words is not None:
        df = df.filter(F.col("n_words") >= F.lit(min_words))
    return df


def first_papers(papers: DataFrame, max_papers: int, id_col: str = "paper_id") -> DataFrame:
    """The ``max_papers`` papers with the smallest ids; a number below 1 is an error."""
    if max_papers <= 0:
        raise ValueError("max_papers must be positive")
    return papers.orderBy(id_col).limit(max_papers)


def filter_papers(papers: DataFrame, min_words: int = 10) -> DataFrame:
    """Keep papers with at least ``min_words`` words (after the scan filters)."""
    return papers.filter(F.col("n_words") >= F.lit(min_words))


def papers_as_json_lines(raw: DataFrame) -> DataFrame:
    """One JSON object per row in ``value`` (the on-disk record format)."""
    return raw.select(F.col("paper_id"),
                      F.to_json(F.struct("update_date", "title", "abstract")).alias("value"))


def parse_json_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Parse a string column of JSON records with the paper schema.

    Lines that are not JSON objects give a null struct and are dropped.
    """
    parsed = lines.withColumn("_p", F.from_json(F.col(value_col), PAPER_SCHEMA,
                                                {"mode": "PERMISSIVE"}))
    return (parsed.filter(F.col("_p").isNotNull()
                          & ~(F.col("_p.update_date").isNull() & F.col("_p.title").isNull()
                              & F.col("_p.abstract").isNull() & ~F.col(value_col).startswith("{")))
            .select(*[c for c in lines.columns if c != value_col], "_p.*"))
