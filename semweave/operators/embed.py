"""Text → fixed-size vector embedders and incremental embedding.

Two embedders share one contract — ``embedding array<float>`` of a fixed
dimension, unit length (or all zeros for a text without tokens):

* :func:`hashing_embedder` (built in, no model needed): tokens → hashed
  term frequencies (optionally weighted by an IDF that was fitted once and
  is passed in) → L2 normalisation, all MLlib stages on the JVM. A text's
  vector never depends on the batch it comes in. Near-copies get small
  cosine distances, which is what the similarity graph needs. Its numbers
  differ from a neural encoder's by design.
* :func:`model_embedder`: any batch model, loaded once per Python worker
  through ``predict_batch_udf`` and fed Arrow batches of ``batch_size``
  texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_DIM = 512


def _term_frequencies(papers: DataFrame, dim: int, text_col: str) -> DataFrame:
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"(?U)\w+", gaps=False, toLowercase=True)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
    return tf.transform(tok.transform(papers)).drop("_tok")


def fit_idf(papers: DataFrame, dim: int = DEFAULT_DIM, text_col: str = "abstract"):
    """IDF weights of a corpus as an MLlib model; save it next to the table
    and pass the same one to every batch."""
    from pyspark.ml.feature import IDF

    return IDF(inputCol="_tf", outputCol="_idf").fit(_term_frequencies(papers, dim, text_col))


def hashing_embedder(papers: DataFrame, dim: int = DEFAULT_DIM, text_col: str = "abstract",
                     out_col: str = "embedding", fp16: bool = False, keep_text: bool = False,
                     idf=None) -> DataFrame:
    """Adds ``out_col`` (``array<float>`` of size ``dim``).

    Without ``idf`` a vector depends on its text alone; with the model of
    :func:`fit_idf` the term frequencies are weighted by it. Nothing is
    fitted here, so batches of one table share a vector space.
    """
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import vector_to_array

    hashed = _term_frequencies(papers, dim, text_col)
    if not keep_text:
        hashed = hashed.drop(text_col)
    if idf is not None:
        hashed = idf.transform(hashed).drop("_tf").withColumnRenamed("_idf", "_tf")
    norm = Normalizer(inputCol="_tf", outputCol="_vec", p=2.0)
    out = norm.transform(hashed).withColumn(out_col, vector_to_array(F.col("_vec"), "float32")).drop("_tf", "_vec")
    return fp16_round(out, out_col) if fp16 else out


def model_embedder(papers: DataFrame, make_predict_fn: Callable, dim: int, batch_size: int = 64,
                   text_col: str = "abstract", out_col: str = "embedding") -> DataFrame:
    """Embed with a user model: ``make_predict_fn()`` returns
    ``predict(texts: np.ndarray) -> np.ndarray[(n, dim)]``; it is called once
    per worker and then fed batches of ``batch_size`` texts."""
    from pyspark.ml.functions import predict_batch_udf

    from semweave.session import ship_package

    ship_package(papers.sparkSession)
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()),
                            batch_size=batch_size, input_tensor_shapes=None)
    return papers.withColumn(out_col, udf(F.col(text_col)))


def fp16_round(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Round vectors through half precision (storage-size parity), as a
    vectorised Arrow UDF."""
    from semweave.session import ship_package

    ship_package(df.sparkSession)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _half(s: pd.Series) -> pd.Series:
        return s.map(lambda v: np.asarray(v, dtype=np.float16).astype(np.float32))

    return df.withColumn(col, _half(F.col(col)))


def embed_incremental(papers: DataFrame, existing: DataFrame | None,
                      embed: Callable[[DataFrame], DataFrame], id_col: str = "paper_id",
                      existing_id_col: str = "paper_id", force: bool = False) -> DataFrame:
    """Embed only papers whose id is not yet in ``existing`` (anti-join);
    an id that a batch holds twice is embedded once.

    ``force=True`` re-embeds everything (the caller then overwrites the
    table instead of appending).
    """
    todo = papers.dropDuplicates([id_col])
    if existing is not None and not force:
        done = existing.select(F.col(existing_id_col).cast("long").alias(id_col))
        todo = todo.join(done, id_col, "left_anti")
    return embed(todo)
