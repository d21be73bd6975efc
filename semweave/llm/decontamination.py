"""Benchmark decontamination by latent semantic retrieval.

The features are words of the benchmark (in lower case) that stand in at most
``MAX_DF`` of the documents; an item with fewer than ``LEAST_FEATURES`` of
these keeps its rarest words as well. Passages are windows of ``WINDOW`` words,
``STRIDE`` apart, over the whole text.

1. One pass counts the documents that hold each benchmark word.
2. The TF-IDF matrix A of all passages, with the items as further rows of
   weight ``ITEM_WEIGHT``, is decomposed by a randomised SVD: one pass adds up
   Y = A^T (A G) for a fixed Gaussian matrix G of ``RANK + EXTRA`` columns;
   the eigenvectors of the Nystroem form Y (G^T Y)^-1 Y^T are the leading right
   singular vectors. The pass runs on the executors; what comes back is one
   matrix of benchmark words x sketch columns, added up there.
3. In the last pass every passage and every benchmark item is projected (an
   item of more than ``WINDOW`` words also by its own passages), and pairs with
   a cosine of at least ``COSINE`` are candidates.
4. A candidate is confirmed by the longest common subsequence of words: the
   share of the item's words that the passage, with the item's length as margin
   on both sides, has in order
   must reach ``LCS``; from ``LCS_ANSWER`` on, a paraphrase counts if the
   answer (the item's last words) stands there as well.

The benchmark is the query set: it is held whole by every task, so its bytes
are checked (``MAX_BENCHMARK_BYTES``) and a larger one is refused. Nothing of
the documents is sent anywhere but counts and matrices of fixed size.

Null or empty texts match nothing, nor do items without words. Rows of a
repeated id are looked at one by one; further columns play no part. Ties: the
item with the larger share counts, then the smaller item id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semweave.llm.common import as_batch, map_batches, sum_over_partitions

WINDOW, STRIDE = 64, 32
MAX_DF = 0.03
LEAST_FEATURES = 6
RANK, EXTRA = 64, 16
ITEM_WEIGHT = 30.0
COSINE = 0.5
LCS, LCS_ANSWER = 0.8, 0.6
ANSWER_WORDS = 5
MAX_BENCHMARK_BYTES = 64 << 20
SEED = 20


class Benchmark:
    """Items as words and, for the features chosen, as (piece, feature, count) cells."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        pairs = sorted((i, t.split()) for i, t in zip(ids, texts, strict=True) if t.split())
        self.ids = np.array([i for i, _ in pairs], np.int64)
        self.words = [w for _, w in pairs]
        self.where = [places(w) for w in self.words]
        # what is searched for: every item whole, and the passages of the longer ones
        self.pieces = [(k, 0, len(w)) for k, w in enumerate(self.words)]
        self.pieces += [(k, s * STRIDE, s * STRIDE + WINDOW) for k, w in enumerate(self.words) if len(w) > WINDOW
                        for s in range(int(passages(np.array(len(w)))))]
        self.item_of = np.array([k for k, _, _ in self.pieces], np.int64)
        self.choose(sorted({x for w in self.words for x in w}))

    def choose(self, features: list[bytes]) -> None:
        """The words that are features from now on."""
        self.features = features
        self.number = {w: k for k, w in enumerate(features)}
        parts = [[k for k in map(self.number.get, self.words[i][lo:hi]) if k is not None] for i, lo, hi in self.pieces]
        numbers = [k for x in parts for k in x]
        sizes = [len(x) for x in parts]
        self.cells = _count(np.repeat(np.arange(len(sizes)), sizes), np.array(numbers, np.int64))

    @property
    def size(self) -> int:
        return len(self.number)


def _count(rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (row, word) with counts."""
    key, count = np.unique(rows * np.int64(1 << 32) + words, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, count


def passages(n: np.ndarray) -> np.ndarray:
    """Number of passages of texts of n words; the last one may be shorter."""
    return np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)


def batch_cells(bench: Benchmark, texts: list[bytes]):
    """Cells (passage, feature, count) of a batch of texts, and the text and first word of each passage."""
    get = bench.number.get
    numbers = [[get(w, -1) for w in t.split()] for t in texts]
    n = np.array([len(x) for x in numbers], np.int64)
    of = passages(n)
    base = np.cumsum(of) - of
    owner = np.repeat(np.arange(len(texts)), of)
    starts = (np.arange(of.sum()) - base[owner]) * STRIDE
    flat = np.fromiter((k for x in numbers for k in x), np.int64, int(n.sum()))
    at = np.flatnonzero(flat >= 0)
    doc = np.searchsorted(np.cumsum(n), at, side="right")
    k = (at - (np.cumsum(n) - n)[doc]) // STRIDE
    word = flat[at]
    here, before = k < of[doc], k > 0
    rows = np.concatenate([(base[doc] + k)[here], (base[doc] + k - 1)[before]])
    return *_count(rows, np.concatenate([word[here], word[before]])), owner, starts


def weigh(p: np.ndarray, w: np.ndarray, c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Values of the cells: (1 + log tf) idf, each passage of length 1."""
    v = ((1 + np.log(c)) * idf[w]).astype(np.float32)
    if not len(p):
        return v
    norm = np.sqrt(np.bincount(p, v.astype(np.float64) ** 2))
    return (v / np.maximum(norm[p], 1e-12)).astype(np.float32)


def times(p: np.ndarray, w: np.ndarray, v: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (cells @ matrix) for the passages that have a cell, and these passages; p is sorted."""
    if not len(p):
        return np.zeros((0, matrix.shape[1]), np.float32), p
    first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    return np.add.reduceat(matrix[w] * v[:, None], first, axis=0), p[first]


def lowered(column: pa.Array) -> list[bytes]:
    return [(t or "").lower().encode() for t in column.to_pylist()]


def _matrix_pass(docs: DataFrame, shape: tuple[int, int], add) -> np.ndarray:
    """Sum over all partitions of what ``add(total, texts)`` adds to a zero matrix."""

    def add_batch(total: np.ndarray, b: pa.RecordBatch) -> None:
        texts = lowered(b.column(0))
        for k in range(0, len(texts), 500):
            add(total.reshape(shape), texts[k:k + 500])

    return sum_over_partitions(docs, shape[0] * shape[1], add_batch, np.float32).reshape(shape)


def places(words: list[bytes]) -> dict[bytes, int]:
    """Bits of the places of each word."""
    where: dict[bytes, int] = {}
    for k, x in enumerate(words):
        where[x] = where.get(x, 0) | 1 << k
    return where


def lcs(where: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence of n words with their places and other words, bit-parallel."""
    full = row = (1 << n) - 1
    for m in filter(None, map(where.get, words)):
        u = row & m
        row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


class Space:
    """idf weights, the latent basis and the projected benchmark items."""

    def __init__(self, bench: Benchmark, idf: np.ndarray, basis: np.ndarray):
        self.bench, self.idf, self.basis = bench, idf, basis.astype(np.float32)
        p, w, c = bench.cells
        v = weigh(p, w, c, idf)
        latent, pieces = times(p, w, v, self.basis)  # a piece without features has no latent vector
        self.latent = np.zeros((len(bench.pieces), self.basis.shape[1]), np.float32)
        self.latent[pieces] = unit(latent)

    def candidates(self, p: np.ndarray, w: np.ndarray, c: np.ndarray, cosine: float):
        """(passage, item) with a latent cosine of at least ``cosine`` to a piece of the item, each pair once."""
        v = weigh(p, w, c, self.idf)
        latent, which = times(p, w, v, self.basis)
        i, j = np.nonzero(unit(latent) @ self.latent.T >= cosine)
        pair = np.unique(np.stack([which[i], self.bench.item_of[j]]), axis=1)
        return pair[0], pair[1]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def read_benchmark(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Benchmark:
    """The query set, whole; refused beyond ``MAX_BENCHMARK_BYTES``."""
    own = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where(
        "i is not null and t is not null")
    size = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if size > MAX_BENCHMARK_BYTES:
        raise ValueError(f"benchmark has {size} bytes, more than {MAX_BENCHMARK_BYTES}: pass it in parts")
    rows = own.collect()
    return Benchmark([r["i"] for r in rows], [r["t"].lower().encode() for r in rows])


def fit_space(docs: DataFrame, bench: Benchmark, rank: int = RANK) -> Space:
    """Document frequencies, the features, and the randomised SVD of the passages of ``docs(text)``."""
    sc = docs.sparkSession.sparkContext
    whole = sc.broadcast(bench)

    def count(total: np.ndarray, texts: list[bytes]) -> None:
        get = whole.value.number.get
        for t in texts:
            total[list({k for k in map(get, set(t.split())) if k is not None}), 0] += 1
        total[-1, 0] += len(texts)

    df = _matrix_pass(docs, (bench.size + 1, 1), count)[:, 0]
    n, df = df[-1], df[:-1]
    wanted = df <= MAX_DF * n
    for words in bench.words:  # an item of common words, or one that many documents hold, keeps its rarest words
        numbers = np.unique([bench.number[x] for x in words])
        if wanted[numbers].sum() < LEAST_FEATURES:
            wanted[numbers[np.argsort(df[numbers], kind="stable")[:LEAST_FEATURES]]] = True
    chosen = np.flatnonzero(wanted)
    idf = np.maximum(np.log((1 + n) / (1 + df[chosen])), 0.3)
    bench.choose([bench.features[k] for k in chosen])
    d = bench.size
    columns = min(rank + EXTRA, d)
    g = np.random.default_rng(SEED).standard_normal((d, columns)).astype(np.float32)
    shared = sc.broadcast((bench, idf, g))

    def add(total: np.ndarray, p: np.ndarray, w: np.ndarray, v: np.ndarray, mat: np.ndarray, times_: float) -> None:
        first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        y = np.add.reduceat(mat[w] * v[:, None], first, axis=0)
        row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(p))))
        by = np.argsort(w, kind="stable")
        ws = w[by]
        start = np.flatnonzero(np.append(True, ws[1:] != ws[:-1]))
        total[ws[start]] += times_ * np.add.reduceat(y[row[by]] * v[by, None], start, axis=0)

    def power(total: np.ndarray, texts: list[bytes]) -> None:
        own, weights, mat = shared.value
        p, w, c, _, _ = batch_cells(own, texts)
        if len(p):
            add(total, p, w, weigh(p, w, c, weights), mat, 1.0)

    y = _matrix_pass(docs, (d, columns), power)
    p, w, c = bench.cells
    if len(p):
        add(y, p, w, weigh(p, w, c, idf), g, ITEM_WEIGHT)
    shift = 1e-6 * max(np.linalg.norm(y), 1e-9)  # keeps the small matrix positive definite
    y = y + shift * g
    small = g.T.astype(float) @ y
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-9 * max(values.max(initial=0), 1e-9)))
    left, _, _ = np.linalg.svd(y @ root, full_matrices=False)
    space = Space(bench, idf, left[:, :rank])
    shared.unpersist()
    whole.unpersist()
    return space


def verify(space: Space, words: list[bytes], item: int) -> tuple[float, bool]:
    """Share of the item's words that these words have in order; whether the answer is there."""
    own = space.bench.words[item]
    share = lcs(space.bench.where[item], len(own), words) / len(own)
    if share < LCS_ANSWER:
        return share, False
    answer = own[-ANSWER_WORDS:]
    where = places(answer)
    near = 3 * WINDOW  # in a long stretch the answer's words must stand near each other
    return share, any(lcs(where, len(answer), words[k:k + near]) == len(answer)
                      for k in range(0, max(1, len(words) - near + WINDOW), WINDOW))


def decontaminate(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``(id, contaminated, item_id, share, answer)`` per row: the item that matches best, if one does."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    bench = read_benchmark(benchmark, item_col)
    schema = pa.schema([("id", pa.int64()), ("contaminated", pa.bool_()), ("item_id", pa.int64()),
                        ("share", pa.float64()), ("answer", pa.bool_())])
    ddl = "id long, contaminated boolean, item_id long, share double, answer boolean"
    if not bench.size:
        return own.select(F.col("id").alias(id_col), F.lit(False).alias("contaminated"),
                          F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("share"),
                          F.lit(False).alias("answer"))
    shared = docs.sparkSession.sparkContext.broadcast(fit_space(own.select("text"), bench))

    def search(b: pa.RecordBatch) -> pa.RecordBatch:
        space, texts = shared.value, lowered(b.column(1))
        best: dict[int, tuple] = {}
        for at in range(0, len(texts), 500):
            part = texts[at:at + 500]
            p, w, c, owner, starts = batch_cells(space.bench, part)
            if not len(p):
                continue
            split: dict[int, list[bytes]] = {}
            seen: set[tuple] = set()
            for passage, item in zip(*(x.tolist() for x in space.candidates(p, w, c, cosine)), strict=True):
                k = int(owner[passage])
                if k not in split:
                    split[k] = part[k].split()
                margin = len(space.bench.words[item])  # wherever the passage lies in a copy, all of it is seen
                lo, hi = max(0, int(starts[passage]) - margin), min(len(split[k]), int(starts[passage]) + WINDOW + margin)
                if (k, item, lo, hi) in seen:
                    continue
                seen.add((k, item, lo, hi))
                share, answer = verify(space, split[k][lo:hi], item)
                if share >= LCS or share >= LCS_ANSWER and answer:
                    found = (-share, int(space.bench.ids[item]), answer)
                    if at + k not in best or found < best[at + k]:
                        best[at + k] = found
        n = b.num_rows
        return as_batch({"id": b.column(0), "contaminated": [k in best for k in range(n)],
                         "item_id": [best[k][1] if k in best else None for k in range(n)],
                         "share": [-best[k][0] if k in best else 0.0 for k in range(n)],
                         "answer": [k in best and best[k][2] for k in range(n)]}, schema)

    return map_batches(own, search, ddl).withColumnRenamed("id", id_col)
