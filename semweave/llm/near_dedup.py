"""Near-duplicate documents by HyperMinHash sketches, banding and exact confirmation.

1. One pass over the texts: 64-bit hashes of the distinct five-word
   shingles; the top bits of a hash choose one of 128 buckets, and a bucket
   keeps the leading-zero count (6 bits) and 10 mantissa bits of its least
   hash. Documents with the same shingle set (size and two 64-bit sums)
   form a class with one representative.
2. Four registers make a band, whose 64 bits are the band key. Sorted by
   (key, set size), rows without a neighbour of a fitting size go at once;
   the rest is cut into blocks of 512 rows, so a hot key becomes many
   bounded block pairs, read as a stream.
3. Inside a block pair a representative pair is looked at in its first
   common band only. The share of equal registers, corrected for chance
   collisions of compressed registers, estimates the Jaccard similarity;
   pairs more than five standard errors below the threshold go.
4. Documents that have such a pair give their full shingle sets; block pairs
   of those confirm exactly, and a union-find skips pairs already linked, so
   a block pair yields at most one edge per row, never all pairs.
5. Components of the edges by star steps; copies follow their class.

With 32 bands of 4 registers a pair at similarity 0.75 is missed with
probability (1 - 0.75^4)^32 = 5e-6, a pair at 0.9 with less than 1e-14.

A text with fewer than five words is one shingle, its whole word sequence;
a null or empty text has no shingle and is linked with nothing. Rows with a
null id keep a null component. An id is expected once; the rows of a repeated
id follow their own texts, and links of any of them count for the id they
represent. Further columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semweave.llm.blocks import block_pairs, cut_into_blocks
from semweave.llm.common import U64, WordHash, as_batch, fold, map_batches, map_runs, mix
from semweave.llm.components import connected_components
from semweave.session import drop_materialized, materialize

WORDS = 5
SIMILARITY = 75  # per cent
BUCKETS, MANTISSA = 128, 10
ROWS = 4  # registers of a band: 4 x 16 bits make a 64-bit key
BANDS = BUCKETS // ROWS
EMPTY = 0xFFFF
#: Chance that two different minima give the same register: the mass of a register within its leading-zero class.
COLLISION = 0.75 * 2.0 ** -MANTISSA
FACTORS = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                            0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles (fewer words: the whole sequence)."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, size)
    h = np.full(n - k + 1, n if n < size else 0, U64)
    for j in range(k):
        h += words[j:n - k + 1 + j] * FACTORS[j]
    return np.unique(mix(h))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """128 registers of 16 bits from sorted hashes: leading zeros and mantissa of the least hash of a bucket."""
    regs = np.full(BUCKETS, EMPTY, np.uint16)
    if len(hashes):
        bucket = (hashes >> U64(57)).astype(np.int64)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        v = (hashes[first] >> U64(4)) & U64((1 << 53) - 1)
        length = np.frexp(v.astype(np.float64))[1].astype(np.int64)
        mantissa = ((v << (53 - length).astype(U64)) >> U64(52 - MANTISSA)) & U64((1 << MANTISSA) - 1)
        regs[bucket[first]] = ((53 - length) << MANTISSA | mantissa.astype(np.int64)).astype(np.uint16)
    return regs


def band_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (rows x bands) of a register matrix and which of them hold a register at all."""
    packed = np.ascontiguousarray(regs).view(U64)
    return mix(packed + np.arange(BANDS, dtype=U64) * FACTORS[0]).view(np.int64), packed != U64(2 ** 64 - 1)


def estimate(equal: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Jaccard estimate from equal and used buckets, without the registers that agree by chance."""
    share = equal / np.maximum(used, 1)
    return np.clip((share - COLLISION) / (1 - COLLISION), 0, 1)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_set: bool = False) -> DataFrame:
    """``(id, n, s1, s2, regs[, grams])``: set size, two sums that name the set, registers, the set itself."""
    fields = [("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("regs", pa.binary())]
    ddl = "id long, n long, s1 long, s2 long, regs binary"
    if with_set:
        fields, ddl = [*fields, ("grams", pa.binary())], ddl + ", grams binary"
    schema, hashes = pa.schema(fields), WordHash()

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(hashes.of(t.split())) for t in fold(b.column(1))]
        cols = {"id": b.column(0), "n": [len(s) for s in sets],
                "s1": np.array([s.sum() for s in sets], U64).view(np.int64),
                "s2": np.array([mix(s ^ FACTORS[7]).sum() for s in sets], U64).view(np.int64),
                "regs": [sketch(s).tobytes() for s in sets]}
        if with_set:
            cols["grams"] = [s.tobytes() for s in sets]
        return as_batch(cols, schema)

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), make, ddl)


def _bands(reps: DataFrame) -> DataFrame:
    """``(key, n, id)`` for every band of every representative that holds a register."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("id", pa.int64())])

    def explode(b: pa.RecordBatch) -> pa.RecordBatch:
        regs = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(-1, BUCKETS)
        keys, used = band_keys(regs)
        row, band = np.nonzero(used)
        return as_batch({"key": keys[row, band], "n": b.column(1).to_numpy()[row],
                         "id": b.column(0).to_numpy()[row]}, schema)

    return map_batches(reps.select("id", "n", "regs"), explode, "key long, n long, id long")


def _look(tbl: pa.Table, lo: int, hi: int, similarity: int):
    """Pairs (i, j) of a block pair that may be similar and meet in this band first; a row's place is lo + i."""
    n = tbl.column("n").to_numpy()[lo:hi]
    regs = np.frombuffer(b"".join(tbl.column("regs").slice(lo, hi - lo).to_pylist()), np.uint16).reshape(-1, BUCKETS)
    blocks = tbl.column("block").to_numpy()[lo:hi]
    b1, b2 = tbl.column("b1")[lo].as_py(), tbl.column("b2")[lo].as_py()
    keys, used = band_keys(regs)
    keys = np.where(used, keys, np.arange(len(n))[:, None])  # an empty band meets nothing
    key = tbl.column("key")[lo].as_py()
    band = int(np.flatnonzero(keys[0] == key)[0])
    left, right = np.flatnonzero(blocks == b1), np.flatnonzero(blocks == b2)
    for a in range(0, len(left), 128):
        x = left[a:a + 128]
        ok = np.ones((len(x), len(right)), bool) if b1 != b2 else x[:, None] < right[None, :]
        small = np.minimum(n[x][:, None], n[right][None, :])
        ok &= 100 * small >= similarity * np.maximum(n[x][:, None], n[right][None, :])
        for k in range(band):
            ok &= keys[x, k][:, None] != keys[right, k][None, :]
        i, j = np.nonzero(ok)
        if not len(i):
            continue
        i, j = x[i], right[j]
        for c in range(0, len(i), 20_000):
            p, q = regs[i[c:c + 20_000]], regs[j[c:c + 20_000]]
            some = (p != EMPTY) | (q != EMPTY)
            m, u = ((p == q) & some).sum(1), some.sum(1)
            least = similarity / 100 - 5 * np.sqrt(similarity / 100 * (1 - similarity / 100) / u)
            good = estimate(m, u) >= least
            if good.any():
                yield i[c:c + 20_000][good], j[c:c + 20_000][good]


def _candidates(pairs: DataFrame, reps: DataFrame, similarity: int) -> DataFrame:
    """The rows of the block pairs that have a pair to confirm."""
    schema = pa.schema([(c, pa.int64()) for c in ("key", "part", "b1", "b2", "block", "id")])

    def keep(tbl: pa.Table, starts: np.ndarray):
        flag = np.zeros(tbl.num_rows, bool)
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            if hi - lo > 1:
                for i, j in _look(tbl, int(lo), int(hi), similarity):
                    flag[lo + i] = flag[lo + j] = True
        if flag.any():
            yield as_batch({c: tbl.column(c).to_numpy()[flag] for c in schema.names}, schema)

    with_regs = pairs.join(reps.select("id", "n", "regs"), "id")
    return map_runs(with_regs.select("key", "part", "b1", "b2", "block", "id", "n", "regs"),
                    ["key", "part", "b1", "b2"], keep,
                    "key long, part long, b1 long, b2 long, block long, id long", order=["n", "id"])


def _confirm(candidates: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Edges ``(a, b)`` confirmed on full sets: a spanning forest of each block pair."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def confirm(tbl: pa.Table, starts: np.ndarray):
        ids, edges = tbl.column("id").to_numpy(), []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            grams = [np.frombuffer(x, U64) for x in tbl.column("grams").slice(lo, hi - lo).to_pylist()]
            as_set: dict[int, set] = {}
            parent = list(range(hi - lo))

            def root(x: int, parent=parent) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            def of(x: int, grams=grams, as_set=as_set) -> set:
                if x not in as_set:
                    as_set[x] = set(grams[x].tolist())
                return as_set[x]

            for i, j in _look(tbl, lo, hi, similarity):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    p, q = root(x), root(y)
                    if p != q:
                        both = len(of(x) & of(y))
                        if 100 * both >= similarity * (len(grams[x]) + len(grams[y]) - both):
                            parent[q] = p
                            edges.append((ids[lo + x], ids[lo + y]))
        if edges:
            yield as_batch({"a": [e[0] for e in edges], "b": [e[1] for e in edges]}, schema)

    rows = candidates.join(sets.select("id", "n", "regs", "grams"), "id")
    return map_runs(rows, ["key", "part", "b1", "b2"], confirm, "a long, b long", order=["n", "id"])


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` per row."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    drawn = materialize(sketches(own, "id", "text"), "nd_sketch")
    known = drawn.where("n > 0 and id is not null")
    reps = materialize(known.groupBy("n", "s1", "s2").agg(F.min_by("regs", "id").alias("regs"),
                                                          F.min("id").alias("id")), "nd_reps")
    rows = materialize(cut_into_blocks(_bands(reps), similarity), "nd_blocks")
    candidates = materialize(_candidates(block_pairs(rows), reps, similarity), "nd_cand")
    drop_materialized(rows)
    wanted = candidates.select("id").distinct()
    sets = sketches(own.join(wanted, "id", "left_semi"), "id", "text", with_set=True)
    edges = materialize(_confirm(candidates, sets, similarity), "nd_edges")
    drop_materialized(candidates)
    groups = connected_components(edges, "a", "b")
    drop_materialized(edges)
    classes = (reps.select("n", "s1", "s2", F.col("id").alias("rep"))
               .join(groups, F.col("rep") == F.col("node"), "left")
               .select("n", "s1", "s2", F.coalesce("component", "rep").alias("component")))
    out = (drawn.select("id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left")
           .select("id", F.col("n").alias("n_shingles"),
                   F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")))
    out = materialize(out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))), "nd_out")
    for t in (drawn, reps):
        drop_materialized(t)
    return out.withColumnRenamed("id", id_col)
