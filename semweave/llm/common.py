"""Helpers shared by the training-data operators: words, hashes, grouped Arrow kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(column: pa.Array) -> list[bytes]:
    """UTF-8 texts with A-Z in lower case and nothing else changed (null: empty)."""
    return [b"" if t is None else t.lower() for t in raw(column)]


def raw(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


class WordHash(dict):
    """word -> 64-bit hash, remembered; forgotten when the table passes ``limit`` words."""

    def __init__(self, seed: int = 0, limit: int = 400_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A finalising bijection of 64-bit values (splitmix64)."""
    h = h + U64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def crc_mod(column: Column, n: int) -> Column:
    """crc32(id as text) mod n; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("null")).cast("binary")) % n


def as_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` of a function from one record batch to a batch, a list of them, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def runs(columns: list[np.ndarray]) -> np.ndarray:
    """Starts of the runs of equal keys, with the end as last entry."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def map_runs(df: DataFrame, keys: list[str], fn: Callable, schema: str, order: list[str] = ()) -> DataFrame:
    """Hand whole groups of equal integer keys to ``fn(table, starts)``, several groups at a time.

    The rows are dealt out by the keys and sorted inside each partition; a
    group is held whole in one worker, so callers split large groups into
    bounded blocks first. ``fn`` yields record batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def hand(tbl: pa.Table, starts: np.ndarray):
            if tbl.num_rows:
                yield from fn(tbl, starts)

        def keys_of(tbl):
            return [tbl.column(k).to_numpy() for k in keys]

        for b in batches:
            if not b.num_rows:
                continue
            if held:
                first, last = held[0], b
                same = all(first.column(k)[0] == last.column(k)[last.num_rows - 1] for k in
                           [first.schema.get_field_index(x) for x in keys])
                if same:
                    held.append(b)
                    continue
            tbl = pa.Table.from_batches([*held, b])
            starts = runs(keys_of(tbl))
            cut = int(starts[-2])
            yield from hand(tbl.slice(0, cut), starts[:-1])
            held = tbl.slice(cut).combine_chunks().to_batches()
        if held:
            tbl = pa.Table.from_batches(held)
            yield from hand(tbl, runs(keys_of(tbl)))

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, schema)


LANES, PIECE = 32, 1 << 16


def sum_over_partitions(df: DataFrame, size: int, add: Callable, kind: type = np.float64) -> np.ndarray:
    """Sum of the vectors that ``add(total, batch)`` builds in each partition.

    The vectors are cut into pieces and added up on the executors in two
    steps, so the driver gets one vector whatever the number of partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size, np.float64)
        for b in batches:
            if b.num_rows:
                add(total, b)
        lane = TaskContext.get().partitionId() % LANES
        for k in range(0, size, PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([k // PIECE], pa.int32()), pa.array([lane], pa.int32()),
                                              pa.array([total[k:k + PIECE].astype(kind).tobytes()], pa.binary())],
                                             ["piece", "lane", "m"])

    def together(tbl: pa.Table) -> pa.Table:
        out = None
        for m in tbl.column("m"):
            v = np.frombuffer(m.as_py(), kind).astype(np.float64)
            out = v if out is None else out + v
        return pa.table({"piece": tbl.column("piece").slice(0, 1), "m": pa.array([out.astype(kind).tobytes()], pa.binary())})

    parts = df.mapInArrow(run, "piece int, lane int, m binary").groupBy("piece", "lane")
    parts = parts.applyInArrow(together, "piece int, m binary").groupBy("piece")
    out = np.zeros(size)
    for r in parts.applyInArrow(together, "piece int, m binary").collect():
        v = np.frombuffer(r["m"], kind)
        out[r["piece"] * PIECE:r["piece"] * PIECE + len(v)] = v
    return out
