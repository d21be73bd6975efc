"""Arrow buffers of vectors as matrices, and kernels over sorted runs of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as a float64 matrix, from its flat values (no Python object a row)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if n == 0:
        return np.zeros((0, 0))
    if len(flat) % n:
        raise ValueError("vectors of different lengths")
    return flat.astype(np.float64).reshape(n, -1)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row stays zero."""
    norms = np.linalg.norm(m, axis=1)
    norms[norms == 0] = 1.0
    return m / norms[:, None]


def unit_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return unit(matrix(column))


def pack(m: np.ndarray) -> pa.Array:
    """Rows of a float64 matrix as binary values: Spark moves them as they are, without a step per entry."""
    m = np.ascontiguousarray(m, np.float64)
    width = m.shape[1] * 8
    offsets = np.arange(len(m) + 1, dtype=np.int64) * width
    if offsets[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(m)])
    return pa.Array.from_buffers(pa.large_binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(m)])


def unpack(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The matrix behind :func:`pack`."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, 0))
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat.view(np.float64).reshape(n, -1) if len(flat) else np.zeros((n, 0))


def list_array(flat: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Lists cut out of flat values at ``starts`` (with the end as last entry)."""
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat, kind))


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, with the end as last entry."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def map_groups(df: DataFrame, key: str, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str,
               order: list[str] = ()) -> DataFrame:
    """Hand groups of equal ``key`` (a long) to ``fn`` as tables of one or several whole groups.

    Rows are dealt by the key and sorted inside the partition by key and
    ``order``. A group is held whole, so callers bound the rows of a key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            at = b.schema.get_field_index(key)
            keys = b.column(at).to_numpy()
            last = int(runs(keys)[-2])
            if held and (last > 0 or keys[0] != held[0].column(at)[0].as_py()):
                first = int(runs(keys)[1]) if keys[0] == held[0].column(at)[0].as_py() else 0
                yield from fn(pa.Table.from_batches([*held, b.slice(0, first)]))
                held = []
                if last > first:
                    yield from fn(pa.Table.from_batches([b.slice(first, last - first)]))
                held = [b.slice(last)]
            elif held:
                held.append(b)
            else:
                if last > 0:
                    yield from fn(pa.Table.from_batches([b.slice(0, last)]))
                held = [b.slice(last)]
        if held:
            yield from fn(pa.Table.from_batches(held))

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
