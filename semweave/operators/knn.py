"""Cosine k-nearest-neighbour joins.

Output of every mode is the long-form table
``knn(src long, dst long, rank int, dist double)``: for each ``src`` its
``k`` nearest other vectors (self excluded by id, not by position),
ordered by ``(dist, dst)``; ``rank`` starts at 1.

``mode="exact"``
    Vectors are hashed by their id into sets of queries, as many as the
    cluster has cores (more where a set would exceed ``SET_ROWS``; ids are
    unique, so hashing cannot skew a set). A task holds one set and its
    lists so far and reads all vectors as a stream, in tiles whose size
    does not depend on the corpus; a source's list is complete where it is
    made, so no candidates are shuffled and merged. Every vector is sent
    once per set: bytes shuffled grow with the corpus times the cores. Work
    (distances computed) is quadratic by nature; it is the reference and
    the default for small and medium corpora.

``mode="ivf"``
    Inverted-file search: cosine k-means cells (MLlib), every vector is
    stored in its nearest cell and probes its ``nprobe`` nearest cells.
    Candidates are generated by an equi-join on the cell id; a cell's stored
    rows and its probing rows are both split into salted sub-blocks, and each
    pair of sub-blocks is a group, so a hot cell (one third of the corpus,
    say) becomes many bounded groups. Where a vector would be sent to more
    cells than the exact mode has sets, cells are streamed past sets of
    queries instead (:func:`stream_nearest`). Centroids (``n_cells x D``) are the only
    thing that reaches the driver; ``n_cells`` stays below the broadcast bound.

``mode="descent"``
    Neighbour descent on the kNN table (``operators.nn_descent``).

``mode="lsh"``
    Random-hyperplane signatures banded into buckets; candidate pairs
    share a bucket in some band. Buckets are split into bounded sub-blocks
    like IVF cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semweave.functions.arrow import list_array, pack, runs, unit, unit_matrix, unpack
from semweave.session import materialize, ship_package

KNN_SCHEMA = "src long, dst long, rank int, dist double"
_CAND_SCHEMA = "src long, dst long, dist double"
# the largest matrix a worker broadcast may hold (bytes)
MAX_BROADCAST_BYTES = 256 * 1024 * 1024
_ROW_CHUNK = 1024
SET_ROWS = 65_536  # queries that a task of the streamed join holds with their lists
_SET_FLAGS = 128 * 1024 * 1024  # entries of a set's (query, cell) table
_STREAM_CHUNK = 2048  # stored rows of a tile
_EQUAL, _SLACK = 1e-9, 2e-12  # distances below count as zero; distances are rounded to 12 places


# --------------------------------------------------------------------------
# vectorised kernels (run inside Python workers on bounded groups)
# --------------------------------------------------------------------------

def _topk_rows(q_ids: np.ndarray, q_mat: np.ndarray, c_ids: np.ndarray, c_mat: np.ndarray,
               k: int, exclude_self: bool):
    """Top-k candidates for each query row, ties broken by candidate id.

    ``c_ids`` must be sorted ascending so that a stable sort on distance
    orders equal distances by id.
    """
    out_src, out_dst, out_dist = [], [], []
    n_c = len(c_ids)
    if n_c == 0 or len(q_ids) == 0:
        return out_src, out_dst, out_dist
    for start in range(0, len(q_ids), _ROW_CHUNK):
        qi = q_ids[start:start + _ROW_CHUNK]
        d = 1.0 - q_mat[start:start + _ROW_CHUNK] @ c_mat.T
        # equal vectors must tie whatever the shape of the block product was
        d = np.round(d, 12)
        d[np.abs(d) < 1e-9] = 0.0  # exact duplicates: no -0.0 / tiny negatives
        if exclude_self:
            pos = np.searchsorted(c_ids, qi)
            pos_c = np.minimum(pos, n_c - 1)
            hit = c_ids[pos_c] == qi
            d[np.nonzero(hit)[0], pos_c[hit]] = np.inf
        kk = min(k, n_c)
        if kk <= 0:
            continue
        if kk < n_c:
            idx = np.argpartition(d, kk - 1, axis=1)[:, :kk]
            kth = np.take_along_axis(d, idx, axis=1).max(axis=1)
            ties = (d <= kth[:, None]).sum(axis=1) > kk
            if ties.any():
                idx[ties] = np.argsort(d[ties], axis=1, kind="stable")[:, :kk]
        else:
            idx = np.broadcast_to(np.arange(n_c), (len(qi), n_c))
        dist = np.take_along_axis(d, idx, axis=1)
        keep = np.isfinite(dist)
        out_src.append(np.repeat(qi, kk).reshape(len(qi), kk)[keep])
        out_dst.append(c_ids[idx][keep])
        out_dist.append(dist[keep])
    return out_src, out_dst, out_dist


def _batch(parts) -> pa.Table:
    src, dst, dist = (np.concatenate(x) if x else np.zeros(0, t) for x, t in
                      zip(parts, (np.int64, np.int64, np.float64), strict=True))
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()),
                     "dist": pa.array(dist, pa.float64())})


def _sorted_side(tbl: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and their unit vectors."""
    ids = tbl.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    vec = tbl.column("vec")
    return ids[order], (unit_matrix(vec) if pa.types.is_list(vec.type) else unpack(vec))[order]


def _part(tbl: pa.Table, column: str, value: int) -> pa.Table:
    return tbl.filter(pc.equal(tbl.column(column), value))


def _distance(cosine: np.ndarray) -> np.ndarray:
    d = np.round(1.0 - cosine, 12)
    d[np.abs(d) < _EQUAL] = 0.0
    return d


class _Lists:
    """The ``k`` nearest stored rows of a set of queries, fed with stored rows chunk by chunk.

    Lists are kept in the order ``(dist, dst)``. A tile of cosines is compared
    with the last distance of each list; only entries that may enter it are
    rounded and sorted in.
    """

    def __init__(self, k: int, ids: np.ndarray, mat: np.ndarray):
        self.k, self.ids, self.mat = k, ids, mat
        self.dist = np.full((len(ids), k), np.inf)
        self.dst = np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, rows: np.ndarray, ids: np.ndarray, mat: np.ndarray, first: np.ndarray) -> None:
        """``rows`` of the set against stored rows; ``first`` marks the first row of an id, which the query's own row skips."""
        for start in range(0, len(rows), _ROW_CHUNK):
            r = rows[start:start + _ROW_CHUNK]
            cos = self.mat[r] @ mat.T
            hit = cos >= self._least(self.dist[r, -1])[:, None]
            if len(ids) > self.k + 1 and np.count_nonzero(hit) > 4 * self.k * len(r):
                # one more than k: the nearest may be the query itself
                kth = np.partition(cos, len(ids) - self.k - 1, axis=1)[:, len(ids) - self.k - 1]
                hit &= cos >= self._least(1.0 - kth)[:, None]
            i, j = np.divmod(np.flatnonzero(hit), len(ids))
            d, at, c = _distance(cos[i, j]), r[i], ids[j]
            last = self.dist[at, -1]
            keep = (d < last) | ((d == last) & (c < self.dst[at, -1]))
            keep &= ~((c == self.ids[at]) & first[j])
            self._enter(at[keep], c[keep], d[keep])

    @staticmethod
    def _least(dist: np.ndarray) -> np.ndarray:
        """The smallest cosine whose distance may be at most ``dist``."""
        return 1.0 - np.maximum(dist, _EQUAL) - _SLACK

    def _enter(self, at: np.ndarray, dst: np.ndarray, dist: np.ndarray) -> None:
        if not len(at):
            return
        rows = np.unique(at)
        row, c, d = (np.concatenate([x, y]) for x, y in (
            (np.repeat(rows, self.k), at), (self.dst[rows].ravel(), dst), (self.dist[rows].ravel(), dist)))
        order = np.lexsort((c, d, row))
        row, c, d = row[order], c[order], d[order]
        place = _place_in_run(row)
        best = place < self.k
        self.dist[row[best], place[best]] = d[best]
        self.dst[row[best], place[best]] = c[best]

    def rows(self) -> Iterator[pa.RecordBatch]:
        """``(src, dst, rank, dist)``; rows of one id (they lie in one set) share a list."""
        order = np.argsort(self.ids, kind="stable")
        ids = self.ids[order]
        if len(ids) and (ids[1:] == ids[:-1]).any():
            src, dst, dist = np.repeat(ids, self.k), self.dst[order].ravel(), self.dist[order].ravel()
            by = np.lexsort((dst, dist, src))
            src, dst, dist = src[by], dst[by], dist[by]
            rank = _place_in_run(src) + 1
            keep = (rank <= self.k) & np.isfinite(dist)
            yield pa.RecordBatch.from_arrays(
                [pa.array(src[keep], pa.int64()), pa.array(dst[keep], pa.int64()), pa.array(rank[keep].astype(np.int32)),
                 pa.array(dist[keep])], ["src", "dst", "rank", "dist"])
            return
        for start in range(0, len(ids), _ROW_CHUNK):
            o = order[start:start + _ROW_CHUNK]
            keep = np.isfinite(self.dist[o])
            i, j = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.ids[o][i], pa.int64()), pa.array(self.dst[o][keep], pa.int64()),
                 pa.array((j + 1).astype(np.int32)), pa.array(self.dist[o][keep])], ["src", "dst", "rank", "dist"])


def _place_in_run(keys: np.ndarray) -> np.ndarray:
    """0, 1, ... inside every run of equal keys."""
    at = runs(keys)
    return np.arange(len(keys)) - np.repeat(at[:-1], np.diff(at))


def _stream_kernel(k: int):
    """Rows in order of set and role: the queries of a set (role 0), then the stored rows (role 1) by cell and id.

    Queries with a null ``probes`` meet all stored rows, others those of the cells they list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, lists, flags, last = None, [], None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            at = runs(b.column("set").to_numpy() * 2 + b.column("role").to_numpy())
            for s, e in zip(at[:-1], at[1:], strict=True):
                part = b.slice(s, e - s)
                if part.column("set")[0].as_py() != key:
                    if lists is not None:
                        yield from lists.rows()
                    key, asked, lists, flags, last = part.column("set")[0].as_py(), [], None, None, None
                ids, mat = part.column("id").to_numpy(zero_copy_only=False), unpack(part.column("vec"))
                fine = np.isfinite(mat).all(1)  # the distances of other rows are no numbers
                if not part.column("role")[0].as_py():
                    asked.append((ids[fine], mat[fine], part.column("probes").filter(pa.array(fine))))
                    continue
                if not asked:
                    continue  # no query of the set
                if lists is None:
                    lists = _Lists(k, np.concatenate([a[0] for a in asked]), np.concatenate([a[1] for a in asked]))
                    flags = _flags([a[2] for a in asked])
                    asked = [None]
                cells = part.column("cell").to_numpy()
                before = (None, None) if last is None else last
                first = np.concatenate([[(cells[0], ids[0]) != before], (cells[1:] != cells[:-1]) | (ids[1:] != ids[:-1])])
                last = (cells[-1], ids[-1])
                ids, mat, cells, first = ids[fine], mat[fine], cells[fine], first[fine]
                cuts = [0, len(ids)] if flags is None else runs(cells)
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    if flags is None:
                        rows = np.arange(len(lists.ids))
                    elif y > x and 0 <= cells[x] + 1 < flags.shape[1]:
                        rows = np.flatnonzero(flags[:, cells[x] + 1])
                    else:
                        continue
                    for c in range(x, y, _STREAM_CHUNK):
                        to = slice(c, min(y, c + _STREAM_CHUNK))
                        lists.meet(rows, ids[to], mat[to], first[to])
        if lists is not None:
            yield from lists.rows()

    return run


def _flags(probes: list[pa.Array]) -> np.ndarray | None:
    """Query x (cell + 1): whether the query probes the cell (cell -1 holds zero vectors); None: all probe all."""
    col = pa.concat_arrays(probes)
    if len(col) == 0 or col.null_count == len(col):
        return None
    cells = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(col)), col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    out = np.zeros((len(col), (int(cells.max()) if len(cells) else -1) + 2), bool)
    out[rows, cells + 1] = True
    return out


def _probe_kernel(k: int):
    """Group = (cell, sub-block): queries probing the cell x stored rows."""

    def run(tbl: pa.Table) -> pa.Table:
        c_ids, c_mat = _sorted_side(_part(tbl, "role", 0))
        q_ids, q_mat = _sorted_side(_part(tbl, "role", 1))
        return _batch(_topk_rows(q_ids, q_mat, c_ids, c_mat, k, True))

    return run


# --------------------------------------------------------------------------
# helpers
# --------------------------------------------------------------------------

def _prep(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    ship_package(vectors.sparkSession)  # the kernels below run in Python workers
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))


def _unit(v: DataFrame) -> DataFrame:
    """``(id, vec)`` with every vector normalised once and packed as binary doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pack(unit_matrix(b.column(1)))], ["id", "vec"])

    return v.mapInArrow(run, "id long, vec binary")


def final_topk(cand: DataFrame, k: int) -> DataFrame:
    """Merge candidate (src, dst, dist) rows into the k best per source.

    Duplicated candidates (a pair found in two probes) are removed first.
    """
    w = Window.partitionBy("src").orderBy(F.col("dist").asc(), F.col("dst").asc())
    return (cand.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k)
            .select("src", "dst", F.col("rank").cast("int").alias("rank"), "dist"))


def _check_broadcast(n_rows: int, dim: int, what: str) -> None:
    size = n_rows * max(dim, 1) * 8
    if size > MAX_BROADCAST_BYTES:
        raise ValueError(f"{what}: {n_rows} x {dim} doubles ({size} bytes) exceeds the "
                         f"broadcast bound of {MAX_BROADCAST_BYTES} bytes")


# --------------------------------------------------------------------------
# public operators
# --------------------------------------------------------------------------

def knn_join(vectors: DataFrame, k: int, *, id_col: str = "id", vec_col: str = "embedding",
             mode: str = "exact", block_rows: int = 4096, num_blocks: int | None = None,
             n_cells: int | None = None, nprobe: int = 4, seed: int = 42,
             n_bits: int | None = None, n_bands: int = 8) -> DataFrame:
    """Every vector's ``k`` nearest neighbours by cosine distance.

    ``k`` counts neighbours, not the vector itself (a reference call with
    ``k=6`` corresponds to ``k=5`` here). The caller names the mode; none is
    chosen by size. The approximate modes give fewer than ``k`` rows for a
    vector whose cells or buckets hold fewer others.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    v = _prep(vectors, id_col, vec_col)
    if mode == "exact":
        return _knn_exact(v, k, num_blocks)
    if mode == "ivf":
        return _knn_ivf(v, k, n_cells, nprobe, seed, block_rows)
    if mode == "lsh":
        return _knn_lsh(v, k, n_bits, n_bands, seed, block_rows)
    if mode == "descent":
        from semweave.operators.nn_descent import nn_descent

        return nn_descent(v, k, vec_col="vec", seed=seed)[0]
    raise ValueError(f"unknown mode {mode!r}")


def _sets(v: DataFrame, n: int, num_sets: int | None = None, cells: int = 0) -> int:
    """Sets of queries: one for every core, and enough of them that a set fits a task."""
    most = SET_ROWS if not cells else max(1, min(SET_ROWS, _SET_FLAGS // cells))
    if num_sets is None:
        num_sets = max(1, min(v.sparkSession.sparkContext.defaultParallelism, math.ceil(n / 64)))
    return num_sets * max(1, math.ceil(n / num_sets / most))


def _own_set(sets: int):
    return F.pmod(F.xxhash64("id"), F.lit(sets)).cast("int")


def _run_stream(placed: DataFrame, sets: int, k: int) -> DataFrame:
    """``placed(set, role, cell, id, vec, probes)``: every set is one partition, read in order by one task."""
    rows = placed.repartitionById(sets, F.col("set")).sortWithinPartitions("set", "role", "cell", "id")
    return rows.mapInArrow(_stream_kernel(k), KNN_SCHEMA)


def stream_nearest(stored: DataFrame, queries: DataFrame, k: int, sets: int) -> DataFrame:
    """``knn(src, dst, rank, dist)`` of ``queries(id, vec[, probes])`` among ``stored(id, vec[, cell])``.

    Unit vectors as packed by :func:`_unit`. A query meets all stored rows, or
    those of the cells in ``probes``. It is sent once and a stored row once
    per set, however many cells are probed.
    """
    cell = F.col("cell") if "cell" in stored.columns else F.lit(0)
    probes = F.col("probes") if "probes" in queries.columns else F.lit(None)
    every = F.explode(F.sequence(F.lit(0), F.lit(sets - 1)))
    ask = queries.select(_own_set(sets).alias("set"), F.lit(0).alias("role"), F.lit(0).alias("cell"), "id", "vec",
                         probes.cast("array<int>").alias("probes"))
    meet = stored.select(every.alias("set"), F.lit(1).alias("role"), cell.cast("int").alias("cell"), "id", "vec",
                         F.lit(None).cast("array<int>").alias("probes"))
    return _run_stream(ask.unionByName(meet), sets, k)


def _knn_exact(v: DataFrame, k: int, num_blocks: int | None) -> DataFrame:
    sets = _sets(v, v.count(), num_blocks)  # row-group metadata only for Parquet
    # each row once as a query and once per set as a stored row, from one pass
    stored = F.transform(F.sequence(F.lit(0), F.lit(sets - 1)), lambda s: F.struct(s.alias("set"), F.lit(1).alias("role")))
    asks = F.array(F.struct(_own_set(sets).alias("set"), F.lit(0).alias("role")))
    placed = _unit(v).select("id", "vec", F.explode(F.concat(asks, stored)).alias("p")).select(
        "p.set", "p.role", F.lit(0).alias("cell"), "id", "vec", F.lit(None).cast("array<int>").alias("probes"))
    return _run_stream(placed, sets, k)


def _nearest_cells(centroids: np.ndarray, nprobe: int):
    """mapInArrow function: home cell and the ``nprobe`` probed cells of unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if n:
                sim = unpack(b.column(1)) @ centroids.T
                order = np.argsort(-sim, axis=1, kind="stable")[:, :nprobe].astype(np.int32)
                probes = list_array(order.ravel(), np.arange(n + 1) * order.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(order[:, 0]), probes],
                                                 ["id", "vec", "home", "probes"])

    return run


def _bucket_sizes(v: DataFrame, block_rows: int, name: str) -> DataFrame:
    return (v.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
            .select(F.col("bucket").alias(f"_b_{name}"),
                    F.greatest(F.lit(1), F.ceil(F.col("c") / F.lit(block_rows))).cast("int").alias(name)))


def _bucketed_candidates(v_home: DataFrame, v_probe: DataFrame, k: int, block_rows: int,
                         dedup: bool = True) -> DataFrame:
    """Equi-join stored rows and probing rows on ``bucket`` with skew splitting.

    ``v_home``: (id, vec, bucket) where each row is stored;
    ``v_probe``: (id, vec, bucket) for every bucket a row probes.
    Both sides of a bucket are split by hashed id into sub-blocks of about
    ``block_rows``; each (stored sub-block, probing sub-block) is one group.
    """
    stored, asked = _bucket_sizes(v_home, block_rows, "nsub"), _bucket_sizes(v_probe, block_rows, "nask")
    sizes = (stored.join(asked, stored["_b_nsub"] == asked["_b_nask"])
             .select(F.col("_b_nsub").alias("bucket"), "nsub", "nask"))

    def side(v: DataFrame, own: str, other: str, own_n: str, other_n: str, role: int) -> DataFrame:
        return (v.join(sizes, "bucket")
                .withColumn(own, F.pmod(F.xxhash64("id", F.lit(7)), F.col(own_n)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
                .select("bucket", "sub", "ask", "id", "vec", F.lit(role).alias("role")))

    grouped = (side(v_home, "sub", "ask", "nsub", "nask", 0)
               .unionByName(side(v_probe, "ask", "sub", "nask", "nsub", 1)).groupBy("bucket", "sub", "ask"))
    cand = grouped.applyInArrow(_probe_kernel(k), _CAND_SCHEMA)
    if dedup:
        # a row stored in several buckets (LSH bands) can meet a prober twice
        cand = cand.groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    return final_topk(cand, k)


def _fit_cells(v: DataFrame, n_cells: int | None, seed: int) -> np.ndarray:
    """Unit centroids of cosine k-means on all vectors; their matrix stays within the broadcast bound."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if n_cells is None:  # larger cells are split anyway
        first = v.select("vec").first()
        dim = len(first["vec"]) if first else 1
        n_cells = max(1, min(int(round(math.sqrt(v.count()))), MAX_BROADCAST_BYTES // (8 * max(1, dim))))
    train = v.select(array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=n_cells, seed=seed, distanceMeasure="cosine", maxIter=20).fit(train)
    cent = np.array([np.asarray(c, dtype=np.float64) for c in model.clusterCenters()])
    _check_broadcast(cent.shape[0], cent.shape[1] if cent.ndim == 2 else 0, "IVF centroids")
    return unit(cent)


def _place(v: DataFrame, centroids: np.ndarray, nprobe: int) -> DataFrame:
    """``(id, vec, home, probes)``, written once for all branches that read it."""
    bc = v.sparkSession.sparkContext.broadcast(centroids)
    nprobe = max(1, min(nprobe, len(centroids)))

    def assign(batches):
        yield from _nearest_cells(bc.value, nprobe)(batches)

    cells = materialize(_unit(v).mapInArrow(assign, "id long, vec binary, home int, probes array<int>"), "ivf_cells")
    bc.unpersist()
    return cells


def _knn_ivf(v: DataFrame, k: int, n_cells: int | None, nprobe: int, seed: int,
             block_rows: int) -> DataFrame:
    centroids = _fit_cells(v, n_cells, seed)
    n = v.count()
    if nprobe >= len(centroids):  # all cells: they need not be listed
        cells = _place(v, centroids, 1)
        return stream_nearest(cells.withColumnRenamed("home", "cell"), cells.select("id", "vec"), k, _sets(v, n))
    cells = _place(v, centroids, nprobe)
    sets = _sets(v, n, cells=len(centroids))
    if nprobe > sets:  # a row goes to fewer sets than cells
        return stream_nearest(cells.withColumnRenamed("home", "cell"), cells, k, sets)
    home = cells.select("id", "vec", F.col("home").alias("bucket"))
    probe = cells.select("id", "vec", F.explode("probes").alias("bucket"))
    # each row is stored in exactly one cell and probes distinct cells, so a
    # pair is met at most once: no de-duplication shuffle is needed
    return _bucketed_candidates(home, probe, k, block_rows, dedup=False)


def _knn_lsh(v: DataFrame, k: int, n_bits: int | None, n_bands: int, seed: int,
             block_rows: int) -> DataFrame:
    """Random-hyperplane LSH: band b of a vector = its n_bits sign bits (by
    default enough of them for buckets of about ``block_rows`` vectors)."""
    if n_bits is None:
        n_bits = max(8, math.ceil(math.log2(max(1, v.count()) / block_rows + 1)))
    dim = len(v.select("vec").first()["vec"])
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((n_bands * n_bits, dim))
    _check_broadcast(planes.shape[0], dim, "LSH hyperplanes")
    bc = v.sparkSession.sparkContext.broadcast(planes)
    weights = (1 << np.arange(n_bits)).astype(np.int64)

    def sign_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if n:
                bits = (unpack(b.column(1)) @ bc.value.T >= 0).reshape(n, n_bands, n_bits)
                keys = bits @ weights + (np.arange(n_bands, dtype=np.int64) << n_bits)[None, :]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), list_array(keys.ravel(), np.arange(n + 1) * n_bands, pa.int64())],
                    ["id", "vec", "buckets"])

    sig = materialize(_unit(v).mapInArrow(sign_bands, "id long, vec binary, buckets array<long>"), "lsh_bands")
    bc.unpersist()
    rows = sig.select("id", "vec", F.explode("buckets").alias("bucket"))
    return _bucketed_candidates(rows, rows, k, block_rows)


def knn_lookup(vectors: DataFrame, query_ids: DataFrame, k: int, *, id_col: str = "id",
               vec_col: str = "embedding", query_id_col: str = "id",
               max_queries: int = 100_000) -> DataFrame:
    """Neighbours of the given ids only: ``knn(src=query, dst, rank, dist)``.

    The query vectors are collected and broadcast (their count is checked
    against ``max_queries`` and the broadcast byte bound); each partition of
    the corpus is scanned once, keeps a local top-k per query, and a final
    window merges the partial lists. Beyond the bound, the corpus is streamed
    past sets of queries, with the same result.
    """
    v = _prep(vectors, id_col, vec_col)
    q = query_ids.select(F.col(query_id_col).cast("long").alias("qid")).distinct()
    qv = v.join(q, v["id"] == q["qid"], "left_semi")
    n_q = qv.count()
    if n_q == 0:
        return v.sparkSession.createDataFrame([], KNN_SCHEMA)
    dim = len(qv.select("vec").first()["vec"])
    if n_q > max_queries or n_q * dim * 8 > MAX_BROADCAST_BYTES:
        return stream_nearest(_unit(v), _unit(qv), k, _sets(v, n_q))
    rows = qv.collect()  # bounded by max_queries x dim, checked above
    q_ids = np.array([r["id"] for r in rows], dtype=np.int64)
    order = np.argsort(q_ids)
    q_mat = unit(np.array([rows[i]["vec"] for i in order], dtype=np.float64))
    bc = v.sparkSession.sparkContext.broadcast((q_ids[order], q_mat))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qi, qm = bc.value
        for b in batches:
            if b.num_rows:
                c_ids, c_mat = _sorted_side(b)
                yield from _batch(_topk_rows(qi, qm, c_ids, c_mat, k, True)).to_batches()

    return final_topk(v.mapInArrow(scan, _CAND_SCHEMA), k)


def _cross_kernel(k: int):
    """Group = a block of old and a block of new rows; local top-k both ways."""

    def run(tbl: pa.Table) -> pa.Table:
        a_ids, a_mat = _sorted_side(_part(tbl, "role", 0))
        b_ids, b_mat = _sorted_side(_part(tbl, "role", 1))
        one, two = _topk_rows(a_ids, a_mat, b_ids, b_mat, k, False), _topk_rows(b_ids, b_mat, a_ids, a_mat, k, False)
        return _batch([x + y for x, y in zip(one, two, strict=True)])

    return run


def knn_append(knn: DataFrame, old: DataFrame, new: DataFrame, k: int, *, id_col: str = "id",
               vec_col: str = "embedding", block_rows: int = 4096) -> DataFrame:
    """The exact kNN table of ``old`` and ``new`` vectors, from that of the old ones.

    Only pairs with a new vector are measured: new rows among themselves, and
    blocks of new rows against blocks of old ones, each product used in both
    directions. An old vector's list is its old one and the new vectors that
    are nearer; neighbours that drop out are evicted by the same ranking. The
    rows equal those of a rebuild if ``knn`` holds the ``k`` nearest of every
    old vector. New ids that ``old`` holds already are an error.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    a, b = _prep(old, id_col, vec_col), _prep(new, id_col, vec_col)
    if not a.select("id").join(b.select("id"), "id", "left_semi").isEmpty():
        raise ValueError("some new ids are in the table already")
    na, nb = (max(1, math.ceil(x.count() / block_rows)) for x in (a, b))

    def side(v: DataFrame, own: str, n_own: int, other: str, n_other: int, role: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int")
        return _unit(v).withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))).select(
            "p", "q", "id", "vec", F.lit(role).alias("role"))

    pairs = side(a, "p", na, "q", nb, 0).unionByName(side(b, "q", nb, "p", na, 1))
    across = pairs.groupBy("p", "q").applyInArrow(_cross_kernel(k), _CAND_SCHEMA)
    inside = _knn_exact(b, k, None).select("src", "dst", "dist")
    kept = knn.where(F.col("rank") <= k).select("src", "dst", "dist")
    return final_topk(kept.unionByName(across).unionByName(inside), k)


def corpus_shape(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """One row ``(n_rows, dim)``: the count needs no column data (Parquet
    row-group metadata) and the dimension is that of one row (vectors of a
    table have one size)."""
    first = vectors.select(F.size(vec_col).cast("int").alias("dim")).limit(1)
    return vectors.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit((first.first() or [None])[0]).cast("int").alias("dim"))


def knn_recall(approx: DataFrame, exact: DataFrame, k: int | None = None) -> DataFrame:
    """Recall@k of an approximate kNN table against the exact one.

    One row: ``(k, pairs, hits, recall)``; equi-join on ``(src, dst)``.
    """
    if k is not None:
        approx = approx.filter(F.col("rank") <= k)
        exact = exact.filter(F.col("rank") <= k)
    e = exact.select("src", "dst", F.lit(1).alias("e"))
    a = approx.select("src", "dst", F.lit(1).alias("a"))
    j = e.join(a, ["src", "dst"], "left")
    return j.agg(
        F.lit(k).cast("int").alias("k"),
        F.count(F.lit(1)).alias("pairs"),
        F.count("a").alias("hits"),
    ).withColumn("recall", F.round(F.col("hits") / F.greatest(F.col("pairs"), F.lit(1)), 6))


def recall_by_probes(vectors: DataFrame, exact: DataFrame, k: int, nprobes: list[int], *, id_col: str = "id",
                     vec_col: str = "embedding", n_cells: int | None = None, seed: int = 42) -> DataFrame:
    """Recall@k of the IVF mode for several ``nprobe`` from one fit, over the sources of ``exact``.

    ``exact`` holds the true neighbours of any set of sources (all of them, or
    a sample by ``knn_lookup``). IVF measures every vector of the cells it
    probes exactly, so it finds a true neighbour if and only if that lies in
    one of them: the place of the neighbour's cell in the source's order
    of cells gives the answer for every ``nprobe`` at once.

    A row per ``nprobe``: ``(k, pairs, hits, recall, lo, hi, sources, nprobe,
    n_cells)``; ``lo`` and ``hi`` are the 95 % interval of the mean over the
    sources' own recalls.
    """
    v = _prep(vectors, id_col, vec_col)
    centroids = _fit_cells(v, n_cells, seed)
    found = len(centroids)
    pairs = exact.where(F.col("rank") <= k).select("src", "dst")
    asked = v.join(pairs.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    homes = _place(v, centroids, 1).select(F.col("id").alias("dst"), "home")
    order = _place(asked, centroids, found).select(F.col("id").alias("src"), "probes")  # all cells, for the sources only
    at = pairs.join(homes, "dst").join(order, "src").select("src", F.array_position("probes", F.col("home")).alias("at"))
    probes = sorted({min(p, found) for p in nprobes})
    per = at.groupBy("src").agg(F.count(F.lit(1)).alias("pairs"),
                                *[F.count_if(F.col("at") <= p).alias(f"h{p}") for p in probes])
    each = per.select("pairs", F.inline(F.array(*[F.struct(F.lit(p).alias("nprobe"), F.col(f"h{p}").alias("h"))
                                                  for p in probes])))
    share = F.col("h") / F.col("pairs")
    half = 1.96 * F.coalesce(F.stddev_samp(share), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))
    out = each.groupBy("nprobe").agg(F.sum("pairs").alias("pairs"), F.sum("h").alias("hits"), F.avg(share).alias("mean"),
                                     half.alias("half"), F.count(F.lit(1)).alias("sources"))
    return out.select(F.lit(k).cast("int").alias("k"), "pairs", "hits", F.round(F.col("hits") / F.col("pairs"), 6).alias("recall"),
                      F.round(F.greatest(F.lit(0.0), F.col("mean") - F.col("half")), 6).alias("lo"),
                      F.round(F.least(F.lit(1.0), F.col("mean") + F.col("half")), 6).alias("hi"), "sources", "nprobe",
                      F.lit(found).alias("n_cells"))
