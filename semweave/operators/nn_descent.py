"""Approximate cosine kNN by neighbour descent on the kNN table.

Start: each of ``tables`` sets of random hyperplanes cuts the vectors into
buckets, and a hash of the id cuts buckets into blocks of about ``block``
vectors; the pairs of a block are measured. From then on every vector has
a pool of the ``pool`` nearest it has met.

A round:

1. *lists*: the pool of a vector and, in reverse, the ``reverse`` nearest of
   those that have it in their pools;
2. *local joins*: a vector that is reached over neighbours ``c`` scores the
   sum of ``cos(a, c) cos(c, b)``; the ``budget`` best that were not met
   before are proposed. No vector moves for this, only lists of ids and cosines;
3. *distances* of the proposed pairs, each pair once for both directions;
4. pools are updated; a round's *updates* are the changes among the ``k``
   nearest. The search ends when they are at most ``delta * k * N``, when
   nothing new is proposed, or after ``max_rounds``.

Vectors are numbered in the order of their ids, and what moves are packed
arrays of these numbers (:class:`_Layout`). A task of the local joins holds the
lists of one *set* of up to ``SET_ROWS`` vectors and reads the lists of all as a
stream, cut by neighbour into *chunks*: a chunk has all terms of a score, so
only the best so far are kept between chunks. The distances are measured by
set in the same way. Lists and vectors are thus sent once per set, instead of
once for every vector that has them as neighbours. Pools and lists are
made by *block* of a set; what a hub receives is cut to its nearest as it
arrives, so no task holds more than a block, a set or a chunk.

Every table of a round is written to the shared checkpoint folder; shuffle
files go with the job that made them. The distances and scores of a
round are linear in the number of vectors. ``rounds`` reports
pairs measured and updates, so recall can be weighed against the share of
all pairs (``operators.knn.knn_recall``); the exact way is
``knn_join(mode="exact")``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semweave.functions.arrow import list_array, map_groups, pack, runs, unit_matrix, unpack
from semweave.operators.knn import _place_in_run
from semweave.session import drop_materialized, materialize, ship_package, shuffles_released

POOL, REVERSE, BUDGET = 64, 64, 60
TABLES, BLOCK = 6, 32
BLOCK_ROWS = 8192  # vectors of a block, whose pools and lists are made together
SET_ROWS = 131_072  # vectors whose lists a local join holds
CHUNK, CHUNK_ROWS = 4_000_000, 65_536  # list entries (about) and neighbours of a chunk at most: what it holds of the other lists
PACK = 32_768  # entries of a packed row
HELD = 4_000_000  # entries that are held before they are cut to the nearest
TERMS = 1 << 18  # terms of scores that are summed at once
_PACKED = "part int, at int, n long, d binary"
_LOW = np.uint64(0xFFFFFFFF)
_MET = np.dtype([("p", np.int32), ("y", np.uint16)])  # place in the set, number in the chunk


def distance(cosine: np.ndarray) -> np.ndarray:
    """Distances as in the exact join: 12 places, zero for equal vectors."""
    d = np.round(1.0 - cosine, 12)
    d[np.abs(d) < 1e-9] = 0.0
    return d


class _Layout:
    """Where the vector with number ``x`` lies: block ``x % blocks``, set ``x % sets``, as a neighbour chunk ``x % chunks``.

    A set has ``blocks / sets`` whole blocks; a vector's place in its set (or
    among all) is that of its block times ``rows``, and its place in the block.
    """

    def __init__(self, count: int, cores: int, length: int):
        self.sets = max(1, min(cores, math.ceil(count / 64)))
        self.sets *= max(1, math.ceil(count / self.sets / SET_ROWS))
        self.blocks = self.sets * max(1, math.ceil(count / self.sets / BLOCK_ROWS))
        self.rows = max(1, math.ceil(count / self.blocks))
        self.chunks = max(1, math.ceil(count * length / CHUNK), math.ceil(count / CHUNK_ROWS))
        self.bits = (max(1, math.ceil(count / self.chunks)) - 1).bit_length()  # of a number inside a chunk, 16 at most
        self.kind = np.dtype(np.int32 if count < 2**30 else np.int64)
        self.count = np.dtype(np.uint16 if length < 2**16 else np.int32)
        self.pair = np.dtype([("a", self.kind), ("b", self.kind)])
        self.edge = np.dtype([("a", self.kind), ("b", self.kind), ("d", np.float64)])

    def place(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64)
        return x % self.blocks * self.rows + x // self.blocks

    def place_in_set(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64)
        return x % self.blocks // self.sets * self.rows + x // self.blocks

    def of_set(self, s: int) -> np.ndarray:
        """The numbers at the places of a set (at its end also some that no vector has)."""
        at = np.arange(self.blocks // self.sets * self.rows)
        return at % self.rows * self.blocks + at // self.rows * self.sets + s

    def owned(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A pair's owner, the same one either way, and the other: owners are spread evenly over the numbers."""
        low, high = np.minimum(x, y), np.maximum(x, y)
        odd = (low + high) % 2 == 1
        return np.where(odd, high, low), np.where(odd, low, high)

    def edges(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), self.edge)
        out["a"], out["b"], out["d"] = a, b, d
        return out

    def both(self, e: np.ndarray) -> np.ndarray:
        return np.concatenate([e, self.edges(e["b"], e["a"], e["d"])])


# --------------------------------------------------------------------------
# packed rows
# --------------------------------------------------------------------------

def _packed(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    part, at, n, d = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(at, pa.int32()), pa.array(n, pa.int64()),
                                       pa.array(d, pa.binary())], ["part", "at", "n", "d"])


def _dealt(parts: np.ndarray, entries: np.ndarray, at: int = 0) -> Iterator[pa.RecordBatch]:
    """Entries in packed rows by part."""
    if not len(entries):
        return
    order = np.argsort(parts.astype(np.uint16) if parts.max() < 2**16 else parts, kind="stable")
    parts, entries = parts[order], entries[order]
    cuts = runs(parts)
    yield _packed([(int(parts[c]), at, min(e, c + PACK) - c, entries[c:min(e, c + PACK)].tobytes())
                   for s, e in zip(cuts[:-1], cuts[1:], strict=True) for c in range(s, e, PACK)])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, pa.Buffer]]:
    for b in batches:
        part, at, n, d = (b.column(i) for i in range(4))
        for i in range(b.num_rows):
            yield part[i].as_py(), at[i].as_py(), n[i].as_py(), d[i].as_buffer()


def _bulks(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray]:
    """The entries of packed rows, many at a time."""
    held, size = [], 0
    for _, _, _, d in _read(batches):
        held.append(np.frombuffer(d, kind))
        size += len(held[-1])
        if size >= HELD // 4:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def _by_part(df: DataFrame, sets: int) -> DataFrame:
    """Every set's parts in one partition, in order."""
    return df.repartitionById(sets, F.pmod(F.col("part"), F.lit(sets)).cast("int")).sortWithinPartitions("part", "at", "n")


def _nearest(e: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``most`` nearest of every ``a``, ordered by ``(dist, b)``, and their ranks from 0."""
    order = np.lexsort((e["b"], e["d"], e["a"]))
    rank = _place_in_run(e["a"][order])
    return order[rank < most], rank[rank < most]


def _expand(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``first, first + 1, ...`` for every count."""
    ends = np.cumsum(counts)
    return np.repeat(first - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


# --------------------------------------------------------------------------
# the start: pairs of hyperplane blocks
# --------------------------------------------------------------------------

def _blocks(v: DataFrame, n: int, dim: int, tables: int, block: int, seed: int) -> DataFrame:
    """``(key, x, vec)``: every vector once per table, in blocks of about ``block`` rows."""
    bits = max(1, math.ceil(math.log2(max(2, n / block))))
    planes = np.random.default_rng(seed).standard_normal((tables * bits, dim))
    weights = 1 << np.arange(bits, dtype=np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code = (unpack(b.column(1)) @ planes.T >= 0).reshape(b.num_rows, tables, bits) @ weights
                code += np.arange(tables, dtype=np.int64) << bits
                lists = list_array(code.ravel(), np.arange(b.num_rows + 1) * tables, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), lists], ["id", "codes"])

    codes = materialize(v.select("id", "vec").mapInArrow(sign, "id long, codes array<long>")
                        .select("id", F.explode("codes").alias("code")), "nnd_codes")
    sizes = codes.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / block).alias("subs"))
    j = codes.join(sizes, "code").select(
        "id", F.xxhash64("code", F.pmod(F.xxhash64("id", "code"), F.col("subs"))).alias("key"))
    return j.join(v, "id").select("key", "x", "vec")


def _all_pairs(lay: _Layout):
    """Pairs of every block (a hash clash joins two blocks: more pairs, none wrong), packed by the owner's block."""

    def run(tbl: pa.Table) -> Iterator[pa.RecordBatch]:
        starts = runs(tbl.column("key").to_numpy())
        x, vec = tbl.column("x").to_numpy(), tbl.column("vec").combine_chunks()
        out = []
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if e - s > 1:
                m = unpack(vec.slice(s, e - s))
                i, j = np.triu_indices(e - s, 1)
                a, b = lay.owned(x[s:e][i], x[s:e][j])
                out.append(lay.edges(a, b, distance((m @ m.T)[i, j])))
        if out:
            e = np.concatenate(out)
            yield from _dealt(e["a"] % lay.blocks, e)

    return run


def _distinct_pairs(lay: _Layout):
    """The pairs of an owner's block once, with the least distance; ``n`` counts them all."""

    def once(held: list[np.ndarray]) -> np.ndarray:
        e = np.concatenate(held)
        e = e[np.lexsort((e["d"], e["b"], e["a"]))]
        return e[np.append(True, (e["a"][1:] != e["a"][:-1]) | (e["b"][1:] != e["b"][:-1]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in groupby(_read(batches), itemgetter(0)):
            held, size, times = [], 0, 0
            for _, _, n, d in rows:
                held.append(np.frombuffer(d, lay.edge))
                size, times = size + n, times + n
                if size > HELD:
                    held = [once(held)]
                    size = len(held[0])
            e = once(held)
            yield _packed([(part, 0, 0 if c else times, e[c:c + PACK].tobytes()) for c in range(0, len(e), PACK)])

    return run


# --------------------------------------------------------------------------
# pools and lists, by block
# --------------------------------------------------------------------------

def _directed(lay: _Layout):
    """Measured pairs in both directions, by the block of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in _bulks(batches, lay.edge):
            e = lay.both(e)
            yield from _dealt(e["a"] % lay.blocks, e, 1)

    return run


def _merged(lay: _Layout, pool: int, k: int):
    """Pools (``at`` 0) and new neighbours (``at`` 1) of a block: the new pools; ``n`` counts what is new among the ``k`` nearest."""

    def cut(held: list[np.ndarray], new: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e, fresh = np.concatenate(held), np.concatenate(new)
        best, rank = _nearest(e, pool)
        return e[best], fresh[best], rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in groupby(_read(batches), itemgetter(0)):
            held, new, size = [], [], 0
            for _, at, _, d in rows:
                held.append(np.frombuffer(d, lay.edge))
                new.append(np.full(len(held[-1]), at == 1))
                size += len(held[-1])
                if size > HELD:
                    e, fresh, _ = cut(held, new)
                    held, new, size = [e], [fresh], 0
            e, fresh, rank = cut(held, new)
            fresh &= rank < k
            starts = runs(e["a"])  # a pool lies in one packed row
            cuts = np.append(starts[np.searchsorted(starts, np.arange(0, len(e), PACK), side="right") - 1], len(e))
            cuts = np.unique(cuts)
            yield _packed([(part, 0, int(fresh[s:t].sum()), e[s:t].tobytes())
                           for s, t in zip(cuts[:-1], cuts[1:], strict=True)])

    return run


def _top(lay: _Layout, k: int):
    """``(a, b, rank, dist)`` of the ``k`` nearest in the pools."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, d in _read(batches):
            e = np.frombuffer(d, lay.edge)
            rank = _place_in_run(e["a"]) + 1
            e, rank = e[rank <= k], rank[rank <= k]
            yield pa.RecordBatch.from_arrays([pa.array(e["a"].astype(np.int64)), pa.array(e["b"].astype(np.int64)),
                                              pa.array(rank.astype(np.int32)), pa.array(e["d"].copy())],
                                             ["a", "b", "rank", "dist"])

    return run


def _reversed(lay: _Layout):
    """Pools as they are (``at`` 0) and their entries by the block of the neighbour (``at`` 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in _bulks(batches, lay.edge):
            yield from _dealt(e["a"] % lay.blocks, e)
            yield from _dealt(e["b"] % lay.blocks, lay.edges(e["b"], e["a"], e["d"]), 1)

    return run


def _lists(lay: _Layout, reverse: int):
    """The lists of a block: neighbours in both directions, at most pool + reverse of them.

    Row ``at`` -1: how many every vector has, their places and cosines. Row
    ``at`` 2j: the same of those in chunk j, with their numbers inside the chunk.
    """

    def cut(held: list[np.ndarray]) -> list[np.ndarray]:
        e = np.concatenate(held)
        return [e[_nearest(e, reverse)[0]]]

    def row(part: int, at: int, own: np.ndarray, nb: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
        counts = np.bincount(own, minlength=lay.rows).astype(lay.count)
        return _packed([(part, at, part, counts.tobytes() + nb.tobytes() + sim.tobytes())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in groupby(_read(batches), itemgetter(0)):
            ahead, back, size = [], [], 0
            for _, at, _, d in rows:
                (back if at else ahead).append(np.frombuffer(d, lay.edge))
                size += at * len(back[-1]) if at else 0
                if size > HELD:
                    back, size = cut(back), 0
            e = np.concatenate(ahead + (cut(back) if back else []))
            sim = (1 - e["d"]).astype(np.float32)
            order = np.lexsort((sim, e["b"], e["a"]))
            a, b, sim = e["a"][order], e["b"][order], sim[order]
            bits = sim.view(np.int32)
            once = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (bits[1:] != bits[:-1]))
            a, b, sim = a[once], b[once], np.maximum(sim[once], np.float32(0))
            own = a // lay.blocks
            yield row(part, -1, own, lay.place(b).astype(lay.kind), sim)
            chunk = b % lay.chunks
            for j in range(lay.chunks):
                here = chunk == j if lay.chunks > 1 else slice(None)
                yield row(part, 2 * j, own[here], (b[here] // lay.chunks).astype(np.uint16), sim[here])

    return run


# --------------------------------------------------------------------------
# local joins and distances, by set
# --------------------------------------------------------------------------

def _known(lay: _Layout):
    """All pairs measured so far, both ways: place of the first in its set and number of the second in its chunk (``at`` 2j + 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in _bulks(batches, lay.edge):
            a, b = np.concatenate([e["a"], e["b"]]), np.concatenate([e["b"], e["a"]])
            out = np.empty(len(a), _MET)
            out["p"], out["y"] = lay.place_in_set(a), b // lay.chunks
            for j in range(lay.chunks):
                here = b % lay.chunks == j if lay.chunks > 1 else slice(None)
                yield from _dealt(a[here] % lay.sets, out[here], 2 * j + 1)

    return run


class _Best:
    """The ``budget`` best partners of every vector of a set, in the order ``(-score, b)``.

    What may be among them is kept aside, and merged once it is much.
    """

    def __init__(self, rows: int, budget: int, kind: np.dtype):
        self.budget = budget
        self.score = np.zeros((rows, budget))
        self.b = np.full((rows, budget), -1, kind)
        self.least = np.full(rows, np.nextafter(0, 1))  # what a score must reach
        self.aside: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def offer(self, row: np.ndarray, b: np.ndarray, score: np.ndarray) -> None:
        """``row`` ascends; scores reach ``least``. By 32 bits of the score most of the others are sorted out."""
        if not len(row):
            return
        key = ((row - row[0]).astype(np.uint64) << np.uint64(32)) | (_LOW - score.astype(np.float32).view(np.uint32))
        ordered = np.sort(key)
        starts = runs(ordered >> np.uint64(32))
        last = ordered[np.minimum(starts[:-1] + self.budget, starts[1:]) - 1]
        keep = key <= np.repeat(last, np.diff(starts))
        self.aside.append((row[keep].astype(np.int32), b[keep].astype(self.b.dtype), score[keep]))
        self.size += len(self.aside[-1][0])

    def merge(self) -> None:
        row, b, score = (np.concatenate(x) for x in zip(*self.aside, strict=True)) if self.aside else (self.b[:0, 0],) * 3
        self.aside, self.size = [], 0
        order = np.argsort(row, kind="stable")
        row, b, score = row[order], b[order], score[order]
        for c in range(0, len(self.b), BLOCK_ROWS):
            x, y = np.searchsorted(row, [c, c + BLOCK_ROWS])
            if x < y:
                self._enter(row[x:y], b[x:y], score[x:y])

    def _enter(self, row: np.ndarray, b: np.ndarray, score: np.ndarray) -> None:
        rows = np.unique(row)
        old, place = np.nonzero(self.b[rows] >= 0)
        row = np.concatenate([rows[old], row])
        b = np.concatenate([self.b[rows[old], place], b])
        score = np.concatenate([self.score[rows[old], place], score])
        order = np.lexsort((b, -score, row))
        row, b, score = row[order], b[order], score[order]
        place = _place_in_run(row)
        best = place < self.budget
        self.b[row[best], place[best]] = b[best]
        self.score[row[best], place[best]] = score[best]
        self.least[rows] = np.maximum(self.least[rows], self.score[rows, -1])


class _Join:
    """The lists of a set, meeting those of all vectors chunk by chunk."""

    def __init__(self, lay: _Layout, s: int, budget: int, lists: list[tuple[int, pa.Buffer]]):
        self.lay, self.x = lay, lay.of_set(s)
        self.counts = np.zeros(len(self.x), np.int64)
        nb, sim = [np.zeros(0, lay.kind)], [np.zeros(0, np.float32)]
        for block, d in sorted(lists, key=itemgetter(0)):
            counts, places, cosines = _cut_row(lay, d, lay.kind)
            at = block // lay.sets * lay.rows
            self.counts[at:at + lay.rows] = counts
            nb.append(places)
            sim.append(cosines)
        self.nb, self.sim = np.concatenate(nb), np.concatenate(sim)
        self.at = np.concatenate([[0], np.cumsum(self.counts)])
        self.best, self.chunk = _Best(len(self.x), budget, lay.kind), 0

    def meet(self, j: int, lists: list[tuple[int, pa.Buffer]], known: list[np.ndarray]) -> None:
        lay = self.lay
        first, length = (np.zeros(lay.blocks * lay.rows, x) for x in (np.int64, lay.count))
        nb, sim, size = [], [], 0
        for block, d in lists:
            counts, numbers, cosines = _cut_row(lay, d, np.uint16)
            at = slice(block * lay.rows, (block + 1) * lay.rows)
            length[at] = counts
            first[at] = size + np.cumsum(counts) - counts
            size += len(numbers)
            nb.append(numbers)
            sim.append(cosines)
        if not size:
            return
        nb, sim = np.concatenate(nb), np.concatenate(sim)
        if size < 2**31:
            first = first.astype(np.int32)  # it is looked up at random
        mine = np.flatnonzero(self.x % lay.chunks == j)  # no vector meets itself
        met = np.concatenate([(mine << lay.bits) | self.x[mine] // lay.chunks]
                             + [(k["p"].astype(np.int64) << lay.bits) | k["y"] for k in known])
        met.sort()
        met_at = np.searchsorted(met, np.arange(len(self.x) + 1) << lay.bits)
        terms = np.cumsum(length[self.nb], dtype=np.int64)
        terms = np.where(self.at > 0, terms[self.at - 1], 0) if len(terms) else np.zeros(len(self.at), np.int64)  # of the vectors before
        p = 0
        while p < len(self.x):
            q = max(p + 1, int(np.searchsorted(terms, terms[p] + TERMS, side="right")) - 1)
            if terms[q] > terms[p]:
                self._score(j, p, q, terms, first, length, nb, sim, met[met_at[p]:met_at[q]])
            if self.best.size > HELD // 2:
                self.best.merge()
            p = q
        self.chunk += 1
        if not self.chunk & (self.chunk - 1):
            self.best.merge()

    def _score(self, j: int, p: int, q: int, at: np.ndarray, first: np.ndarray, length: np.ndarray, nb: np.ndarray,
               sim: np.ndarray, met: np.ndarray) -> None:
        """Scores of the vectors at places p to q. Some rows at a time have keys of 16 bits, which are sorted in linear time."""
        bits = self.lay.bits
        some = 1 << (16 - bits)
        s, e = self.at[p], self.at[q]
        over = self.nb[s:e]
        lengths = length[over].astype(np.int64)
        take = _expand(first[over], lengths)
        terms = sim[take] * np.repeat(self.sim[s:e], lengths)
        row = np.repeat((np.arange(q - p) % some << bits).astype(np.uint16), self.counts[p:q])
        key = nb[take] | np.repeat(row, lengths)
        cuts = np.append(at[p:q:some], at[q]) - at[p]
        order = np.empty(len(key), np.int64)
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            np.add(key[x:y].argsort(kind="stable"), x, out=order[x:y])
        pairs = np.repeat(np.arange(len(cuts) - 1) << 16, np.diff(cuts)) | key[order]  # the row, and the number in the chunk
        starts = runs(pairs)[:-1]
        score = np.add.reduceat(terms[order].astype(np.float64), starts)
        pairs = pairs[starts]
        good = score >= self.best.least[p:q][pairs >> bits]
        gone = met - (p << bits)
        found = np.minimum(np.searchsorted(pairs, gone), len(pairs) - 1)
        good[found[pairs[found] == gone]] = False
        pairs, score = pairs[good], score[good]
        b = (pairs & ((1 << bits) - 1)) * self.lay.chunks + j
        self.best.offer((pairs >> bits) + p, b, score)

    def proposed(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.best.merge()
        for c in range(0, len(self.x), BLOCK_ROWS):
            b = self.best.b[c:c + BLOCK_ROWS]
            row, place = np.nonzero(b >= 0)
            yield self.x[c + row], b[row, place]


def _cut_row(lay: _Layout, d: pa.Buffer, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, neighbours and cosines of a row of :func:`_lists`."""
    counts = np.frombuffer(d, lay.count, lay.rows).astype(np.int64)
    size, at = int(counts.sum()), lay.count.itemsize * lay.rows
    width = np.dtype(kind).itemsize
    return counts, np.frombuffer(d, kind, size, at), np.frombuffer(d, np.float32, size, at + width * size)


def _propose(lay: _Layout, budget: int):
    """Pairs proposed in a set, by the set of their owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in groupby(_read(batches), itemgetter(0)):
            join = None
            for j, some in groupby(rows, lambda r: r[1] // 2):
                lists, known = [], []
                for _, at, n, d in some:
                    if j >= 0 and at % 2:
                        known.append(np.frombuffer(d, _MET))
                    else:
                        lists.append((n, d))
                if j < 0:
                    join = _Join(lay, s, budget, lists)
                elif join is not None:
                    join.meet(j, lists, known)
            if join is None:
                continue
            for x, y in join.proposed():
                a, b = lay.owned(x, y)
                out = np.empty(len(a), lay.pair)
                out["a"], out["b"] = a, b
                yield from _dealt(a % lay.sets, out)

    return run


def _pack_vectors(lay: _Layout):
    """``(x, vec)`` by set as packed rows: ``n`` numbers, then their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy()
            cuts = runs(x % lay.sets)
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                for c in range(s, e, 1024):
                    some = b.slice(c, min(e, c + 1024) - c)
                    yield _packed([(int(x[s] % lay.sets), 1, some.num_rows,
                                    x[c:c + some.num_rows].astype(lay.kind).tobytes() + unpack(some.column(1)).tobytes())])

    return run


def _measure(lay: _Layout):
    """Rows of a set: proposed pairs (``at`` 0), the set's vectors (1), all vectors (2). Every pair is measured once."""

    def vectors(n: int, d: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(d, lay.kind, n), np.frombuffer(d, np.float64, offset=lay.kind.itemsize * n).reshape(n, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in groupby(_read(batches), itemgetter(0)):
            asked, own, a = [], [], None
            for _, at, n, d in rows:
                if at == 0:
                    asked.append(np.frombuffer(d, lay.pair))
                    continue
                if at == 1:
                    own.append(vectors(n, d))
                    continue
                if not asked or not own:
                    break
                if a is None:
                    e = np.concatenate(asked)
                    e = e[np.lexsort((e["a"], e["b"]))]
                    e = e[np.append(True, (e["a"][1:] != e["a"][:-1]) | (e["b"][1:] != e["b"][:-1]))]
                    a, b = e["a"].copy(), e["b"].copy()
                    x, m = np.concatenate([o[0] for o in own]), np.concatenate([o[1] for o in own])
                    order = np.argsort(x, kind="stable")
                    x, m = x[order], m[order]
                    at_a = np.searchsorted(x, a)
                    of_a = np.searchsorted(x, a, side="right") - at_a  # rows of one id
                y, far = vectors(n, d)
                at_b = np.searchsorted(b, y)
                counts = np.searchsorted(b, y, side="right") - at_b
                pair, right = _expand(at_b, counts), np.repeat(np.arange(n), counts)
                left = _expand(at_a[pair], of_a[pair])
                pair, right = np.repeat(pair, of_a[pair]), np.repeat(right, of_a[pair])
                for c in range(0, len(pair), PACK):
                    to = slice(c, c + PACK)
                    d = distance(np.einsum("ij,ij->i", m[left[to]], far[right[to]]))
                    yield _packed([(s, 0, len(d), lay.edges(a[pair[to]], b[pair[to]], d).tobytes())])

    return run


def _numbered(v: DataFrame) -> tuple[DataFrame, int]:
    """``(id, x)``: the distinct ids, numbered from 0 in their order, and how many there are."""
    ids = v.select("id").where(F.col("id").isNotNull()).distinct()
    parts, got = materialize(ids.repartitionByRange("id").sortWithinPartitions("id").select(
        "id", F.spark_partition_id().alias("part")), "nnd_ids", observe={"ids": F.count(F.lit(1))})
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    ahead = parts.groupBy("part").count().select("part", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    index = materialize(parts.withColumn("r", rank).join(F.broadcast(ahead), "part")
                        .select("id", (F.col("before") + F.col("r") - 1).alias("x")), "nnd_index")
    drop_materialized(parts)
    return index, int(got.get("ids") or 0)


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vec)`` with vectors of length one as binary doubles, written once."""
    ship_package(vectors.sparkSession)
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pack(unit_matrix(b.column(1)))], ["id", "vec"])

    return materialize(v.mapInArrow(run, "id long, vec binary"), "unit")


def nn_descent(vectors: DataFrame, k: int, *, id_col: str = "id", vec_col: str = "embedding", pool: int = POOL,
               reverse: int = REVERSE, budget: int = BUDGET, tables: int = TABLES, block: int = BLOCK,
               max_rounds: int = 20, delta: float = 0.01, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(knn(src, dst, rank, dist), rounds(round, pairs, updates))`` of unique ids.

    ``pairs`` counts the distances computed in a round (round 0 is the
    start), ``updates`` the new entries among the ``k`` nearest. A vector
    gets fewer than ``k`` rows only if it has met fewer others.
    """
    pool = max(pool, k)
    spark = vectors.sparkSession
    v = unit_vectors(vectors, id_col, vec_col)
    head = v.select((F.length("vec") / 8).cast("int").alias("d")).first()
    rounds_schema = "round int, pairs long, updates long"
    if head is None:
        return (spark.createDataFrame([], "src long, dst long, rank int, dist double"),
                spark.createDataFrame([], rounds_schema))
    n = v.count()
    with shuffles_released(spark):
        knn, index, log = _descend(v, n, head["d"], k, pool, reverse, budget, tables, block, max_rounds, delta, seed)
    src, dst = (index.select(F.col("id").alias(name), F.col("x").alias(x)) for name, x in (("src", "a"), ("dst", "b")))
    return (knn.join(src, "a").join(dst, "b").select("src", "dst", "rank", "dist"),
            spark.createDataFrame(log, rounds_schema))


def _descend(v: DataFrame, n: int, dim: int, k: int, pool: int, reverse: int, budget: int, tables: int, block: int,
             max_rounds: int, delta: float, seed: int) -> tuple[DataFrame, DataFrame, list[tuple[int, int, int]]]:
    """``(a, b, rank, dist)`` by numbers, their ids and the log of the rounds."""
    index, total = _numbered(v)
    lay = _Layout(total, v.sparkSession.sparkContext.defaultParallelism, pool + reverse)
    numbered = materialize(v.join(index, "id").select("id", "x", "vec"), "nnd_vectors")
    drop_materialized(v)
    every = F.sequence(F.lit(0), F.lit(lay.sets - 1))
    dealt = numbered.select("x", "vec").repartitionById(lay.sets, F.pmod("x", F.lit(lay.sets)).cast("int"))
    packed = materialize(dealt.sortWithinPartitions("x").mapInArrow(_pack_vectors(lay), _PACKED), "nnd_packed")
    met = map_groups(_blocks(numbered, n, dim, tables, block, seed), "key", _all_pairs(lay), _PACKED)
    pairs = {"pairs": F.sum("n")}
    seen, got = materialize(_by_part(met, lay.sets).mapInArrow(_distinct_pairs(lay), _PACKED), "nnd_pairs", observe=pairs)
    drop_materialized(numbered)
    measured = [seen]
    log = [(0, int(got.get("pairs") or 0), 0)]
    ways = seen.mapInArrow(_directed(lay), _PACKED)
    best = materialize(_by_part(ways, lay.sets).mapInArrow(_merged(lay, pool, k), _PACKED), "nnd_pool")
    for r in range(1, max_rounds + 1):
        both = best.mapInArrow(_reversed(lay), _PACKED)
        lists = _by_part(both, lay.sets).mapInArrow(_lists(lay, reverse), _PACKED)
        own = F.array(F.pmod("part", F.lit(lay.sets)).cast("int"))
        lists = lists.select(F.explode(F.when(F.col("at") < 0, own).otherwise(every)).alias("part"), "at", "n", "d")
        known = measured[0]
        for m in measured[1:]:
            known = known.unionByName(m)
        rows = lists.unionByName(known.mapInArrow(_known(lay), _PACKED))
        asked = _by_part(rows, lay.sets).mapInArrow(_propose(lay, budget), _PACKED)
        rows = asked.unionByName(packed).unionByName(
            packed.select(F.explode(every).alias("part"), F.lit(2).alias("at"), "n", "d"))
        new, got = materialize(_by_part(rows, lay.sets).mapInArrow(_measure(lay), _PACKED), "nnd_pairs", observe=pairs)
        ways = best.select("part", F.lit(0).alias("at"), "n", "d").unionByName(new.mapInArrow(_directed(lay), _PACKED))
        old_best = best
        best, seen_now = materialize(_by_part(ways, lay.sets).mapInArrow(_merged(lay, pool, k), _PACKED), "nnd_pool",
                                     observe={"updates": F.sum("n")})
        measured.append(new)
        drop_materialized(old_best)
        log.append((r, int(got.get("pairs") or 0), int(seen_now.get("updates") or 0)))
        if not log[-1][1] or log[-1][2] <= delta * k * n:
            break
    knn = materialize(best.mapInArrow(_top(lay, k), "a long, b long, rank int, dist double"), "nnd_knn")
    for t in (*measured, best, packed):
        drop_materialized(t)
    return knn, index, log
