"""Line dedup: exact repeats by key, near repeats by a segment-partition edit join.

A line counts if, without white space at its ends, it has at least
``min_chars`` code points; other lines are left alone. With ``exact_chars`` the
exact part has a minimum of its own (1: every line that is not empty). Lines are ordered by
(document id, line number). A line goes if an equal line stands before it,
or if a line within ``TAU`` edits first stands before its own first place.

The edit join: a line of length l is cut into ``TAU + 1`` even segments; two
lines within ``TAU`` edits share a segment, as a substring of the longer one
near the same place. Every line gives its segments (index) and, for each
length down to l - ``TAU``, the few substrings that the multi-match windows
allow (probes); the key is a hash of (length, segment number, substring).
Rows that meet under a key are cut into bounded blocks (a hot segment becomes
many block pairs), their texts are attached, and a banded bit-parallel edit
distance confirms what is left after common ends are cut off. A block pair
yields each line at most once, never all pairs.

Which lines need their text is told by a bitmap of fixed size, so the second
pass over the documents shuffles those lines only.

Null texts stay null and empty ones empty; rows of a null id keep their text.
Rows of a repeated id are one document for the order of lines: a line number
that goes, goes in each of them. Further columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semweave.llm.blocks import block_pairs, cut_into_blocks
from semweave.llm.common import as_batch, map_batches, map_runs
from semweave.session import drop_materialized, materialize

TAU = 2
MIN_CHARS = 30
SPACE = " \t\n\x0b\x0c\r"
#: Bits of the bitmap of lines that need their text: 4 MB, whatever the input.
BITMAP_BITS = 1 << 25


def line_rows(text: str | None, min_chars: int):
    """``(number, stripped line)`` of the lines that count."""
    for k, line in enumerate((text or "").split("\n")):
        line = line.strip(SPACE)
        if len(line) >= min_chars:
            yield k, line


def cuts(length: int, tau: int = TAU) -> list[tuple[int, int]]:
    """Even segments of a line as (start, size); the longer ones last."""
    parts = tau + 1
    size, more = divmod(length, parts)
    out, at = [], 0
    for k in range(parts):
        n = size + (k >= parts - more)
        out.append((at, n))
        at += n
    return out


def probes(length: int, tau: int = TAU) -> list[tuple[int, int, int, int, int]]:
    """``(indexed length, segment, start, end, role)`` of a line's rows; role 0: its own segment, 1: a probe only."""
    out = []
    for other in range(length, max(length - tau, tau + 1) - 1, -1):
        delta = length - other
        for i, (p, size) in enumerate(cuts(other, tau)):
            low = max(0, p - i, p + delta - (tau - i))
            high = min(length - size, p + i, p + delta + (tau - i))
            out += [(other, i, at, at + size, int(delta > 0 or at != p)) for at in range(low, high + 1)]
    return out


def within(a: str, b: str, tau: int = TAU) -> bool:
    """Whether two strings are at most ``tau`` edits apart (banded bit-parallel after cutting common ends)."""
    if abs(len(a) - len(b)) > tau:
        return False
    if len(a) > len(b):
        a, b = b, a
    lo, n = 0, len(a)
    step = 64
    while lo < n and step:  # common start, in strides
        if a[lo:lo + step] == b[lo:lo + step] and lo + step <= n:
            lo += step
        else:
            step //= 2
    x, y = len(a), len(b)
    step = 64
    while step:  # common end
        if x - step >= lo and a[x - step:x] == b[y - step:y]:
            x, y = x - step, y - step
        else:
            step //= 2
    a, b = a[lo:x], b[lo:y]
    m, n = len(a), len(b)
    if m == 0 or n <= tau:
        return n <= tau
    # reach[e]: the diagonals that e edits reach, as bits of a band (bit d: diagonal d - tau)
    full = (1 << 2 * tau + 1) - 1
    reach = [1 << tau]
    for _ in range(tau):  # insertions before the first character
        reach.append(reach[-1] | (reach[-1] << 1) & full)
    for j in range(m):
        same = 0
        for k in range(max(0, j - tau), min(n, j + tau + 1)):
            if b[k] == a[j]:
                same |= 1 << k - j + tau
        now = [reach[0] & same]
        for e in range(1, tau + 1):  # match, substitution, deletion, insertion
            now.append(((reach[e] & same) | reach[e - 1] | reach[e - 1] >> 1 | now[e - 1] << 1) & full)
        reach = now
        if not reach[tau]:
            return False
    return bool(reach[tau] >> n - m + tau & 1)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(h, g, doc, line)``: two hashes and the place of every line that counts."""
    schema = pa.schema([(c, pa.int64()) for c in ("h", "g", "doc", "line")])

    def find(b: pa.RecordBatch) -> pa.RecordBatch:
        h, g, doc, line = [], [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for k, x in line_rows(t, min_chars):
                d = xxhash.xxh3_128_digest(x.encode())
                h.append(d[:8])
                g.append(d[8:])
                doc.append(i)
                line.append(k)
        return as_batch({"h": np.frombuffer(b"".join(h), np.int64), "g": np.frombuffer(b"".join(g), np.int64),
                         "doc": doc, "line": line}, schema)

    return map_batches(docs, find, "h long, g long, doc long, line long")


def _name(x: str) -> int:
    return int.from_bytes(xxhash.xxh3_128_digest(x.encode())[:8], "little", signed=True)


def _signatures(docs: DataFrame, min_chars: int, tau: int) -> DataFrame:
    """``(key, n, id)``: segments (n = 0) and probes (n = 1) of the distinct lines of a task."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("id", pa.int64())])
    plans: dict[int, list] = {}
    seen: set[int] = set()

    def sign(b: pa.RecordBatch) -> pa.RecordBatch:
        keys, roles, ids = [], [], []
        digest = xxhash.xxh64_intdigest
        for t in b.column(1).to_pylist():
            for _, x in line_rows(t, min_chars):
                h = _name(x)
                if h in seen:
                    continue
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(h)
                n = len(x)
                plan = plans.get(n)
                if plan is None:
                    if len(plans) >= 5_000:
                        plans.clear()
                    plan = plans[n] = [(4 * s, 4 * e, other * 8 + i, role) for other, i, s, e, role in probes(n, tau)]
                wide = x.encode("utf-32-le")
                for s, e, seed, role in plan:
                    keys.append(digest(wide[s:e], seed))
                    roles.append(role)
                ids += [h] * len(plan)
        return as_batch({"key": np.array(keys, np.uint64).view(np.int64), "n": roles, "id": ids}, schema)

    return map_batches(docs, sign, "key long, n long, id long")


def _bitmap(ids: DataFrame, bits: int) -> bytearray:
    """Bitmap of ids; its size is fixed, so it can go to every task."""
    at = F.pmod(F.col("id"), F.lit(bits)) + F.lit(1)
    rows = ids.select(at.alias("at")).select(F.expr("bitmap_bucket_number(at)").alias("b"),
                                             F.expr("bitmap_bit_position(at)").alias("p"))
    out = bytearray(bits // 8 + 4096)
    for r in rows.groupBy("b").agg(F.expr("bitmap_construct_agg(p)").alias("m")).collect():
        out[(r["b"] - 1) * 4096:r["b"] * 4096] = r["m"]
    return out


def _texts(docs: DataFrame, ids: DataFrame, min_chars: int) -> DataFrame:
    """``(id, text, doc, line)`` of the named lines: text and first place."""
    bits = BITMAP_BITS
    shared = docs.sparkSession.sparkContext.broadcast(bytes(_bitmap(ids, bits)))
    schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("doc", pa.int64()), ("line", pa.int64())])

    def find(b: pa.RecordBatch) -> pa.RecordBatch:
        bitmap, rows = shared.value, []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for k, x in line_rows(t, min_chars):
                h = _name(x)
                p = h % bits
                if bitmap[p >> 3] >> (p & 7) & 1:
                    rows.append((h, x, i, k))
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return as_batch(dict(zip(schema.names, cols, strict=True)), schema)

    found = map_batches(docs, find, "id long, text string, doc long, line long")
    first = F.struct("doc", "line")
    return (found.join(ids, "id", "left_semi").groupBy("id")
            .agg(F.min_by("text", first).alias("text"), F.min(first).alias("first"))
            .select("id", "text", F.col("first.doc").alias("doc"), F.col("first.line").alias("line")))


def _near(rows: DataFrame, texts: DataFrame, tau: int) -> DataFrame:
    """Ids of lines that have an earlier line within ``tau`` edits."""
    schema = pa.schema([("id", pa.int64())])

    def confirm(tbl: pa.Table, starts: np.ndarray):
        out: list[int] = []
        col = {c: tbl.column(c).to_pylist() for c in ("block", "b1", "b2", "id", "text", "doc", "line")}
        gone: set[int] = set()
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            b1, b2 = col["b1"][lo], col["b2"][lo]
            left = [k for k in range(lo, hi) if col["block"][k] == b1]
            right = left if b1 == b2 else [k for k in range(lo, hi) if col["block"][k] == b2]
            for k in left:
                x, place = col["text"][k], (col["doc"][k], col["line"][k])
                for m in right:
                    if m == k or col["id"][m] == col["id"][k]:
                        continue
                    first = place < (col["doc"][m], col["line"][m])
                    if b1 == b2 and not first:
                        continue
                    late = col["id"][m] if first else col["id"][k]
                    if late not in gone and within(x, col["text"][m], tau):
                        gone.add(late)
                        out.append(late)
            if len(gone) > 200_000:
                gone.clear()
        if out:
            yield as_batch({"id": out}, schema)

    joined = rows.join(texts, "id")
    return map_runs(joined.select("key", "part", "b1", "b2", "block", "id", "text", "doc", "line"),
                    ["key", "part", "b1", "b2"], confirm, "id long").distinct()


def dropped_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                  text_col: str = "text", exact_chars: int | None = None) -> DataFrame:
    """``(doc, line, near)``: the lines that go; near: for an earlier line that differs a little."""
    own = (docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
           .where("doc is not null and text is not null"))
    lines = materialize(_lines(own, min_chars if exact_chars is None else exact_chars), "ld_lines")
    rows = materialize(cut_into_blocks(_signatures(own, min_chars, tau)), "ld_rows")
    texts = _texts(own, rows.select("id").distinct(), min_chars)
    near = materialize(_near(block_pairs(rows), texts, tau), "ld_near")
    first = F.min(F.struct("doc", "line"))
    several = (lines.groupBy("h", "g").agg(first.alias("first"), F.count(F.lit(1)).alias("c"))
               .join(near.withColumnRenamed("id", "h").withColumn("near", F.lit(True)), "h", "left")
               .where("c > 1 or near").select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near")))
    out = (lines.join(several, ["h", "g"])
           .where("near or first <> struct(doc, line)").select("doc", "line", "near"))
    out = materialize(out, "ld_drop")
    for t in (rows, near, lines):
        drop_materialized(t)
    return out


def line_dedup(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
               text_col: str = "text", exact_chars: int | None = None) -> DataFrame:
    """``docs`` with shortened texts and the columns ``_sw_lines``, ``_sw_repeats``, ``_sw_near`` (lines, lines gone)."""
    gone = dropped_lines(docs, tau, min_chars, id_col, text_col, exact_chars)
    per_doc = gone.groupBy("doc").agg(F.collect_set("line").alias("_sw_gone"),
                                      F.count_if("near").alias("_sw_near")).withColumnRenamed("doc", "_sw_doc")
    j = docs.join(per_doc, docs[id_col].cast("long") == per_doc["_sw_doc"], "left")
    parts = F.split(F.col(text_col), "\n", -1)
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("_sw_gone", i.cast("long"))), "\n")
    j = (j.withColumn("_sw_lines", F.coalesce(F.size(parts), F.lit(0)).cast("long"))
         .withColumn("_sw_near", F.coalesce("_sw_near", F.lit(0)).cast("long"))
         .withColumn("_sw_repeats", F.coalesce(F.size("_sw_gone"), F.lit(0)).cast("long") - F.col("_sw_near"))
         .withColumn(text_col, F.when(F.col("_sw_gone").isNull(), F.col(text_col)).otherwise(left)))
    return j.drop("_sw_doc", "_sw_gone")
