"""Token counts by prefix dynamic programming (piece vocabulary with byte fallback).

A text is cut before every run of word marks and around line breaks; no piece
of the vocabulary holds a mark after another character, or a line break
(checked when the model is loaded), so merges never cross a cut and segments
are independent. Inside a segment the
token that ends at position ``j`` is unique: it is the only piece ``t`` such
that ``t`` is its own encoding and the pair (token ending where ``t`` starts,
``t``) is left alone by the merges. One pass therefore gives the exact token
count of *every* prefix; segment tables are remembered per worker, so the
text is never encoded again to answer a truncation or budget question.

Null or empty texts have 0 tokens. Control strings inside a text are plain
characters, as in the library's default. Rows are handled one by one: ties,
repeated rows and further columns play no part.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semweave.llm.common import as_batch, map_batches

MARK = "▁"
LIMIT = 4096
REMEMBERED = 600_000  # segments of a generation; two are kept
SEGMENT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


class PrefixCounter:
    """Exact token counts of all prefixes of segments and texts for one model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score: dict[str, float] = {}
        for k in range(model.get_piece_size()):
            if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)):
                self.score[model.id_to_piece(k)] = model.get_score(k)
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score):
            raise ValueError("a piece spans a word mark: segments would not be independent")
        self.longest = max(map(len, self.score))
        if any("\n" in p for p in self.score):
            raise ValueError("a piece holds a line break: segments would not be independent")
        self.ends: dict[str, bool] = {}  # ends of pieces; True: a whole piece that is its own encoding
        self.pairs: dict[tuple[str, str], bool] = {}
        self.tables: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        for p in self.score:
            for k in range(1, len(p)):
                self.ends.setdefault(p[k:], False)
            self.ends[p] = self.stays("", p)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short string by merging the best adjacent pair, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def stays(self, left: str, right: str) -> bool:
        """Whether the merges leave exactly these two tokens (an empty left: the right one alone)."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self.merged(left + right) == ([left, right] if left else [right])
            if len(self.pairs) >= 4 * REMEMBERED:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def segment(self, seg: str) -> bytes | list[int]:
        """Token counts of the prefixes of length 1, 2, ... of a segment.

        A remembered segment carries the length of the last token at every
        prefix as well, so a longer segment that starts with it goes on
        from there.
        """
        n = len(seg)
        found = self.tables.get(seg)
        if found is None and (found := self.older.get(seg)) is not None:
            self.remember(seg, found)
        if found is not None:
            return found[:n]
        get, pairs, stays, tables = self.ends.get, self.pairs, self.stays, self.tables
        last, count, size, at = [""] * (n + 1), [0] * (n + 1), [0] * (n + 1), 0
        for k in range(n - 1, max(n - 10, 1), -1):
            known = tables.get(seg[:k])
            if known is not None:
                count[1:k + 1], size[1:k + 1] = known[:k], known[k:]
                for j in range(max(1, k - self.longest), k + 1):
                    last[j] = seg[j - size[j]:j]
                at = k
                break
        for j in range(at + 1, n + 1):
            i, t, ending = j - 1, seg[j - 1], []
            whole = get(t)
            while whole is not None:
                if whole:
                    ending.append(t)
                if i == 0:
                    break
                i -= 1
                t = seg[i:j]
                whole = get(t)
            if not ending:  # a character without a piece: spelled in bytes, never merged
                count[j] = count[j - 1] + len(seg[j - 1].encode())
            for t in reversed(ending):
                i = j - len(t)
                before = last[i]
                if not before:
                    ok = True
                else:
                    ok = pairs.get((before, t))
                    if ok is None:
                        ok = stays(before, t)
                if ok:
                    last[j], count[j], size[j] = t, count[i] + 1, j - i
                    break
        del count[0], size[0]
        if n <= 48:
            self.remember(seg, bytes(count + size))
        return count

    def remember(self, seg: str, table: bytes) -> None:
        """Keep a segment; beyond ``REMEMBERED`` new ones the generation before goes."""
        if len(self.tables) >= REMEMBERED:
            self.tables, self.older = {}, self.tables
        self.tables[seg] = table

    def segments(self, text: str) -> list[str]:
        return SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []

    def count(self, text: str) -> int:
        total, get, segment = 0, self.tables.get, self.segment
        for s in self.segments(text):
            t = get(s)
            if t is not None:
                total += t[len(s) - 1]
            else:
                total += segment(s)[-1]
                get = self.tables.get
        return total

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of text[:0], text[:1], ..., text (int32)."""
        out, at, base = np.zeros(len(text) + 2, np.int32), 1, 0
        for s in self.segments(text):
            t = self.segment(s)
            out[at:at + len(t)] = np.frombuffer(t, np.uint8) if isinstance(t, bytes) else t
            out[at:at + len(t)] += base
            at, base = at + len(t), base + t[-1]
        out = out[1:]
        out[0] = 0  # the empty prefix has no mark either
        return out

    def longest_prefix(self, text: str, limit: int) -> int:
        """Code points of the longest prefix with at most ``limit`` tokens."""
        return int(np.flatnonzero(self.prefixes(text) <= limit)[-1])


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(model_file: str) -> PrefixCounter:
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = PrefixCounter(model_file)
    return _COUNTERS[model_file]


def token_counts(docs: DataFrame, model_file: str, limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit, fit_chars)`` per row.

    ``fit_chars``: code points of the longest prefix that fits in ``limit``
    tokens (the whole text where it is not over the limit).
    """
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                        ("over_limit", pa.bool_()), ("fit_chars", pa.int64())])

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(model_file)
        texts = [t or "" for t in b.column(1).to_pylist()]
        n = [c.count(t) for t in texts]
        return as_batch({"id": b.column(0), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n,
                         "over_limit": [k > limit for k in n],
                         "fit_chars": [c.longest_prefix(t, limit) if k > limit else len(t)
                                       for t, k in zip(texts, n, strict=True)]}, schema)

    out = map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), count,
                      "id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
    return out.withColumnRenamed("id", id_col)


def prefix_table(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, counts array<int>)``: the token count of every prefix, from the empty one to the whole text.

    Stored once, it answers ``counts[p]`` (tokens of the first p code
    points), truncation (last p with counts[p] <= budget) and budget splits
    without the tokenizer.
    """
    schema = pa.schema([("id", pa.int64()), ("counts", pa.list_(pa.int32()))])

    def store(b: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(model_file)
        return as_batch({"id": b.column(0), "counts": [c.prefixes(t or "") for t in b.column(1).to_pylist()]}, schema)

    out = map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), store,
                      "id long, counts array<int>")
    return out.withColumnRenamed("id", id_col)


def truncate(prefixes: DataFrame, budget: int) -> DataFrame:
    """Add ``fit_chars``: the longest stored prefix within ``budget`` tokens."""
    fits = F.transform("counts", lambda c, i: F.when(c <= budget, i).otherwise(F.lit(-1)))
    return prefixes.withColumn("fit_chars", F.array_max(fits).cast("long"))
