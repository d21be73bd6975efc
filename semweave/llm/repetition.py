"""Quality rules from repeated substrings: suffix array, LCP intervals, maximal repeats.

The words of a document form a sequence; prefix doubling gives its suffix
array together with the class of every 2^k-word window. Neighbouring
suffixes get their longest common prefix (LCP) by lifting through the
stored classes; the LCP intervals of at least ``min_words`` words that are
not always preceded by the same word are the maximal repeated substrings.
The union of their spans and the longest of them decide: a document is
rejected if repeats cover more than ``max_covered`` of its words or one
repeat is longer than ``max_repeat`` words (the base rules apply first).

Many documents share one array (classes never cross documents), so short
texts cost little; the work of one text is O(n log n) in its words.

Null or empty texts have no words and fail the base rule. Every row is
judged alone: ties, repeated rows and further columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semweave.llm.common import WordHash, as_batch, map_batches, raw

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 12
MAX_COVERED = 0.25
MAX_REPEAT = 100
WORDS_AT_ONCE = 150_000


def classes(words: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per level k the class (rank) of the 2^k-word window at each position; positions in suffix order.

    ``ends[i]`` is the end of the document of position i. Ranks are starts of
    the class in suffix order, so equal ranks mean equal windows; windows that
    run over the end are in a class of their own.
    """
    n = len(words)
    order = np.lexsort((words, doc))
    new = np.ones(n, bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [rank], 1
    while True:
        alone = np.bincount(rank, minlength=n)[rank] == 1
        active = np.flatnonzero(~alone)
        if not len(active):
            break
        ahead = active + step
        follow = np.where(ahead < ends[active], rank[np.minimum(ahead, n - 1)], -1)
        by = np.lexsort((follow, rank[active]))
        pos, r, f = active[by], rank[active][by], follow[by]
        at = np.arange(len(pos))
        group = np.ones(len(pos), bool)
        group[1:] = r[1:] != r[:-1]
        inner = group.copy()
        inner[1:] |= f[1:] != f[:-1]
        start = np.maximum.accumulate(np.where(group, at, 0))
        sub = np.maximum.accumulate(np.where(inner, at, 0))
        rank = rank.copy()
        rank[pos] = r + (sub - start)
        levels.append(rank)
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return levels, suffixes


def common_prefixes(levels: list[np.ndarray], suffixes: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """LCP of each suffix with the one before it in suffix order; 0 where it is below ``least`` words."""
    n = len(suffixes)
    lcp = np.zeros(n, np.int64)
    k0 = min(int(least).bit_length() - 1, len(levels) - 1)
    a, b = suffixes[:-1], suffixes[1:]
    some = np.flatnonzero(levels[k0][a] == levels[k0][b])
    a, b, got = a[some], b[some], np.zeros(len(some), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + got, b + got
        inside = (x < ends[a]) & (y < ends[b])
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        got[same] += 1 << k
    lcp[some + 1] = np.where(got >= least, got, 0)
    return lcp


def maximal_repeats(words: np.ndarray, suffixes: np.ndarray, lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """``(length, first, last)`` in suffix order of the LCP intervals of one document that are maximal to the left too."""
    out: list[tuple[int, int, int]] = []
    edges = np.flatnonzero(lcp)
    if not len(edges):
        return out
    for block in np.split(edges, np.flatnonzero(np.diff(edges) > 1) + 1):
        stack: list[tuple[int, int]] = []  # (length, left end)
        for at in [*block.tolist(), None]:
            h, left = (int(lcp[at]), at - 1) if at is not None else (0, 0)
            while stack and stack[-1][0] > h:
                length, first = stack.pop()
                last = at - 1 if at is not None else int(block[-1])
                where = suffixes[first:last + 1]
                if where.min() == 0 or len(np.unique(words[where - 1])) > 1:
                    out.append((length, first, last))
                left = first
            if h and (not stack or stack[-1][0] < h):
                stack.append((h, left))
    return out


def spans(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + lengths, -1)
    return np.cumsum(d[:-1]) > 0


def measure(word_lists: list[np.ndarray], min_words: int = MIN_WORDS) -> dict[str, np.ndarray]:
    """Per document: words in repeated 8-word windows, words covered by maximal repeats, the longest one."""
    sizes = np.array([len(w) for w in word_lists], np.int64)
    out = {k: np.zeros(len(sizes), np.int64) for k in ("n_repeat_words", "n_covered", "longest_repeat")}
    n = int(sizes.sum())
    if not n:
        return out
    words = np.concatenate(word_lists)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    levels, suffixes = classes(words, doc, ends)
    k = WINDOW.bit_length() - 1
    if len(levels) > k:
        often = np.bincount(levels[k], minlength=n)[levels[k]] > 1
        hit = spans(n, np.flatnonzero(often), WINDOW)
        out["n_repeat_words"] = np.bincount(doc, hit, len(sizes)).astype(np.int64)
        lcp = common_prefixes(levels, suffixes, ends, min_words)
        # the deepest LCP interval of a suffix: every maximal repeat's span is a union of these
        deepest = np.maximum(lcp, np.append(lcp[1:], 0))
        starts = suffixes[deepest > 0]
        if len(starts):
            covered = spans(n, starts, deepest[deepest > 0])
            out["n_covered"] = np.bincount(doc, covered, len(sizes)).astype(np.int64)
            np.maximum.at(out["longest_repeat"], doc[starts], deepest[deepest > 0])
    return out


def quality_rules(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED,
                  max_repeat: int = MAX_REPEAT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, repetition measures and the verdict ``kept`` per row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]
    schema = pa.schema([("id", pa.int64())] + [(c, pa.int64()) for c in names])
    hashes = WordHash()

    def judge(b: pa.RecordBatch) -> pa.RecordBatch:
        got = {c: [] for c in names}
        waiting: list[np.ndarray] = []

        def flush():
            for c, v in measure(waiting, min_words).items():
                got[c].extend({"n_covered": v, "longest_repeat": v, "n_repeat_words": v}[c].tolist())
            waiting.clear()

        for t in raw(b.column(1)):
            t = t or b""
            words = t.split()
            lines = [x for x in t.split(b"\n") if x.strip()]
            solid = b"".join(words)
            got["n_words"].append(len(words))
            got["word_chars"].append(len(solid.decode("utf-8", "replace")))
            got["n_symbols"].append(sum(t.count(bytes([c])) for c in SYMBOLS))
            got["n_dup_lines"].append(len(lines) - len(set(lines)))
            waiting.append(hashes.of(words))
            if sum(map(len, waiting)) > WORDS_AT_ONCE:
                flush()
        flush()
        return as_batch({"id": b.column(0), **got}, schema)

    out = map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), judge,
                      "id long, " + ", ".join(f"{c} long" for c in names))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    bad = (F.col("n_covered") > max_covered * F.col("n_words")) | (F.col("longest_repeat") > max_repeat)
    return (out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~bad)
            .withColumnRenamed("id", id_col))


def repeated_substrings(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """``(id, length, occurrences, first_word)`` of every maximal repeated substring of each document."""
    schema = pa.schema([("id", pa.int64()), ("length", pa.int64()), ("occurrences", pa.int64()),
                        ("first_word", pa.int64())])
    hashes = WordHash()

    def find(b: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for i, t in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
            w = hashes.of((t or b"").split())
            if len(w):
                levels, suffixes = classes(w, np.zeros(len(w), np.int64), np.full(len(w), len(w)))
                lcp = common_prefixes(levels, suffixes, np.full(len(w), len(w)), min_words)
                rows += [(i, n, last - first + 1, int(suffixes[first:last + 1].min()))
                         for n, first, last in maximal_repeats(w, suffixes, lcp)]
        return as_batch(dict(zip(schema.names, zip(*rows, strict=True), strict=True)) if rows
                        else {c: [] for c in schema.names}, schema)

    out = map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), find,
                      "id long, length long, occurrences long, first_word long")
    return out.withColumnRenamed("id", id_col)
