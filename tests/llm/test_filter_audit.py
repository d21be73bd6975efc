"""Filter audit: interval ranks, brute force over documents and orders, edge cases."""

import re
from collections import defaultdict
from itertools import permutations
from math import factorial

from pyspark.sql import functions as F

from semweave.llm import filter_audit as A

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def test_lehmer_ranks_number_the_permutations():
    for k, p in enumerate(permutations("ABCDE")):
        assert A.lehmer_rank("".join(p)) == k
        assert A.lehmer_rank("".join(p[:2])) == k - k % factorial(3)


def test_intervals_name_every_fall_once():
    falls = defaultdict(list)
    for mask, step, letter, a, b in A.intervals():
        for r in range(a, b):
            falls[mask, r].append((step, letter))
    for r, p in enumerate(permutations("ABCDE")):
        for mask in range(1, 32):
            k = next(k for k, c in enumerate(p) if mask >> "ABCDE".index(c) & 1)
            assert falls[mask, r] == [(k + 1, p[k])]
    assert len(A.intervals()) == 840


def brute(docs, labels):
    """Each document through each order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, src in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w))
        f += "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        fails.append((src or "", f + "E" * (i is not None and i > first[t]), i in good, i in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        own, shapley, rows = [f for f in fails if f[0] == part], defaultdict(int), []
        for p in permutations("ABCDE"):
            left = own
            for k, c in enumerate(p):
                gone = [f for f in left if c in f[1]]
                left = [f for f in left if c not in f[1]]
                shapley[c] += len(gone)
                rows.append(("".join(p), k + 1, c, len(left), len(gone), sum(c in f[1] for f in own) - len(gone),
                             sum(f[1] == c for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)))
        out |= {(part, o, s): (*v, shapley[c]) for o, s, c, *v in rows}
    return out


def audited(docs, labels):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names)
            for r in A.filter_audit(docs, labels).collect()}


LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(40_000))
ROWS = [(1, "word " * 60, "a"), (2, "word " * 60, "b"), (3, LONG, "a"), (4, LONG, "a"), (5, None, None), (6, "", ""),
        (7, "ABC def # " * 30, "a"), (7, "ABC def # " * 30, "a"), (8, "ABC def # " * 30, "c"), (None, LONG, "a"),
        (None, LONG, "a"), (9, "\u00a0x\u2003y z\x0bq\x1f", "c"), (10, " ".join(f"w{k}" for k in range(80)), "c"),
        (11, "UPPER " + " ".join(f"w{k}" for k in range(80)), "c"), (7, "another text under a used id", "a")]
MARKS = [(3, 1, 0), (4, 1, 1), (4, 0, 0), (5, None, 1), (7, 1, None), (8, 0, 1), (None, 1, 1), (99, 1, 1)]


def test_equals_brute_force(spark):
    docs, labels = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(MARKS, LABELS)
    want = brute(ROWS, MARKS)
    assert len(want) == 4 * 600
    assert audited(docs, labels) == want
    clash = docs.select("*", *[F.lit("clash").alias(c) for c in ("part", "mask", "key", "n", "quality", "step", "rank", "id")])
    assert audited(clash, labels) == want


def test_a_hot_text_and_no_labels(spark):
    rows = [(k, "the same text " * 20 if k % 3 else f"text {k}", f"s{k % 2}") for k in range(900)]
    docs = spark.createDataFrame(rows, DOCS).repartition(9)
    assert audited(docs, spark.createDataFrame([], LABELS)) == brute(rows, [])


def test_empty(spark):
    assert A.filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame(MARKS, LABELS)).count() == 0
