"""Quality classifier: Bradley-Terry ranking from preference pairs, a calibrated score, a quantile threshold.

Every text gives a short feature vector (shares of symbols, capitals,
repeats, line shapes; nothing but the text enters). Labelled training rows
are dealt into blocks of about ``PAIR_BLOCK`` documents; in a block every
(good, bad) pair is a preference, and the loss of a pair is
log(1 + exp(-w . (x_good - x_bad))). Newton steps minimise the sum over all
blocks: each step is one Spark job that adds up the gradient and a matrix of
features x features on the executors, so all labelled rows take part and none
leaves them. The rank score w . x is turned
into a probability by a two-parameter logistic fit on the same rows.

A null or empty text has the feature vector of no words and gets a score as
any other. Without both labels in the training rows the weights are 0 and the
score is the share of label 1 (0.5 without labels). A document with several
label rows counts with its largest label; null labels are left out. Rows of a
repeated id are scored one by one. Further columns play no part.
"""

from __future__ import annotations

import math
import operator
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semweave.llm.common import as_batch, crc_mod, map_batches, sum_over_partitions
from semweave.session import drop_materialized, materialize

PAIR_BLOCK = 512
PENALTY = 1e-3
STEPS = 12
NAMES = ["words", "symbols", "symbols_root", "pipes", "pipes_root", "bangs", "bangs_root", "capitals",
         "distinct", "next_same", "next_same_root", "top_word", "word_length", "digits", "odd_ends",
         "short_lines", "same_lines", "lines", "distinct_pairs", "few_words"]


def features(text: str | None) -> list[float]:
    """Shares that describe a text; all near 0 to 1."""
    t = text or ""
    words = t.split()
    n = len(words)
    if not n:
        return [0.0] * (len(NAMES) - 1) + [1.0]
    chars = max(1, len(t))
    symbols = sum(map(t.count, "#*$%&<>~^=_")) / n
    pipes, bangs = t.count("|") / n, t.count("!") / n
    capitals = sum(map(str.isupper, words)) / n
    counts = Counter(words)
    same = sum(map(operator.eq, words, words[1:])) / n
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)
    lines = [x.strip() for x in t.split("\n") if x.strip()]
    m = len(lines)
    odd = sum(not (w[-1].isalnum() or w[-1] in ".,;:?!'\")") for w in words) / n
    return [math.log1p(n) / 10, min(symbols, 4) / 4, min(1, math.sqrt(symbols)), min(pipes, 1),
            min(1, math.sqrt(pipes)), min(bangs, 3) / 3, min(1, math.sqrt(bangs)), capitals, len(counts) / n, same,
            math.sqrt(same), max(counts.values()) / n, min(2.0, sum(map(len, words)) / n / 10),
            sum(map(t.count, "0123456789")) / chars, odd,
            sum(len(x.split(None, 3)) < 3 for x in lines) / max(1, m), 1 - len(set(lines)) / max(1, m),
            min(1.0, 10 * m / n), pairs, 1.0 if n < 10 else 0.0]


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, x array<double>)`` per row."""
    schema = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        return as_batch({"id": b.column(0), "x": [features(t) for t in b.column(1).to_pylist()]}, schema)

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), make,
                       "id long, x array<double>")


def pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and second derivatives of all (good, bad) pairs of a block."""
    margin = (good @ w)[:, None] - (bad @ w)[None, :]
    loss = np.logaddexp(0, -margin).sum()
    p = 1 / (1 + np.exp(np.clip(margin, -500, 500)))  # chance of the wrong order
    h = p * (1 - p)
    grad = bad.T @ p.sum(0) - good.T @ p.sum(1)
    cross = good.T @ h @ bad
    second = (good.T * h.sum(1)) @ good + (bad.T * h.sum(0)) @ bad - cross - cross.T
    return float(loss), grad, second


def _sums(blocks: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
    """The same over all blocks, and the number of pairs."""
    d = len(w)

    def add(total: np.ndarray, b: pa.RecordBatch) -> None:
        for ys, xs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            y, x = np.array(ys), np.array(xs, float)
            good, bad = x[y == 1], x[y == 0]
            if len(good) and len(bad):
                loss, grad, second = pair_sums(good, bad, w)
                total += np.concatenate([[loss, len(good) * len(bad)], grad, second.ravel()])

    total = sum_over_partitions(blocks, 2 + d + d * d, add)
    return float(total[0]), total[2:2 + d], total[2 + d:].reshape(d, d), float(total[1])


def fit(train: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the standardised features of ``train(id, x, y)``, and their means and deviations."""
    d = len(NAMES)
    each = [F.col("x")[k] for k in range(d)]
    head = train.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in each]).alias("m"),
                     F.array(*[F.stddev_pop(c) for c in each]).alias("s")).first()
    if not head["n"]:
        return np.zeros(d), np.zeros(d), np.ones(d)
    mean = np.array(head["m"], float)
    dev = np.array(head["s"], float)
    dev[dev < 1e-6] = 1.0
    count = max(1, head["n"] // PAIR_BLOCK)
    scaled = F.transform("x", lambda v, i: (v - F.element_at(F.lit(mean.tolist()), i + 1))
                         / F.element_at(F.lit(dev.tolist()), i + 1))
    blocks = materialize(train.select(F.pmod(F.xxhash64("id"), F.lit(count)).alias("b"), "y", scaled.alias("x"))
                         .groupBy("b").agg(F.collect_list("y").alias("y"), F.collect_list("x").alias("x"))
                         .select("y", "x"), "bt_blocks")
    w = np.zeros(d)
    for _ in range(STEPS):
        _, grad, second, pairs = _sums(blocks, w)
        if not pairs:
            break
        g = grad / pairs + PENALTY * w
        step = np.linalg.solve(second / pairs + PENALTY * np.eye(d), g)
        w = w - step * min(1.0, 3.0 / (1e-12 + np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    drop_materialized(blocks)
    return w, mean, dev


def calibrate(ranked: DataFrame) -> tuple[float, float]:
    """a, b of sigmoid(a * rank + b) for ``ranked(rank, y)`` by Newton steps on aggregated sums."""
    n = ranked.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m")).first()
    if not n["n"]:
        return 0.0, 0.0
    base = min(max(n["m"], 1e-3), 1 - 1e-3)
    a, b = 0.0, math.log(base / (1 - base))
    for _ in range(15):
        p = 1 / (1 + F.exp(-(F.lit(a) * F.col("rank") + F.lit(b))))
        t = ranked.select("rank", (p - F.col("y")).alias("g"), (p * (1 - p)).alias("h")).agg(
            F.sum(F.col("g") * F.col("rank")).alias("ga"), F.sum("g").alias("gb"),
            F.sum(F.col("h") * F.col("rank") * F.col("rank")).alias("haa"),
            F.sum(F.col("h") * F.col("rank")).alias("hab"), F.sum("h").alias("hbb")).first()
        g = np.array([t["ga"], t["gb"]]) / n["n"] + 1e-4 * np.array([a, 0.0])
        h = np.array([[t["haa"], t["hab"]], [t["hab"], t["hbb"]]]) / n["n"] + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / (1e-12 + np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-3:
            break
    return float(a), float(b)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, quantile: float = 0.1,
                   id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``(id, held_out, score, predicted, rank, above_quantile)`` per row.

    ``above_quantile``: the rank score is at least the ``quantile`` of all rank scores.
    """
    x = materialize(feature_table(docs, id_col, text_col), "bt_x")
    held = crc_mod(F.col("id"), 5) == 0
    known = (labels.select(F.col(id_col).cast("long").alias("_sw_id"), F.col(label_col).cast("int").alias("y"))
             .where("y is not null and _sw_id is not null").groupBy("_sw_id").agg(F.max("y").alias("y")))
    train = materialize(x.where(~held).join(known, x["id"] == known["_sw_id"]).select("id", "x", "y"), "bt_train")
    w, mean, dev = fit(train)
    rank = F.aggregate(F.zip_with("x", F.lit((w / dev).tolist()), lambda v, k: v * k), F.lit(0.0), lambda s, v: s + v)
    rank = rank - F.lit(float((w / dev) @ mean))
    ranked = materialize(train.select(rank.alias("rank"), "y"), "bt_rank")
    a, b = calibrate(ranked)
    drop_materialized(ranked)
    drop_materialized(train)
    scored = materialize(x.select("id", held.alias("held_out"), rank.alias("rank")), "bt_scored")
    drop_materialized(x)
    cut = scored.agg(F.percentile_approx("rank", quantile, 10_000).alias("c")).first()["c"]
    score = 1 / (1 + F.exp(-(F.lit(a) * F.col("rank") + F.lit(b))))
    return (scored.withColumn("score", score).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
            .withColumn("above_quantile", F.col("rank") >= F.lit(cut))
            .select(F.col("id").alias(id_col), "held_out", "score", "predicted", "rank", "above_quantile"))
