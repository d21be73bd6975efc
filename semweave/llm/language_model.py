"""LM scoring with a hierarchical Pitman-Yor model.

The model. A token is drawn in the restaurant of the word before it (or of the
start of the text): one restaurant for every word of the training texts. All of
them share one parent, the unigram restaurant, whose base is uniform over the
training vocabulary and one unknown word. A pair is a dish (a word) in a
context's restaurant, its customers are the pair's occurrences in training.

1. Pairs. The documents are cut into units of ``UNIT_ROWS`` consecutive rows of
   a file. A unit packs its distinct pairs by bucket of the pair (dish and a few
   bits of the context, so the pairs of a frequent word are many buckets) into
   byte columns: seven bytes a context and, once per run, seven a dish.
2. A bucket adds up its pairs over all units. A pair with one customer sits at
   one table whatever the sampler does, so only pairs with two and more become
   rows, with the units that ask for them; what the others add to restaurants
   follows from the words' counts.
3. Seating (``ROUNDS`` rounds of Gibbs over all workers): given the tables of
   all other dishes, as of the round before, the tables of a dish are drawn
   whole from their conditional distribution; the customers of the parent are
   the tables below, and its tables are drawn alike. Draws depend on (seed,
   round, pair) alone, never on partitions or batches.
4. Customers minus discounted tables, averaged over the ``DRAWS`` draws of the
   last round, are the numerators of the predictive probabilities; with the
   totals of the restaurants they sum to one in every context.
5. The numerators go back to the units that asked, texts are dealt out by unit,
   and log10 probabilities are added up. A unit knows by itself that a pair it
   saw once in training, without an answer, has one customer.

Perplexity of a text is 10 ** (-score / n_tokens). Words are known by 56 bits of
their hash.

Null and empty texts have one token, the end. A null id counts as the text
'null' for the split into training and held-out rows. Rows of a repeated id
count and are scored one by one; further columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semweave.llm.common import U64, WordHash, as_batch, crc_mod, fold, map_batches, mix, runs
from semweave.session import drop_materialized, materialize, shuffles_released

DISCOUNT, STRENGTH = 0.8, 5.0  # of the context restaurants
PARENT_DISCOUNT, PARENT_STRENGTH = 0.8, 100.0
ROUNDS, DRAWS = 3, 4
SEED = 7
#: Rows of a unit, tokens after which a task packs what it holds, text bytes of a bucket, context bits that spread a dish.
UNIT_ROWS, FLUSH, BUCKET_BYTES, SPREAD = 4000, 1_000_000, 3 << 20, 15
END = b"\n"  # no word has white space, so this names the end token
START = 0    # the context of a text's first token; no word has this hash
PAIR, WORD, ASK = 0, 1, 2
HASHED = "shuffle_hash"  # pairs meet the words of their partition without being sorted
BYTES = 7


def word_hash(word: bytes, seed: int = 0) -> int:
    """A word's 56-bit hash, never ``START``."""
    return (xxhash.xxh64_intdigest(word, seed) >> 8) or 1


class Words(WordHash):
    """word -> its hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = word_hash(word, self.seed)
        return h


END_HASH = word_hash(END)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct token hashes of texts, each token's place among them, and the number of tokens of each text.

    Texts are split and words numbered by Arrow; each distinct word of the texts is hashed once.
    """
    split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string(), safe=False))
    coded = split.flatten().cast(pa.large_binary()).dictionary_encode()
    code, ends = coded.indices.to_numpy(), np.cumsum(split.value_lengths().to_numpy())
    _, at, data = coded.dictionary.buffers()
    at, data = np.frombuffer(at, np.int64)[:len(coded.dictionary) + 1], data.to_pybytes() if data else b""
    cuts = at.tolist()
    found = np.fromiter((word_hash(data[a:z]) for a, z in zip(cuts, cuts[1:])), U64, len(coded.dictionary))
    full = (np.diff(at) > 0)[code]  # white space at an end of a text leaves an empty string, which is no word
    n = np.diff(np.append(0, np.append(0, np.cumsum(full))[ends])) + 1
    last = np.cumsum(n) - 1
    own = np.full(int(n.sum()), len(found))
    inner = np.ones(len(own), bool)
    inner[last] = False
    own[inner] = code[full]
    return np.append(found, U64(END_HASH)), own, n


def numbered(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of :func:`tokens` of several texts: sorted hashes, each token's ``word << 32 | word before + 1``, tokens of texts.

    The word before the first token of a text is the start, 0.
    """
    known, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    at = np.cumsum([0, *(len(p[0]) for p in parts)])
    code = np.concatenate([place[k:z][p[1]] for p, k, z in zip(parts, at[:-1], at[1:], strict=True)])
    n = np.concatenate([p[2] for p in parts])
    pair = np.append(0, code[:-1] + 1)
    pair[np.cumsum(n) - n] = 0
    pair += code << 32
    return known, pair, n


def stretches(texts: list[bytes], size: int = 1 << 20):
    """Starts and ends of runs of texts of about ``size`` bytes, so that many long ones are never split into words at once."""
    lo, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield lo, k + 1
            lo, held = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def pack(values: np.ndarray) -> bytes:
    """Seven bytes a hash."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(data, np.uint8).reshape(-1, BYTES)
    return out.view("<u8").ravel().astype(U64)


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(word) ^ context)


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text, held, unit)``; a unit is a run of rows of one file, the same in every pass."""
    place = "_metadata.file_path", "_metadata.row_index"
    try:
        own_files = "_metadata" not in docs.columns
        if own_files:
            docs.select(*place)
    except AnalysisException:
        own_files = False
    if not own_files:  # not the rows of Parquet files, or a column hides where they come from: make them so
        docs = materialize(docs.select(id_col, text_col), "lm_docs")
    unit = F.xxhash64(F.col(place[0]), F.floor(F.col(place[1]) / UNIT_ROWS))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       (crc_mod(F.col(id_col), 10) == 0).alias("held"), unit.alias("unit"))


BLOBS = "unit long, bucket long, words binary, runs binary, contexts binary, n binary"
BLOB_SCHEMA = pa.schema([("unit", pa.int64()), ("bucket", pa.int64()), ("words", pa.binary()), ("runs", pa.binary()),
                         ("contexts", pa.binary()), ("n", pa.binary())])


def _packed(own: DataFrame, buckets: int) -> DataFrame:
    """``BLOBS``: the distinct pairs of units by bucket, and (no contexts) the words of units by bucket of the word."""

    def blobs(unit: int, held: list):
        known, pair, size = numbered([x[:3] for x in held])
        n = np.repeat(np.concatenate([x[3] for x in held]).astype(np.int64), size)
        by = np.argsort(pair)
        pair, n = pair[by], n[by]
        at = runs([pair])[:-1]
        n = np.add.reduceat(n, at)
        word, context = known[pair[at] >> 32], np.append(U64(START), known)[pair[at] & 0xFFFFFFFF]
        bucket = (mix(word) % U64(buckets) + (mix(context) & U64(SPREAD)) * U64(0x9E3779B1)) % U64(buckets)
        by = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else U64), kind="stable")
        context, word, bucket, n = context[by], word[by], bucket[by], n[by]
        rows = {c: [] for c in BLOB_SCHEMA.names}

        def row(bucket_, words_, runs_, contexts_, n_):
            for c, x in zip(BLOB_SCHEMA.names, (unit, bucket_, words_, runs_, contexts_, n_), strict=True):
                rows[c].append(x)

        ends = runs([bucket])
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            first = runs([word[lo:hi]])
            row(int(bucket[lo]), pack(word[lo:hi][first[:-1]]), np.diff(first).astype(np.int32).tobytes(),
                pack(context[lo:hi]), n[lo:hi].astype(np.int32).tobytes())
        bucket = known % U64(buckets)
        by = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else U64), kind="stable")
        known, bucket = known[by], bucket[by]
        ends = runs([bucket])
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            row(int(bucket[lo]), pack(known[lo:hi]), b"", b"", b"")
        for k in range(0, len(rows["unit"]), 64):
            yield as_batch({c: x[k:k + 64] for c, x in rows.items()}, BLOB_SCHEMA)

    def run(batches):
        unit, held, size = None, [], 0
        for b in batches:
            units = b.column(3).to_numpy()
            texts, train = fold(b.column(1)), ~np.array(b.column(2).to_pylist(), bool)
            edges = np.flatnonzero(np.append(True, units[1:] != units[:-1])) if len(units) else []
            for lo, hi in zip(edges, np.append(edges[1:], len(units)), strict=True):
                if held and units[lo] != unit:
                    yield from blobs(unit, held)
                    held, size = [], 0
                unit = int(units[lo])
                for a, z in stretches(texts[lo:hi]):
                    a, z = a + lo, z + lo
                    held.append((*tokens(texts[a:z]), train[a:z]))
                    size += len(held[-1][1])
                    if size > FLUSH:
                        yield from blobs(unit, held)
                        held, size = [], 0
        if held:
            yield from blobs(unit, held)

    return own.mapInArrow(run, BLOBS)


PAIR_SCHEMA = pa.schema([("kind", pa.int8()), ("u", pa.int64()), ("w", pa.int64()), ("n", pa.int64()),
                         ("units", pa.list_(pa.int64())), ("words", pa.binary())])


def _added_up(blobs: DataFrame, buckets: int) -> DataFrame:
    """``(kind, u, w, n, units, words)``: pairs that need an answer and who asks, words with counts, and, still packed,
    the words of a bucket (``w``) that a unit (``u``) asks for.

    A pair with one customer is answered only to units that saw it in held-out rows.
    """

    def run(batches):
        rows = [tuple(x[c] for c in BLOB_SCHEMA.names) for b in batches for x in b.to_pylist()]
        parts = []
        asked = [(unit, bucket, words) for unit, bucket, words, _, contexts, _ in rows if not contexts]
        for k in range(0, len(asked), 64):
            unit, bucket, words = zip(*asked[k:k + 64], strict=True)
            no = [None] * len(unit)
            yield as_batch({"kind": [ASK] * len(unit), "u": unit, "w": bucket, "n": [0] * len(unit), "units": no,
                            "words": words}, PAIR_SCHEMA)
        for unit, _, words, size, contexts, n in rows:
            if not contexts:
                continue
            word, context = unpack(words), unpack(contexts)
            parts.append((np.repeat(word, np.frombuffer(size, np.int32)), context,
                          np.frombuffer(n, np.int32).astype(np.int64), np.full(len(context), unit)))
        if not parts:
            return
        word, context, n, unit = (np.concatenate(x) for x in zip(*parts, strict=True))
        del rows, parts, asked
        by = np.lexsort((unit, context, word))
        word, context, n, unit = word[by], context[by], n[by], unit[by]
        at = runs([word, context])
        total = np.add.reduceat(n, at[:-1])
        asks = np.repeat(total > 1, np.diff(at)) | (np.repeat(total, np.diff(at)) == 1) & (n == 0)
        again = np.zeros(len(asks), bool)
        again[1:] = (word[1:] == word[:-1]) & (context[1:] == context[:-1]) & (unit[1:] == unit[:-1]) & asks[:-1]
        asks &= ~again
        some = np.add.reduceat(asks, at[:-1])
        kept = np.flatnonzero(some)
        units, ends = unit[asks], np.append(0, np.cumsum(some[kept]))
        for k in range(0, len(kept), 50_000):
            z = min(k + 50_000, len(kept))
            first = at[kept[k:z]]
            lists = pa.ListArray.from_arrays(pa.array(ends[k:z + 1] - ends[k], pa.int32()), pa.array(units[ends[k]:ends[z]]))
            yield as_batch({"kind": np.full(z - k, PAIR), "u": context[first].view(np.int64),
                            "w": word[first].view(np.int64), "n": total[kept[k:z]], "units": lists,
                            "words": [None] * (z - k)}, PAIR_SCHEMA)
        at = runs([word])
        n, word = np.add.reduceat(n, at[:-1]), word[at[:-1]].view(np.int64)
        for k in range(0, len(word), 100_000):
            w = word[k:k + 100_000]
            yield as_batch({"kind": np.full(len(w), WORD), "u": np.zeros(len(w), np.int64), "w": w,
                            "n": n[k:k + 100_000], "units": [None] * len(w), "words": [None] * len(w)}, PAIR_SCHEMA)

    return blobs.repartition(buckets, "bucket").mapInArrow(
        run, "kind byte, u long, w long, n long, units array<long>, words binary")


# ------------------------------------------------------------------ seating

EXACT = 512
_STIRLING: dict[float, np.ndarray] = {}


def stirling(discount: float) -> np.ndarray:
    """log S(n, t), generalised Stirling numbers: S(n, t) = S(n - 1, t - 1) + (n - 1 - d t) S(n - 1, t)."""
    log = _STIRLING.get(discount)
    if log is None:
        log = np.full((EXACT + 1, EXACT + 1), -np.inf)
        log[0, 0] = 0.0
        k = np.arange(1, EXACT + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            for i in range(1, EXACT + 1):
                log[i, 1:] = np.logaddexp(log[i - 1, :-1], np.log(np.maximum(i - 1 - discount * k, 0)) + log[i - 1, 1:])
        _STIRLING[discount] = log
    return log


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Of numbers above 50 or so."""
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x ** 3)


def uniform(seed: int, *keys: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for every row of keys, the same wherever the row lies."""
    with np.errstate(over="ignore"):
        h = mix(np.full(len(keys[0]), seed, U64))
        for k in keys:
            h = mix(h ^ k.astype(np.int64).view(U64))
    return ((h >> U64(11)).astype(np.float64) + 0.5) / (1 << 53)


def draw_tables(n: np.ndarray, base: np.ndarray, strength: np.ndarray, discount: float, seed: int,
                keys: tuple[np.ndarray, ...], draws: int = 1) -> np.ndarray:
    """Mean over ``draws`` draws of the number of tables of dishes with n customers, given all other dishes.

    ``base``: the parent's probability of the dish; ``strength``: theta + d * tables of the restaurant without this
    dish. A seating of the dish's customers at t tables has weight prod_{j<t} base (strength + d j) times the weights
    of the customers that join tables; over all seatings with t tables the latter add up to S(n, t). So t is drawn
    from S(n, t) prod_{j<t} base (strength + d j), exactly up to ``EXACT`` customers. Of more, the first ``EXACT``
    are drawn so, weighted by what the later ones find (Gamma quotients, as if they all joined), and the tables that
    the later ones open are a Poisson number with the rates of that path.
    """
    n = np.rint(n).astype(np.int64)
    out = n.astype(np.float64)
    log = stirling(discount)
    some = np.flatnonzero(n > 1)
    some = some[np.argsort(n[some], kind="stable")]
    lo = 0
    while lo < len(some):
        width = min(int(n[some[lo]]), EXACT)
        hi = min(len(some), lo + max(1, 100_000 // max(16, 2 * width)))
        rows = some[lo:hi]
        rows = rows[:max(1, np.searchsorted(n[rows], max(16, 2 * width), "right"))]
        lo += len(rows)
        width = min(int(n[rows].max()), EXACT)
        t = np.arange(1, width + 1)
        rise = np.log(strength[rows, None] + discount * (t - 1)) + np.log(base[rows])[:, None]
        weight = log[np.minimum(n[rows], EXACT)][:, 1:width + 1] + np.cumsum(rise, 1)
        large = np.flatnonzero(n[rows] > EXACT)
        if len(large):
            a = (base[rows[large]] * strength[rows[large]])[:, None]
            seen, end = a + EXACT - discount * t, a + n[rows[large], None] - discount * t
            weight[large] += _log_gamma(end) - _log_gamma(seen)
        weight = np.exp(weight - weight.max(1, keepdims=True))
        chance = np.cumsum(weight, 1)
        chance /= chance[:, -1:]
        total = np.zeros(len(rows))
        for k in range(draws):
            x = uniform(seed * 1000 + k, *(key[rows] for key in keys))
            got = 1 + (x[:, None] > chance).sum(1)
            got = np.minimum(got, width).astype(np.float64)
            for i in large:
                m, b, s = int(n[rows[i]]), float(base[rows[i]]), float(strength[rows[i]])
                rate = b * (s + discount * got[i])
                late = 1 - ((rate + EXACT - discount * got[i]) / (rate + m - discount * got[i])) ** discount
                rng = np.random.default_rng(int(uniform(seed * 1000 + k + 500, *(key[rows[i:i + 1]] for key in keys))[0] * 2 ** 53))
                got[i] = min(m, got[i] + rng.poisson(rate / discount * late))
            total += got
        out[rows] = total / draws
    return out


def parent_chance(p, q, totals: dict):
    """Predictive probability in the unigram restaurant of a word with p customers at q tables (arrays or columns)."""
    rest = PARENT_STRENGTH + PARENT_DISCOUNT * totals["tables"]
    return (p - q * PARENT_DISCOUNT + rest / (totals["vocabulary"] + 1)) / (PARENT_STRENGTH + totals["customers"])


def _parents(words: DataFrame, pairs: DataFrame, totals: dict, seed: int) -> DataFrame:
    """``(w, n, p, q)``: customers in training, in the parent, and its tables, of every training word."""
    below = pairs.groupBy("w").agg(F.sum(F.col("t") - F.col("n")).alias("fewer"))
    own = words.join(below.hint(HASHED), "w", "left").select("w", "n", (F.col("n") + F.coalesce("fewer", F.lit(0.0))).alias("p"))
    schema = pa.schema([("w", pa.int64()), ("n", pa.int64()), ("p", pa.float64()), ("q", pa.float64())])

    def seat(b: pa.RecordBatch) -> pa.RecordBatch:
        w, n, p = (b.column(k).to_numpy() for k in range(3))
        base = np.full(len(w), 1.0 / (totals["vocabulary"] + 1))
        rest = np.full(len(w), PARENT_STRENGTH + PARENT_DISCOUNT * max(0.0, totals["tables"] - 1))
        q = draw_tables(p, base, rest, PARENT_DISCOUNT, seed, (w,), DRAWS)
        return as_batch({"w": w, "n": n, "p": p, "q": np.minimum(q, p)}, schema)

    return map_batches(own, seat, "w long, n long, p double, q double")


def _contexts(words: DataFrame, pairs: DataFrame, ends: int) -> DataFrame:
    """``(u, tables)`` of every restaurant: a table for each customer but for those saved by shared ones."""
    spark = words.sparkSession
    # each training word but the end is followed by one token, and each training text starts once
    own = words.where(F.col("w") != int(END_HASH)).select(F.col("w").alias("u"), "n").unionByName(
        spark.range(1).select(F.lit(START).cast("long").alias("u"), F.lit(ends).cast("long").alias("n")))
    below = pairs.groupBy("u").agg(F.sum(F.col("t") - F.col("n")).alias("fewer"))
    return own.join(below.hint(HASHED), "u", "left").select("u", (F.col("n") + F.coalesce("fewer", F.lit(0.0))).alias("tables"))


def _reseated(pairs: DataFrame, contexts: DataFrame, parents: DataFrame, totals: dict, seed: int, draws: int) -> DataFrame:
    """The pairs ``(u, w, n, t)`` with new tables."""
    chance = parents.select("w", parent_chance(F.col("p"), F.col("q"), totals).alias("base"))
    asked = pairs.join(contexts.hint(HASHED), "u").join(chance.hint(HASHED), "w").select("u", "w", "n", "t", "tables", "base")
    schema = pa.schema([("u", pa.int64()), ("w", pa.int64()), ("n", pa.int64()), ("t", pa.float64())])

    def seat(b: pa.RecordBatch) -> pa.RecordBatch:
        u, w, n, t, tables, base = (b.column(k).to_numpy() for k in range(6))
        strength = STRENGTH + DISCOUNT * np.maximum(tables - t, 0)
        return as_batch({"u": u, "w": w, "n": n, "t": draw_tables(n, base, strength, DISCOUNT, seed, (u, w), draws)},
                        schema)

    return map_batches(asked, seat, "u long, w long, n long, t double")


def fit(stored: DataFrame, rounds: int = ROUNDS, draws: int = DRAWS) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """Seated pairs, words in the parent, restaurants, and the totals (a few numbers) of :func:`_added_up` rows."""
    words = materialize(stored.where(F.col("kind") == WORD).groupBy("w").agg(F.sum("n").alias("n")).where("n > 0"),
                        "lm_words")
    first = words.agg(F.sum("n").alias("n"), F.count("*").alias("v"),
                      F.sum(F.when(F.col("w") == int(END_HASH), F.col("n"))).alias("ends")).first()
    totals = {"train": int(first["n"] or 0), "vocabulary": int(first["v"]), "ends": int(first["ends"] or 0)}
    totals |= {"tables": float(totals["vocabulary"])}
    # rounds start from the power law of the process, not from one table, so that few of them are needed
    pairs = stored.where(F.col("kind") == PAIR).select("u", "w", "n", F.rint(F.pow("n", F.lit(DISCOUNT))).alias("t"))
    parents, last = None, None
    for k in range(rounds + 1):
        old = parents
        parents = materialize(_parents(words, pairs, totals, SEED + k), "lm_parents")
        got = parents.agg(F.sum("p").alias("p"), F.sum("q").alias("q")).first()
        totals |= {"customers": got["p"] or 0.0, "tables": got["q"] or 0.0}
        contexts = _contexts(words, pairs, totals["ends"])
        if old is not None:
            drop_materialized(old)
        if k == rounds:
            break
        pairs = materialize(_reseated(pairs, contexts, parents, totals, SEED + k, draws if k == rounds - 1 else 1),
                            "lm_pairs")
        if last is not None:
            drop_materialized(last)
        last = pairs
    return pairs, parents, contexts, totals


# ------------------------------------------------------------------ scores

#: Columns of an answer, one after the other in its bytes (so that they pack well): words, and pairs by their key.
WORD_ANSWER = ("<u8", "<i8", "<f4", "<f4")  # word, customers in training, chance in the parent, tables as a context
PAIR_ANSWER = ("<u8", "<f4")                # key, numerator


def to_bytes(columns: list[np.ndarray], kinds: tuple[str, ...]) -> bytes:
    return b"".join(x.astype(kind).tobytes() for x, kind in zip(columns, kinds, strict=True))


def from_bytes(blobs: list[bytes], kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The columns of answers, end to end."""
    sizes = [np.dtype(kind).itemsize for kind in kinds]
    parts = [[np.zeros(0, kind)] for kind in kinds]
    for blob in blobs:
        n, at = len(blob) // sum(sizes), 0
        for part, kind, size in zip(parts, kinds, sizes, strict=True):
            part.append(np.frombuffer(blob, kind, n, at))
            at += n * size
    return [np.concatenate(x) for x in parts]


ANSWER_SCHEMA = pa.schema([("unit", pa.int64()), ("pairs", pa.bool_()), ("rows", pa.binary())])
ANSWERS = "unit long, pairs boolean, rows binary"


def _word_answers(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Packed answers to ``(unit, bucket, words)`` from the words ``(bucket, w, n, base, mass)`` of the bucket."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        w, *values = (right.column(c).to_numpy() for c in ("w", "n", "base", "mass"))
        if not len(w) or not left.num_rows:
            return ANSWER_SCHEMA.empty_table()
        by = np.lexsort((values[2], values[0]))  # answers with equal values side by side pack well
        w, values, place = w[by].view(U64), [x[by] for x in values], np.argsort(w[by])
        order = w[place]
        unit, rows = [], []
        for u, words in zip(left.column("unit").to_pylist(), left.column("words").to_pylist(), strict=True):
            words = unpack(words)
            at = np.minimum(np.searchsorted(order, words), len(order) - 1)
            at = np.sort(place[at[order[at] == words]])
            if len(at):
                unit.append(u)
                rows.append(to_bytes([w[at], *(x[at] for x in values)], WORD_ANSWER))
        return pa.table({"unit": pa.array(unit, pa.int64()), "pairs": pa.array([False] * len(unit), pa.bool_()),
                         "rows": pa.array(rows, pa.binary())}, ANSWER_SCHEMA)

    return asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(run, ANSWERS)


def _pair_answers(seated: DataFrame) -> DataFrame:
    """Packed answers about the pairs ``(u, w, mass, units)`` to all units that ask for them."""

    def packed(held: list[pa.RecordBatch]):
        tbl = pa.Table.from_batches(held).combine_chunks()
        units = tbl.column("units").combine_chunks()
        times, unit = units.value_lengths().to_numpy(), units.flatten().to_numpy()
        u, w, mass = (tbl.column(c).to_numpy() for c in ("u", "w", "mass"))
        row = np.repeat(np.argsort(np.argsort(mass, kind="stable")), times)  # equal numerators side by side pack well
        names, code = np.unique(unit, return_inverse=True)
        by = np.argsort((code << 32) + row)
        ends, row = runs([code[by]]), row[by]
        order = np.argsort(mass, kind="stable")
        key, mass = pair_key(u.view(U64), w.view(U64))[order], mass[order]
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            at = row[lo:hi]
            yield as_batch({"unit": [names[code[by[lo]]]], "pairs": [True],
                            "rows": [to_bytes([key[at], mass[at]], PAIR_ANSWER)]}, ANSWER_SCHEMA)

    def run(batches):
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += len(b.column(3).flatten())
            if size > FLUSH:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    return seated.mapInArrow(run, ANSWERS)


def _answers(stored: DataFrame, pairs: DataFrame, parents: DataFrame, contexts: DataFrame, totals: dict,
             buckets: int) -> DataFrame:
    """``(unit, pairs, rows)``, written: what units are told of their words and pairs.

    A word may come twice, with the same values.
    """
    base = parent_chance(F.col("p"), F.col("q"), totals).cast("float")
    known = parents.join(contexts.withColumnRenamed("u", "w").hint(HASHED), "w", "left").select(
        F.pmod("w", F.lit(buckets)).cast("long").alias("bucket"), "w", "n", base.alias("base"),
        F.coalesce("tables", F.lit(0.0)).cast("float").alias("mass"))
    asked = stored.where(F.col("kind") == ASK).select(F.col("u").alias("unit"), F.col("w").alias("bucket"), "words")
    words = materialize(_word_answers(asked, known), "lm_answers")
    mass = pairs.select("u", "w", (F.col("n") - F.lit(DISCOUNT) * F.col("t")).cast("float").alias("mass"))
    asked = stored.where(F.col("kind") == PAIR).select("u", "w", "units").join(mass.hint(HASHED), ["u", "w"])
    return words.unionByName(materialize(_pair_answers(asked.select("u", "w", "mass", "units")), "lm_answers"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)`` per row of a file table."""
    own = _prepared(docs, id_col, text_col)
    with shuffles_released(docs.sparkSession):
        size = own.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
        buckets = 8 + int(size // BUCKET_BYTES)
        stored = materialize(_added_up(_packed(own, buckets), buckets), "lm_counts")
        pairs, parents, contexts, totals = fit(stored)
        start = contexts.where(F.col("u") == START).first()["tables"]
        answers = _answers(stored, pairs, parents, contexts, totals, buckets)
    for t in (stored, pairs, parents):
        drop_materialized(t)
    n_train, vocabulary, ends_ = totals["train"], totals["vocabulary"], totals["ends"]
    unknown = float(parent_chance(0.0, 0.0, totals))
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        blobs, is_pair = right.column("rows").to_pylist(), right.column("pairs").to_pylist()
        told = from_bytes([x for x, p in zip(blobs, is_pair, strict=True) if not p], WORD_ANSWER)
        key, mass = from_bytes([x for x, p in zip(blobs, is_pair, strict=True) if p], PAIR_ANSWER)
        by = np.argsort(told[0])
        # the last stands for words without an answer
        w, count, parent, tables = (np.append(x[by].astype(kind), last) for x, kind, last in zip(
            told, (U64, float, float, float), (U64(0xFFFFFFFFFFFFFFFF), 0.0, unknown, 0.0), strict=True))
        by = np.argsort(key)
        key, mass = key[by], mass[by].astype(float)
        base = np.log10((count + 0.1) / (n_train + 0.1 * (vocabulary + 1)))

        def place(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(sorted_, x), max(0, len(sorted_) - 1))
            return at, (sorted_[at] == x) if len(sorted_) else np.zeros(len(x), bool)

        texts, train = fold(left.column("text").combine_chunks()), ~np.array(left.column("held").to_pylist(), bool)
        words, pair, size = numbered([tokens(texts[a:z]) for a, z in stretches(texts)])
        code, first = pair >> 32, np.cumsum(size) - size
        at, hit = place(w, words)
        at = np.where(hit, at, len(w) - 1)  # of the unit's words
        by = np.argsort(pair)
        pair, own = pair[by], np.repeat(train, size)[by]
        ends = runs([pair])
        word, up = pair[ends[:-1]] >> 32, pair[ends[:-1]] & 0xFFFFFFFF
        seen = np.logical_or.reduceat(own, ends[:-1])  # the unit's own training pairs
        # contexts are words of the same text, or the start
        context = np.append(U64(START), words)[up]
        customers = np.where(context == U64(END_HASH), 0, np.append(float(ends_), count[at])[up])
        seated = np.append(start, tables[at])[up]
        own_mass = np.where(seen, 1 - DISCOUNT, 0.0)
        got, hit = place(key, pair_key(context, words[word]))
        if len(key):
            own_mass = np.where(hit, mass[got], own_mass)
        chance = np.log10((own_mass + (STRENGTH + DISCOUNT * seated) * parent[at][word]) / (STRENGTH + customers))
        score = np.empty(len(code))
        score[by] = np.repeat(chance, np.diff(ends))
        cols = {"n_tokens": size, "n_known": np.add.reduceat((count[at] > 0).astype(np.int64)[code], first),
                "base_score": np.add.reduceat(base[at][code], first), "score": np.add.reduceat(score, first)}
        return pa.table({"id": left.column("id"), "held_out": left.column("held"), **cols}).select(schema.names).cast(schema)

    def cogroup(left: pa.Table, right: pa.Table) -> pa.Table:
        return read(left, right) if left.num_rows else schema.empty_table()

    scored = own.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(
        cogroup, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return (scored.withColumn("train_tokens", F.lit(n_train).cast("long"))
            .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
            .select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
                    "perplexity"))
