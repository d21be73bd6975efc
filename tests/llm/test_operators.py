"""The training-data operators against brute-force versions, round trips and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from semweave.llm import (
    decontamination,
    language_model,
    licenses,
    line_dedup,
    mixing,
    near_dedup,
    ranking,
    repetition,
    token_counts,
    wrapper,
)
from tests.conftest import SF001, SF01

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}


def shingle_set(text):
    w = text.encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def components(texts, similarity=75):
    """Smallest reachable id by an inverted index over all shingles."""
    sets, index, parent = {i: shingle_set(t) for i, t in texts.items()}, defaultdict(list), {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        for j, both in Counter(j for s in sets[i] for j in index[s]).items():
            if 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            index[s].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_dedup_equals_all_pairs(spark, documents, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(documents).collect()}
    assert got == components(texts)


def test_near_dedup_large_group_of_near_copies(spark):
    """More members than a block: every block pair is looked at."""
    random.seed(4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(random.choice([0, 1, 1, 2, 6])):
            w[random.randrange(len(w))] = f"x{random.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(dict(rows))


def test_hyperminhash_registers():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.append(a[:2400], rng.integers(0, 2**63, 600, dtype=np.uint64) * np.uint64(2) + np.uint64(1)))
    p, q = near_dedup.sketch(a), near_dedup.sketch(b)
    used = (p != near_dedup.EMPTY) | (q != near_dedup.EMPTY)
    estimate = near_dedup.estimate(((p == q) & used).sum(), used.sum())
    assert abs(estimate - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.2
    assert (near_dedup.sketch(a) == p).all() and (near_dedup.sketch(a[:0]) == near_dedup.EMPTY).all()


def test_language_model_base_and_gain(spark, texts):
    got = language_model.score_documents(spark.read.parquet(f"{SF01}/documents.parquet")).collect()
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    words = {i: [*t.encode().lower().split(), b"\n"] for i, t in texts.items()}
    c = Counter(w for i in words if not held[i] for w in words[i])
    n, v = sum(c.values()), len(c)
    ours = base = 0.0
    for r in got:
        w = words[r["doc_id"]]
        want = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert abs(r["base_score"] - want) < 1e-6 * abs(want)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            held[r["doc_id"]], len(w), sum(c[x] > 0 for x in w), n)
        if r["held_out"]:
            ours, base = ours + r["score"], base + r["base_score"]
    assert ours > base


def small_corpus():
    random.seed(2)
    return [(i, " ".join(random.choice("the of cat dog sat ran far".split()) for _ in range(30))) for i in range(60)]


def stored_pairs(spark, rows):
    own = language_model._prepared(spark.createDataFrame(rows, DOCS), "doc_id", "text")
    return language_model.materialize(language_model._added_up(language_model._packed(own, 5), 5), "lm_test")


def training_pairs(rows):
    """(context, word) -> count, by hash."""
    words, out = language_model.Words(), Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            h = [words[w] for w in [*(t or "").lower().encode().split(), b"\n"]]
            out.update(zip([language_model.START, *h], h, strict=False))
    return out


def test_language_model_probabilities_sum_to_one(spark):
    rows = small_corpus()
    pairs, parents, contexts, totals = language_model.fit(stored_pairs(spark, rows))
    want = training_pairs(rows)
    got = {(r["u"], r["w"]): r for r in pairs.collect()}
    assert {k: r["n"] for k, r in got.items() if r["n"] > 1} == {k: n for k, n in want.items() if n > 1}
    parents = {r["w"]: r for r in parents.collect()}
    parent = {w: language_model.parent_chance(r["p"], r["q"], totals) for w, r in parents.items()}
    assert abs(sum(parent.values()) + language_model.parent_chance(0.0, 0.0, totals) - 1) < 1e-9
    tables = {k: got[k]["t"] if k in got else 1.0 for k in want}
    for r in contexts.collect():
        own = {w: n for (u, w), n in want.items() if u == r["u"]}
        assert abs(sum(tables[r["u"], w] for w in own) - r["tables"]) < 1e-9
        mass = sum(n - language_model.DISCOUNT * tables[r["u"], w] for w, n in own.items())
        rest = language_model.STRENGTH + language_model.DISCOUNT * r["tables"]
        assert abs((mass + rest) / (language_model.STRENGTH + sum(own.values())) - 1) < 1e-9


def test_language_model_tokens_are_the_words_between_white_space():
    texts = [b"", b" ", b" a b ", b"a", b"\x1ca\x1d b\x85", b"\n\n", b"\xff\xfe x\x0b\x0cy\r", b"\x00 z", b"a b a b"]
    words = language_model.Words()
    known, pair, n = language_model.numbered([language_model.tokens(texts[:4]), language_model.tokens(texts[4:])])
    want = [[words[w] for w in [*t.split(), language_model.END]] for t in texts]
    assert n.tolist() == [len(h) for h in want]
    assert known[pair >> 32].tolist() == sum(want, [])
    before = np.append(np.uint64(language_model.START), known)[pair & 0xFFFFFFFF]
    assert before.tolist() == sum([[language_model.START, *h[:-1]] for h in want], [])


def test_language_model_lets_go_of_what_it_has_read(spark, tmp_path):
    from pathlib import Path

    from semweave.session import fresh_path, shuffles_released

    def tables():
        return {x.name for x in Path(fresh_path(spark, "x").removeprefix("file:")).parent.glob("lm_*")}

    old = tables()
    spark.createDataFrame([(i, f"a b c{i % 7} a b") for i in range(50)], DOCS).write.parquet(str(tmp_path / "docs"))
    got = language_model.score_documents(spark.read.parquet(str(tmp_path / "docs")))
    left = {name.rsplit("-", 1)[0] for name in tables() - old}
    assert left <= {"lm_words", "lm_answers"}, left  # counts, seats and parents are not kept on disk
    assert got.count() == 50
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with shuffles_released(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == before


def test_language_model_units_know_pairs_seen_once(spark):
    """Scores by the definition, from the fitted tables, for texts whose pairs occur never, once and often."""
    rows = [*small_corpus(), (900, "rare words here"), (901, "rare words here"), (902, "once upon a time"),
            (903, "The cat"), (904, None), (905, ""), (906, "upon never"), (907, "once upon a cat")]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in language_model.score_documents(df).collect()}
    again = {r["doc_id"]: r for r in language_model.score_documents(df.repartition(3)).collect()}
    pairs, parents, contexts, totals = language_model.fit(stored_pairs(spark, rows))
    want, words = training_pairs(rows), language_model.Words()
    seated = {(r["u"], r["w"]): r["n"] - language_model.DISCOUNT * r["t"] for r in pairs.collect()}
    seated = {k: seated.get(k, 1 - language_model.DISCOUNT) for k in want}
    parent = {r["w"]: language_model.parent_chance(r["p"], r["q"], totals) for r in parents.collect()}
    tables = {r["u"]: r["tables"] for r in contexts.collect()}
    customers = Counter()
    for (u, _), n in want.items():
        customers[u] += n
    for i, t in rows:
        h = [words[w] for w in [*(t or "").lower().encode().split(), b"\n"]]
        score = 0.0
        for u, w in zip([language_model.START, *h], h, strict=False):
            rest = language_model.STRENGTH + language_model.DISCOUNT * tables.get(u, 0.0)
            score += math.log10((seated.get((u, w), 0.0) + rest * parent.get(w, language_model.parent_chance(0.0, 0.0, totals)))
                                / (language_model.STRENGTH + customers[u]))
        assert abs(got[i]["score"] - score) < 1e-5 * abs(score), i
        assert got[i]["score"] == again[i]["score"], i  # no partition or batch plays a part


def test_language_model_agrees_with_customers_seated_one_by_one(spark):
    """An exact sampler: each customer leaves and sits down again, the parent's customers follow its tables."""
    rows = small_corpus()
    want = training_pairs(rows)
    d, theta = language_model.DISCOUNT, language_model.STRENGTH
    pd, ptheta = language_model.PARENT_DISCOUNT, language_model.PARENT_STRENGTH
    rng = random.Random(5)
    vocabulary = len({w for _, w in want})
    rooms, parent = defaultdict(lambda: defaultdict(list)), defaultdict(list)

    def sit(dishes, dish, base, dis, strength):
        """True where a table is opened."""
        open_ = sum(map(len, dishes.values()))
        weights = [c - dis for c in dishes[dish]] + [(strength + dis * open_) * base]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(dishes[dish]):
            dishes[dish].append(1)
            return True
        dishes[dish][k] += 1
        return False

    def leave(dishes, dish):
        k = rng.choices(range(len(dishes[dish])), dishes[dish])[0]
        dishes[dish][k] -= 1
        if not dishes[dish][k]:
            del dishes[dish][k]
            return True
        return False

    def base(w):
        n, t = sum(map(sum, parent.values())), sum(map(len, parent.values()))
        return (sum(parent[w]) - pd * len(parent[w]) + (ptheta + pd * t) / (vocabulary + 1)) / (ptheta + n)

    def add(u, w):
        if sit(rooms[u], w, base(w), d, theta):
            sit(parent, w, 1 / (vocabulary + 1), pd, ptheta)

    customers = [k for k, n in want.items() for _ in range(n)]
    for u, w in customers:
        add(u, w)
    mean, chance, sweeps = Counter(), Counter(), 24
    total = Counter(u for u, _ in customers)
    for s in range(sweeps + 4):
        for u, w in customers:
            if leave(rooms[u], w):
                leave(parent, w)
            add(u, w)
        if s >= 4:
            for u, w in want:
                mean[u, w] += len(rooms[u][w]) / sweeps
                open_ = sum(map(len, rooms[u].values()))
                chance[u, w] += (want[u, w] - d * len(rooms[u][w]) + (theta + d * open_) * base(w)) / (theta + total[u]) / sweeps
    pairs, parents, contexts, totals = language_model.fit(stored_pairs(spark, rows), rounds=8, draws=30)
    got = {(r["u"], r["w"]): r["t"] for r in pairs.collect()}
    assert abs(sum(got.get(k, 1.0) for k in want) / sum(mean.values()) - 1) < 0.1  # both chains wander by some 4 %
    parent = {r["w"]: language_model.parent_chance(r["p"], r["q"], totals) for r in parents.collect()}
    tables = {r["u"]: r["tables"] for r in contexts.collect()}
    for (u, w), n in want.items():  # predictive probabilities
        ours = (n - d * got.get((u, w), 1.0) + (theta + d * tables[u]) * parent[w]) / (theta + total[u])
        assert abs(ours - chance[u, w]) < 0.1 * chance[u, w] + 0.01


def test_table_counts_by_all_seatings():
    """The distribution of the tables of four customers, by counting all seatings."""
    d, s, base, weights = 0.7, 3.0, 0.2, defaultdict(float)

    def go(tables, k, weight):
        if k == 4:
            weights[len(tables)] += weight
            return
        go([*tables, 1], k + 1, weight * base * (s + d * len(tables)))
        for i, c in enumerate(tables):
            go([*tables[:i], c + 1, *tables[i + 1:]], k + 1, weight * (c - d))

    go([], 0, 1.0)
    many = 40_000
    t = language_model.draw_tables(np.full(many, 4), np.full(many, base), np.full(many, s), d, 1, (np.arange(many),))
    for k in range(1, 5):
        assert abs((t == k).mean() - weights[k] / sum(weights.values())) < 0.01


@pytest.mark.parametrize(("base", "strength"), [(1e-4, 50.0), (0.01, 500.0), (0.02, 5000.0)])
def test_table_counts_of_large_dishes(base, strength):
    """Beyond the exact table: means against the whole recurrence of 3,000 customers."""
    n, d = 3000, language_model.DISCOUNT
    log, k = np.full(n + 1, -np.inf), np.arange(1, n + 1)
    log[0] = 0.0
    with np.errstate(divide="ignore"):
        for i in range(1, n + 1):
            log[1:], log[0] = np.logaddexp(log[:-1], np.log(np.maximum(i - 1 - d * k, 0)) + log[1:]), -np.inf
    weight = log[1:] + np.cumsum(np.log(base * (strength + d * (k - 1))))
    p = np.exp(weight - weight.max())
    want = (p * k).sum() / p.sum()
    rows = 400
    got = language_model.draw_tables(np.full(rows, n), np.full(rows, base), np.full(rows, strength), d, 3,
                                     (np.arange(rows),)).mean()
    assert abs(got - want) < 0.05 * want + 0.1


def repeats(w, least):
    covered, windows, longest = set(), set(), 0
    for i in range(len(w)):
        for j in range(len(w)):
            n = 0
            while i != j and max(i, j) + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            if n >= 8:
                windows |= set(range(i, i + 8))
            if n >= least:
                covered |= set(range(i, i + n))
                longest = max(longest, n)
    return len(windows), len(covered), longest


def test_repetition_equals_all_pairs_of_suffixes(spark):
    random.seed(0)
    rows = []
    for k in range(40):
        base = [random.choice("abcdef") for _ in range(random.randint(0, 50))]
        rows.append((k, " ".join(base + base[3:25] + [random.choice("ab") for _ in range(9)] + base[:13])))
    rows += [(90, "x " * 40), (91, "a b\na b\n\n a b\n#|")]
    got = {r["doc_id"]: r for r in repetition.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t in rows:
        r, w = got[i], t.split()
        assert (r["n_repeat_words"], r["n_covered"], r["longest_repeat"]) == repeats(w, repetition.MIN_WORDS)
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w))
        assert r["base_failed"] == (len(w) < 20 or 100 * r["n_repeat_words"] > 30 * len(w))
    assert got[91]["n_dup_lines"] == 1 and got[91]["n_symbols"] == 2
    spans = repetition.repeated_substrings(spark.createDataFrame([(1, "p q r s t u p q r s t u p q r")], DOCS), 4)
    assert {(r["length"], r["occurrences"], r["first_word"]) for r in spans.collect()} == {(9, 2, 0)}


def test_mix_keeps_the_shares(spark, documents):
    got = mixing.mix_sources(documents.select("doc_id", "source")).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in documents.select("doc_id").collect())
    assert len({r["position"] for r in got}) == len(got)
    slots = {r["slot"]: r["source"] for r in got}
    sizes = Counter(r["source"] for r in got)
    root = sum(math.sqrt(n) for n in sizes.values())
    share = {s: max(1, round(1000 * math.sqrt(n) / root)) for s, n in sizes.items()}
    cycle, seen = sum(share.values()), Counter()
    end = max(r["slot"] for r in got if r["on_target"])
    for t in range(end + 1):
        seen[slots[t]] += 1
        for s in share:
            assert abs(seen[s] - (t + 1) * share[s] / cycle) < 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_and_probes():
    random.seed(3)
    for _ in range(4000):
        a = "".join(random.choice("ab") for _ in range(random.randint(0, 14)))
        b = "".join(random.choice("ab") if random.random() < 0.1 else x for x in a if random.random() > 0.1)
        for tau in (1, 2, 3):
            assert line_dedup.within(a, b, tau) == (edits(a, b) <= tau)
    for _ in range(500):
        a = "".join(random.choice("abcd") for _ in range(random.randint(30, 60)))
        b = list(a)
        for _ in range(2):
            k = random.randrange(len(b))
            b[k:k + 1] = random.choice([[], ["x"], [b[k], "y"]])
        short, long = sorted((a, "".join(b)), key=len)
        index = {(n, i, short[s:e]) for n, i, s, e, r in line_dedup.probes(len(short)) if r == 0}
        assert index & {(n, i, long[s:e]) for n, i, s, e, _ in line_dedup.probes(len(long))}


def without_near_lines(texts, exact=line_dedup.MIN_CHARS):
    """Line dedup by comparing all lines of like length; exact repeats go from ``exact`` code points on."""
    first, lengths = {}, defaultdict(list)
    for i in sorted(texts):
        for k, x in line_dedup.line_rows(texts[i], line_dedup.MIN_CHARS):
            first.setdefault(x, (i, k))
    for x in first:
        lengths[len(x)].append(x)
    counts, near = {x: Counter(x) for x in first}, set()
    for x in first:
        for n in range(len(x), len(x) + 3):
            for y in lengths.get(n, ()):
                if x is not y and sum(((counts[x] - counts[y]) + (counts[y] - counts[x])).values()) <= 4 \
                        and edits(x, y) <= line_dedup.TAU:
                    near.add(max(x, y, key=first.get))
    for i in sorted(texts):
        for k, x in line_dedup.line_rows(texts[i], exact):
            first.setdefault(x, (i, k))
    out = {}
    for i, t in texts.items():
        gone = {k for k, x in line_dedup.line_rows(t, exact) if x in near or first[x] != (i, k)}
        out[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    return out, near


def test_line_dedup_equals_all_pairs(spark):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    texts = {r["doc_id"]: r["text"] for r in rows}
    line = "the quick brown fox jumps over the lazy dog again"
    texts |= {10**6: line + "\nown words stand here", 10**6 + 1: line.replace("quick", "quack") + "\n" + line,
              10**6 + 2: line.replace("lazy ", "") + "\n" + line[:-2]}
    got = line_dedup.line_dedup(spark.createDataFrame(list(texts.items()), DOCS)).collect()
    want, near = without_near_lines(texts)
    assert near and {r["doc_id"]: r["text"] for r in got} == want


def test_line_dedup_query_drops_short_repeats(spark):
    """Exact repeats of every line that is not empty go; near repeats of short lines stay."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    long, _ = without_near_lines(texts)
    seen, want = set(), {}
    for i in sorted(texts):
        short = []
        for x in long[i].split("\n"):
            key = x.strip(line_dedup.SPACE)
            if not 0 < len(key) < line_dedup.MIN_CHARS or key not in seen:
                short.append(x)
            seen.add(key)
        want[i] = "\n".join(short)
    assert want != long
    got = entry.queries()["op5_line_dedup"](spark, SF001).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want


def test_quality_scores_on_held_out_rows(spark, documents):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = ranking.quality_scores(documents, labels).collect()
    own = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(own) > 40 and sum(a == b for a, b in own) / len(own) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_pair_sums_by_differences():
    rng = np.random.default_rng(0)
    good, bad, w = rng.normal(size=(5, 3)), rng.normal(size=(4, 3)), rng.normal(size=3)
    loss, grad, second = ranking.pair_sums(good, bad, w)
    diff = (good[:, None] - bad[None]).reshape(-1, 3)
    p = 1 / (1 + np.exp(diff @ w))
    assert np.isclose(loss, np.log1p(np.exp(-diff @ w)).sum())
    assert np.allclose(grad, -(p[:, None] * diff).sum(0))
    assert np.allclose(second, (diff.T * (p * (1 - p))) @ diff)


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner))
    return "\n\n".join(x for x in (" ".join(unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if x)


def test_pages_equal_their_articles(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    got = wrapper.extract(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_wrapper_finds_constant_blocks(spark):
    """Without an article element the host's constant blocks are template, its varying ones content."""
    page = "<body><div class=top>Example site</div><div class=story><p>{0}</p><p>more of {0}</p></div><div>Contact us</div></body>"
    rows = [(k, f"http://x.example/{k}", page.format(f"story {k * k}")) for k in range(6)]
    got = wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: f"story {k * k}\n\nmore of story {k * k}" for k in range(6)}


def test_wrapper_finds_template_inside_articles(spark):
    """Blocks that all pages of a host carry are template inside the article too; copies of a page are one witness."""
    page = ("<body><article><h1>{0}</h1><div class=box><p>Read on our site</p></div><p>first of {0}</p><p>Our staff wrote this</p>"
            "<p>last of {0}</p></article></body>")
    rows = [(k, f"http://x.example/{k}", page.format(f"story {k * k}")) for k in range(6)]
    rows += [(10 + k, f"http://copies.example/{k}", page.format("same")) for k in range(6)]
    got = wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = {k: f"story {k * k}\n\nfirst of story {k * k}\n\nlast of story {k * k}" for k in range(6)}
    copy = "same\n\nRead on our site\n\nfirst of same\n\nOur staff wrote this\n\nlast of same"
    assert {r["page_id"]: r["text"] for r in got} == want | {10 + k: copy for k in range(6)}
    path = wrapper.ROOT
    for label in ("body", "article", "p"):
        path = wrapper.below(path, label)
    mirror = {"path": path, "text": wrapper.name_of("one")}
    assert wrapper.parted("<body><article><p>one</p></article></body>", [mirror]) == ("one", 1, 0)
    assert wrapper.content("<body><article><p>one</p><p>two</p></article></body>", [mirror]) == "two"


def test_article_names_with_widget_words():
    page = ("<article><section id='related-work'><h2 id='search'>Search</h2><p>one</p></section><div id='social-history'>two</div>"
            "<p class='copyright-law'>three</p><div class='share-buttons'>four</div><div class='related'>five</div>"
            "<div class='section' id='notice'>six</div></article>")
    assert wrapper.content(page, None) == "Search\n\none\n\ntwo\n\nthree\n\nsix"


def test_wrapper_with_odd_first_pages(spark):
    """Null, empty and odd pages with the smallest ids do not cost the host its wrapper; two layouts have one each."""
    page = "<body><div class=top>Example site</div><div class=story><p>{0}</p></div></body>"
    other = "<body><section><p>{0}</p></section><div class=low>Contact us</div></body>"
    rows = [(0, None), (1, ""), (2, "<table><tr><td>odd"), *((k, page.format(f"story {k}")) for k in range(3, 9)),
            *((k, other.format(f"story {k}")) for k in range(9, 14))]
    rows = [(k, f"http://x.example/{k}", h) for k, h in rows]
    got = wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {0: "", 1: "", 2: "odd"} | {k: f"story {k}" for k in range(3, 14)}


def test_left_out_elements():
    page = ("<body><header>top</header><article><header><h1>Title</h1></header><p>one&nbsp;&lt;two <span class='ad'>buy</span>and <button>ok</button>three</p>"
            "<aside>side</aside><div class='userComment'><p>reader</p></div><form><p>mail</p></form>"
            "<div id='cookie-notice'>ok?</div><ul><li>a<li>b</ul><section class='comments'><p>x</p></section>"
            "<table><tr><td>c<td>d</table></article><footer>end</footer></body>")
    assert wrapper.content(page, None) == "Title\n\none <two and three\n\na\n\nb\n\nc\n\nd"


def test_tree_matching():
    a = ["r", 0, [["x", 1, []], ["y", 2, [["z", 3, []]]], ["x", 4, []]]]
    b = ["r", 0, [["y", 2, [["z", 9, []]]], ["w", 5, []], ["x", 4, []]]]
    n, pairs = wrapper.match(a, b)
    assert n == 4 and {(x[0], x[1], y[1]) for x, y in pairs} == {("r", 0, 0), ("y", 2, 2), ("z", 3, 9), ("x", 4, 4)}


def test_decontamination_finds_all_whole_items(spark, documents, texts):
    bench = spark.read.parquet(f"{SF01}/benchmark.parquet")
    items = {r["item_id"]: r["text"].lower().split() for r in bench.collect()}
    index = {tuple(w[k:k + 8]) for w in items.values() for k in range(len(w) - 7)}
    want = set()
    for i, t in texts.items():
        w = t.lower().split()
        if any(tuple(w[k:k + 8]) in index for k in range(len(w) - 7)):
            want.add(i)
    got = {r["doc_id"] for r in decontamination.decontaminate(documents, bench).where("contaminated").collect()}
    assert want and len(want & got) >= 0.98 * len(want) and not got - want


def test_decontamination_paraphrase(spark):
    random.seed(5)
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ana", "ero", "ivu", "oste", "umi")]
    items = [(k, " ".join(random.sample(words, 20))) for k in range(12)]
    item = items[3][1].split()
    changed = [w if k % 5 else "other" for k, w in enumerate(item[:-5])] + item[-5:]
    other = words[:12] + [f"z{k}" for k in range(300)]
    rows = [(k, " ".join(random.choice(other) for _ in range(150))) for k in range(60)]
    rows.append((99, " ".join(random.choice(other) for _ in range(70)) + " " + " ".join(changed) + " end"))
    got = decontamination.decontaminate(spark.createDataFrame(rows, DOCS),
                                        spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["answer"]) for r in got if r["contaminated"]] == [(99, 3, True)]


def test_decontamination_long_items(spark):
    """Items beyond a passage, copied whole and paraphrased, and other texts of the same words."""
    random.seed(6)
    words = [f"{a}{b}{c}" for a in "bcdfglmnprst" for b in ("ana", "ero", "ivu", "oste", "umi") for c in "klmnprstvz"]
    items = [(k, " ".join(random.choice(words) for _ in range(n))) for k, n in enumerate([20, 250, 400, 2000] * 20)]
    rows = [(k, " ".join(random.choice(words) for _ in range(random.choice([150, 900, 5000])))) for k in range(200)]
    want = {}
    for k, text in items[:12]:
        w = text.split()
        around = [" ".join(random.choice(words) for _ in range(random.randint(0, 90))) for _ in range(4)]
        changed = [x if n % 4 else "other" for n, x in enumerate(w[:-5])] + w[-5:]
        rows += [(1000 + k, f"{around[0]} {text} {around[1]}"), (2000 + k, f"{around[2]} {' '.join(changed)} {around[3]}")]
        want |= {1000 + k: (k, 1.0), 2000 + k: (k, sum(x != "other" for x in changed) / len(w))}
    got = decontamination.decontaminate(spark.createDataFrame(rows, DOCS).repartition(4),
                                        spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {r["doc_id"]: (r["item_id"], r["share"]) for r in got if r["contaminated"]}
    assert {k: i for k, (i, _) in found.items()} == {k: i for k, (i, _) in want.items()}
    assert all(share >= want[k][1] for k, (_, share) in found.items())


def test_license_scan(spark, documents, texts):
    notices = {"Licensed under the Apache License, Version 2.0.": "Apache", "Released under the MIT License.": "MIT",
               "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "All rights reserved.": "proprietary",
               "This work is licensed under the GNU General Public License, version 3.": "GPL"}
    got = {r["doc_id"]: set(r["families"]) for r in licenses.scan(documents).collect()}
    assert got == {i: {f for n, f in notices.items() if n in t} for i, t in texts.items()}
    model = licenses.fit(documents.selectExpr("doc_id AS id", "text"))
    said = licenses.judge(model, [licenses.words_of(x) for x in (
        b"Licensed under the Foo Bar Licence", b"This work is licensed under the GNU Affero General Public License, "
        b"version 3.", b"plain words of a story")])
    assert [f for f, _ in said] == ["unknown", "AGPL", "none"]


def test_license_scan_of_wrapped_notices(spark, documents):
    """The usual headers at 72 to 80 columns, bare and as comments, alone and inside a paragraph of other words."""
    import textwrap

    notices = {
        "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
               "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
               "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
               "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
               "conditions:",
        "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
               "the following conditions are met:",
        "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
               "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
               "option) any later version.",
        "AGPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                "(at your option) any later version."}
    other = next(r["text"] for r in documents.where("length(text) > 600 and not text like '%icense%'").orderBy("doc_id").collect()
                 if "rights" not in r["text"]).replace("\n", " ")
    rows, want = [], {}
    for family, notice in notices.items():
        for width in (72, 76, 80):
            for head in ("", " * ", "# "):
                for text in (notice, f"{other[:300]} {notice} {other[300:600]}"):
                    rows.append((len(rows), "\n".join(head + x for x in ["Title", "", *textwrap.wrap(text, width), ""])))
                    want[len(rows) - 1] = ([family], 2)
    rows.append((len(rows), "Released under\nthe MIT License."))
    want[len(rows) - 1] = (["MIT"], 1)
    both = documents.select("doc_id", "text").unionByName(
        spark.createDataFrame([(10**9 + k, t) for k, t in rows], DOCS))
    got = licenses.scan(both).where(f"doc_id >= {10**9}").collect()
    assert {r["doc_id"] - 10**9: (r["families"], r["n_paragraphs"]) for r in got} == want


@pytest.fixture(scope="module")
def model_file():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_token_prefixes_equal_the_library(model_file):
    import sentencepiece

    random.seed(1)
    library, own = sentencepiece.SentencePieceProcessor(model_file=model_file), token_counts.PrefixCounter(model_file)
    for _ in range(300):
        t = "".join(random.choice("aeth onrs  \n▁é漢字①x</s>0\t.") for _ in range(random.randint(0, 40)))
        assert own.prefixes(t).tolist() == [len(library.encode(t[:k])) for k in range(len(t) + 1)]
        assert own.count(t) == len(library.encode(t))


def test_token_counts_and_truncation(spark, documents, texts, model_file):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_file)
    got = {r["doc_id"]: r for r in token_counts.token_counts(documents, model_file, limit=500).collect()}
    for i, t in texts.items():
        r, n = got[i], len(library.encode(t))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(t.encode()), n > 500)
        assert len(library.encode(t[:r["fit_chars"]])) <= 500 and (n > 500 or r["fit_chars"] == len(t))
    small = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None)], DOCS)
    cut = {r["doc_id"]: r["fit_chars"] for r in
           token_counts.truncate(token_counts.prefix_table(small, model_file), 3).collect()}
    assert len(library.encode("the cat sat on the mat"[:cut[1]])) <= 3 < len(library.encode("the cat sat on the mat"))
    assert cut[2] == 0


def brute_pipeline(texts, bench):
    """Ids and texts after the first four stages."""
    kept = {}
    for i, t in texts.items():
        w = t.split()
        windows = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        hit = {p for k in range(len(w) - 7) if windows[tuple(w[k:k + 8])] > 1 for p in range(k, k + 8)}
        if len(w) >= 20 and 100 * len(hit) <= 30 * len(w):
            long = Counter(tuple(w[k:k + 12]) for k in range(len(w) - 11))
            cover = {p for k in range(len(w) - 11) if long[tuple(w[k:k + 12])] > 1 for p in range(k, k + 12)}
            far = Counter(tuple(w[k:k + 101]) for k in range(len(w) - 100))
            if len(cover) <= repetition.MAX_COVERED * len(w) and max(far.values(), default=0) < 2:
                kept[i] = t
    left, _ = without_near_lines(kept, 1)
    kept = {i: t for i, t in left.items() if t.split() or t == kept[i]}
    groups = components(kept)
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    index = {tuple(w[k:k + 8]) for w in bench for k in range(len(w) - 7)}
    return {i: t for i, t in kept.items()
            if not any(tuple((w := t.lower().split())[k:k + 8]) in index for k in range(len(t.split()) - 7))}


def test_pipeline_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    bench = [r["text"].lower().split() for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    got = corpus_pipeline.run(spark, SF001).collect()
    assert {r["doc_id"]: r["text"] for r in got} == brute_pipeline(docs, bench)
    assert len({r["position"] for r in got}) == len(got)


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
