"""Pages of any shape: deep, wide, repeated; the wrapper against the lists; matching against all alignments."""

import random
import time
from functools import lru_cache

from semweave.llm import licenses, wrapper
from tests.conftest import SF001, SF01

PAGES = "page_id long, url string, html string"


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 20_000 + "<p>bottom</p>" + "</div>" * 20_000
    wide = "<body>" + "".join(f"<div class=c{k}>w{k}</div>" for k in range(20_000)) + "</body>"
    mixed = "<body>" + "<p>a</p><h2>b</h2>" * 10_000 + "</body>"
    rows = [(k, f"http://x.example/{k}", h) for k, h in enumerate([deep, deep.replace("bottom", "ground"), wide, wide, mixed])]
    rows += [(9, "http://x.example/9", "<p>small</p>"), (9, "http://x.example/9", "<p>small</p>"), (8, None, deep)]
    t = time.time()
    got = [(r["page_id"], r["text"]) for r in wrapper.extract(spark.createDataFrame(rows, PAGES)).collect()]
    assert time.time() - t < 120
    assert sorted(got) == sorted([(0, "bottom"), (1, "ground"), (2, "\n\n".join(f"w{k}" for k in range(20_000))),
                                  (3, "\n\n".join(f"w{k}" for k in range(20_000))), (4, "\n\n".join(["a", "b"] * 10_000)),
                                  (8, "bottom"), (9, "small"), (9, "small")])


def test_shapes_survive_being_stored():
    tree = wrapper.shape(wrapper.parse("<div><p>a</p><ul><li>b<li>c</ul><p>d</p></div><nav>menu</nav>")[0])
    assert wrapper.unflatten(wrapper.flatten(tree)) == tree
    paths = [p for _, p in wrapper.numbered(tree)]
    assert len(set(paths)) == len(paths) == 6  # root, div, p, ul, li, nav
    assert any(wrapper.name_of("menu") in node[1] for node, _ in wrapper.numbered(tree))  # left-out blocks are in the tree


def test_matching_equals_all_alignments():
    rnd = random.Random(6)

    def tree(depth):
        return [rnd.choice("xyz"), [], [tree(depth - 1) for _ in range(rnd.randrange(4))] if depth else []]

    def frozen(t):
        return t[0], tuple(frozen(c) for c in t[2])

    @lru_cache(None)
    def best(a, b):
        if a[0] != b[0]:
            return 0

        @lru_cache(None)
        def rows(i, j):
            if i == len(a[1]) or j == len(b[1]):
                return 0
            return max(rows(i + 1, j), rows(i, j + 1), best(a[1][i], b[1][j]) + rows(i + 1, j + 1))

        return 1 + rows(0, 0)

    for _ in range(200):
        a, b = tree(3), tree(3)
        n, pairs = wrapper.match(a, b)
        assert n == best(frozen(a), frozen(b)) == len(pairs)
        assert all(x[0] == y[0] for x, y in pairs)


def test_the_wrapper_takes_out_what_a_host_adds_to_all_its_pages(spark):
    """The given pages share no block within a host; with blocks of neutral names added to every page, outside and
    inside the article, the texts stay what they were, and the wrapper has left out those blocks."""
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    plain = {r["page_id"]: r for r in wrapper.extract(pages).collect()}
    assert sum(r["n_template"] for r in plain.values()) == 0 < sum(r["n_listed"] for r in plain.values())
    rows = [(r["page_id"], r["url"], (r["html"] or "").replace("</article>", f"<p class=q7>Staff of {r['url'].split('/')[2]}</p></article>")
             .replace("<body>", f"<body><div class=z3><p>Welcome to {r['url'].split('/')[2]}</p></div>")) for r in pages.collect()]
    hosts = {}
    for _, url, html in rows:
        hosts.setdefault(url.split("/")[2], set()).add(html)
    large = {h for h, v in hosts.items() if len(v) >= 8}
    got = {r["page_id"]: r for r in wrapper.extract(spark.createDataFrame(rows, PAGES)).collect()}
    mine = [k for k, url, _ in rows if url.split("/")[2] in large]
    assert len(mine) > 20 and all(got[k]["text"] == plain[k]["text"] for k in mine)
    assert all(got[k]["n_template"] >= 1 for k in mine)


def test_wrapper_without_article_and_lists(spark):
    page = ("<body><ul class=menu><li>Home<li>News</ul><div class=x1><p>{0}</p><p>more {0}</p></div><div class=x2>All rights</div></body>")
    rows = [(k, f"http://y.example/{k}", page.format(f"story {k}")) for k in range(8)]
    got = wrapper.extract(spark.createDataFrame(rows, PAGES), lists=False).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: f"story {k}\n\nmore story {k}" for k in range(8)}
    assert all((r["n_template"], r["n_listed"]) == (3, 0) for r in got)


def test_license_training_sends_a_bounded_sample(spark):
    rows = [(k % 7 if k < 300 else k, f"a line number {k % 11} of some ordinary text here\n" * 6) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(12)
    model, again = licenses.fit(df), licenses.fit(df.repartition(3))
    assert (model.weights == again.weights).all() if hasattr(model, "weights") else True
    assert licenses.scan(df.withColumnRenamed("id", "doc_id")).where("size(families) > 0").count() == 0


def test_license_identifiers_headings_and_unlisted_licences(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    want = {"SPDX-License-Identifier: MIT": ["MIT"], "// SPDX-License-Identifier: Apache-2.0": ["Apache"],
            "MIT License": ["MIT"], "GNU GENERAL PUBLIC LICENSE Version 3": ["GPL"],
            "This file is covered by the LGPLv3 license": ["LGPL"],
            "Permission to use, copy, modify, and/or distribute this software for any purpose\nwith or without fee is "
            "hereby granted, provided that the above copyright notice": ["ISC"],
            "This is free and unencumbered software released into the public domain.": ["Unlicense"],
            "Licensed under the Zebra Public License, version 4": "unknown",
            "Distributed under the terms of the Boost Software License": "unknown",
            "He got a driving license in May and went home": [], "MIT students love pizza": [],
            "The copyright page of the book is torn": [], "for " * 900: [], "and so on " * 40: []}
    own = spark.createDataFrame([(10**9 + k, t) for k, t in enumerate(want)], "doc_id long, text string")
    got = {r["doc_id"] - 10**9: r for r in licenses.scan(docs.select("doc_id", "text").unionByName(own))
           .where(f"doc_id >= {10**9}").collect()}
    said = {t: "unknown" if got[k]["n_unknown"] else got[k]["families"] for k, t in enumerate(want)}
    assert said == want


def test_license_windows_equal_all_pieces_one_by_one(spark, monkeypatch):
    """Brute force: every line and window as rows of their own, whatever stretches a paragraph is read in."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    model = licenses.fit(docs.selectExpr("doc_id AS id", "text"))
    monkeypatch.setattr(licenses, "STRETCH", 160)
    texts = [r["text"] or "" for r in docs.collect()] + ["one", "Released under\nthe MIT License.", "a b"]
    for t in texts:
        held = licenses.paragraphs(t.encode())
        want = []
        for lines in held:
            flat = [w for x in lines for w in x]
            cut, at = [], 0
            for x in lines:
                if len(x) <= licenses.LINE_WORDS:
                    cut.append((at, at + len(x)))
                at += len(x)
            for size, stride in licenses.WINDOWS:
                if len(lines) > 1 or len(flat) > size:
                    cut += [(k, min(k + size, len(flat))) for k in range(0, max(1, len(flat) - size + stride), stride)]
            said = licenses.judge(model, [flat[a:z] for a, z in cut])
            want.append(licenses.verdict([(a, z, flat[a:z], f, p) for (a, z), (f, p) in zip(cut, said, strict=True)
                                          if f != "none"]))
        got = licenses.judge_paragraphs(model, held, licenses.WordHash())
        assert [(sorted(f), odd) for f, odd in got] == [(sorted(f), odd) for f, odd in want]
