"""Licence scans: a trained paragraph classifier, an unknown class, confirmation by templates.

A paragraph is a run of lines with words. It is judged in pieces: its lines (of
up to ``LINE_WORDS`` words), and where it has several lines or is long, the
overlapping windows of its words (``WINDOWS``), so that a notice is seen whole
however it is wrapped. Every piece of every paragraph goes through the
classifier; no word list stands before it. Of pieces that overlap, the one
that its template confirms best tells the family. A paragraph without a family
is "unknown" if one of its pieces is.

A piece is described by its one- to three-word n-grams, hashed to 2^14 cells,
with values 1 / sqrt(number of n-grams); sums over windows come from running
sums over the words. A softmax regression tells the licence families, "unknown"
and "none" apart. It is trained here:

* licence rows are the notices in ``TEMPLATES`` and variants of them (words
  left out, cut short, joined with a sentence of the corpus);
* "unknown" rows are the same notices with the words that name their family
  replaced by words of the corpus: notices of licences that are not listed;
* "none" rows are the sentences in ``OTHER``, which do not depend on the corpus
  (an argument), and lines of the documents: a bounded sample, at most
  ``NEGATIVES`` lines, the first ``LINES`` longer ones (their first ``WORDS``
  words) of the ``NEGATIVES / LINES`` documents with the smallest hashes of their
  ids, without a line that names a licence (the classifier may be fitted on a
  bounded sample; the scan covers every paragraph). Windows of their joined
  lines are rows as well, as the scan judges windows, and phrases of one to
  three of their words said again and again. The hashes are cut to
  that number first, then the lines of those documents are fetched, so
  the driver gets as many bytes at any size of the input.

A quarter of the rows is set aside; on it the softmax temperature is chosen
by likelihood, the least confidence that keeps wrong families below 1 %, and
the least chance of not being "none" that no "none" row reaches.
Template comparison then confirms a family: the share of the template's
distinct words that stand in the paragraph must reach ``CONFIRM``; what a
template does not confirm is "unknown" as well if its chance of not being "none"
reaches that bound, by its n-grams and by its distinct n-grams, else it is none.

Null or empty texts have no licence. Every row is scanned alone: ties,
repeated rows and further columns play no part. Families are listed in
alphabetical order, each once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semweave.llm.common import WordHash, as_batch, map_batches, raw

BITS = 14
#: Bounds of the "none" rows: lines in all, lines of a document, words of a line.
NEGATIVES, LINES, WORDS = 2000, 4, 200
CONFIRM = 0.7
#: Words of a line that is a piece of its own, and of the stretch of a long paragraph that is judged at a time.
LINE_WORDS, STRETCH = 64, 32_768
#: Words of a window and between windows: the shorter templates and all of them stand whole in one.
WINDOWS = ((20, 8), (48, 16))
WRONG = 0.01
#: Least chance of not being "none" of an unknown piece, whatever the rows set aside say.
SURE = 0.99
WORD = re.compile(rb"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
MARKS = frozenset((b"license", b"licensed", b"licence", b"licenced", b"copyright", b"copyrighted", b"copyleft"))
#: Short notices of common licences, as their texts ask for; the identifiers of the public list follow.
TEMPLATES = {
    "AGPL": ["This work is licensed under the GNU Affero General Public License, version 3.",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "Affero General Public License as published by the Free Software Foundation",
             "Licensed under the AGPLv3."],
    "Apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License."],
    "BSD": ["Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 "
              "International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons "
                 "Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons "
                 "Attribution-ShareAlike 4.0 International License."],
    "CC0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all "
            "copyright and related or neighboring rights to this work."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.",
            "This work is licensed under the GNU General Public License, version 2.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation",
            "GNU General Public License Version 3", "Licensed under the GPLv3 license."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any "
            "purpose with or without fee is hereby granted"],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.",
             "This file is covered by the LGPLv3 license.", "GNU Lesser General Public License Version 3"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "proprietary": ["Copyright. All rights reserved.", "All rights reserved. No part of this work may be reproduced "
                    "without permission."],
}
IDENTIFIERS = {"AGPL": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "Apache": ["Apache-2.0"],
               "BSD": ["BSD-2-Clause", "BSD-3-Clause"], "CC-BY": ["CC-BY-4.0"], "CC-BY-NC": ["CC-BY-NC-4.0"],
               "CC-BY-SA": ["CC-BY-SA-4.0"], "CC0": ["CC0-1.0"],
               "GPL": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"], "ISC": ["ISC"],
               "LGPL": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"], "MIT": ["MIT"],
               "MPL": ["MPL-2.0"], "Unlicense": ["Unlicense"]}
TEMPLATES = {f: t + [f"SPDX-License-Identifier: {x}" for x in IDENTIFIERS.get(f, ())] for f, t in TEMPLATES.items()}
#: "None" sentences that do not depend on the corpus: words of notices in other use.
OTHER = ("The driver must renew his license every five years at the office.",
         "She lost her fishing licence and paid a fine to the county.",
         "The city granted the restaurant a liquor license after a long hearing.",
         "Copyright law protects authors and their heirs for many years.",
         "The court found that the copyright of the song had run out.",
         "Permission to enter the building is given by the guard.",
         "The public may use the garden free of charge on Sundays.",
         "The general asked the public for patience and the foundation for money.",
         "The software was released last week and people can copy it from the site.",
         "All seats are reserved for the guests and no part of the hall may be used.",
         "The source of the river lies in the hills and the code of the lock is new.",
         "The terms of the contract are subject to the approval of the board.",
         "The university, a common place of work, published a version of the study.",
         "He has the rights to the farm and a license to practise medicine.")
FAMILIES = ["none", *sorted(TEMPLATES), "unknown"]
UNKNOWN = len(FAMILIES) - 1


def words_of(line: bytes) -> list[bytes]:
    return WORD.findall(line.lower())


TWO, THREE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def grams(words: list[bytes]) -> np.ndarray:
    """Hash cells of the one- to three-word n-grams."""
    h = WordHash().of(words)
    out = [h]
    if len(h) > 1:
        two = h[:-1] * TWO + h[1:]
        out.append(two)
        if len(h) > 2:
            out.append(two[:-1] * THREE + h[2:])
    return _cell(np.concatenate(out))


def _cell(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64)


class Model:
    """Weights (cells x families), temperature and least confidence."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, heat: float = 1.0, least: float = 0.5, odd: float = 0.5):
        self.weights, self.bias, self.heat, self.least, self.odd = weights, bias, heat, least, odd

    def logits(self, cells: list[np.ndarray]) -> np.ndarray:
        size = np.array([len(c) for c in cells])
        out = np.tile(self.bias, (len(cells), 1))
        some = np.flatnonzero(size)
        if len(some):
            first = np.cumsum(size[some]) - size[some]
            s = np.add.reduceat(self.weights[np.concatenate([cells[k] for k in some])], first, axis=0)
            out[some] += s / np.sqrt(size[some])[:, None]
        return out

    def chances(self, cells: list[np.ndarray]) -> np.ndarray:
        return self._softmax(self.logits(cells))

    def _softmax(self, z: np.ndarray) -> np.ndarray:
        z = np.exp((z - z.max(1, keepdims=True)) / self.heat)
        return z / z.sum(1, keepdims=True)

    def window_chances(self, h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Chances of the pieces ``h[lo:hi]`` (one word and more each) of a row of word hashes, by running sums."""
        n, k = len(h), len(self.bias)
        one, two, three = (np.zeros((n + 1, k)) for _ in range(3))
        pairs = h[:-1] * TWO + h[1:]
        for total, g in ((one, h), (two, pairs), (three, pairs[:-1] * THREE + h[2:])):
            np.cumsum(self.weights[_cell(g)], axis=0, dtype=np.float64, out=total[1:len(g) + 1])
            total[len(g) + 1:] = total[len(g)]
        start = one + two + three
        end = one
        end[1:] += two[:-1]
        end[2:] += three[:-2]
        z = end[hi] - start[lo]
        single = np.flatnonzero(hi - lo == 1)
        z[single] += three[lo[single]] - np.where((lo[single] > 0)[:, None], three[lo[single] - 1], 0.0)
        size = hi - lo
        size = size + np.maximum(size - 1, 0) + np.maximum(size - 2, 0)
        return self._softmax(z / np.sqrt(size)[:, None] + self.bias)


def _variants(rng: np.random.Generator, fillers: list[list[bytes]]) -> list[tuple[list[bytes], str]]:
    rows = []
    for family, texts in TEMPLATES.items():
        for t in texts:
            w = words_of(t.encode())
            rows += [(w, family)] * 6
            for _ in range(24):
                kept = [x for x in w if rng.random() > 0.06]
                if fillers and rng.random() < 0.5:
                    filler = fillers[int(rng.integers(len(fillers)))][:12]
                    kept = filler + kept if rng.random() < 0.5 else kept + filler
                rows.append((kept, family))
            if not fillers:
                continue
            for _ in range(12):  # a licence of another name
                other = [x if x not in _NAMES[family] else _some(rng, fillers) for x in w]
                if other != w and len(other) > 2:
                    rows.append((other, "unknown"))
    for lead in UNNAMED:
        for _ in range(24 * bool(fillers)):
            name = [_some(rng, fillers) for _ in range(int(rng.integers(1, 4)))]
            rows.append(([y for x in words_of(lead.encode()) for y in (name if x == b"x" else [x])], "unknown"))
    return rows


def _some(rng: np.random.Generator, fillers: list[list[bytes]]) -> bytes:
    line = fillers[int(rng.integers(len(fillers)))]
    return line[int(rng.integers(len(line)))]


#: Notices that name any licence X.
UNNAMED = ("Licensed under the X License.", "Licensed under the X Licence", "Released under the X License, version 2.",
           "This work is licensed under the terms of the X license.", "SPDX-License-Identifier: X",
           "Distributed under the X public license", "Distributed under the terms of the X License",
           "Available under the X Software License, see the file LICENSE.", "This file is covered by the X license")


def train(rows: list[tuple[list[bytes], str]], steps: int = 300) -> Model:
    """Softmax regression by gradient steps (weights decay); then temperature and confidence on rows set aside."""
    number = {f: k for k, f in enumerate(FAMILIES)}
    cells = [grams(w) for w, _ in rows]
    y = np.array([number[f] for _, f in rows])
    aside = np.arange(len(rows)) % 4 == 3
    fit_rows = np.flatnonzero(~aside)
    p = np.repeat(np.arange(len(fit_rows)), [len(cells[k]) for k in fit_rows])
    c = np.concatenate([cells[k] for k in fit_rows])
    v = (1 / np.sqrt(np.maximum(1, np.bincount(p, minlength=len(fit_rows)))))[p][:, None].astype(np.float32)
    used, c = np.unique(c, return_inverse=True)
    first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    by = np.argsort(c, kind="stable")
    start = np.flatnonzero(np.append(True, np.diff(c[by]) > 0))
    k = len(FAMILIES)
    w, b = np.zeros((len(used), k), np.float32), np.zeros(k, np.float32)
    hot = np.eye(k, dtype=np.float32)[y[fit_rows]]
    weight = (len(fit_rows) / (k * np.maximum(1, hot.sum(0)))).astype(np.float32)[y[fit_rows]][:, None]
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        z = np.tile(b, (len(fit_rows), 1))
        z[p[first]] += np.add.reduceat(w[c] * v, first, axis=0)
        z = np.exp(z - z.max(1, keepdims=True))
        g = (z / z.sum(1, keepdims=True) - hot) * weight / len(fit_rows)
        gw = np.add.reduceat((g[p] * v)[by], start, axis=0) + 1e-6 * w
        speed_w, speed_b = 0.9 * speed_w - 3.0 * gw, 0.9 * speed_b - 3.0 * g.sum(0)
        w, b = w + speed_w, b + speed_b
    full = np.zeros((1 << BITS, k))
    full[used] = w
    model = Model(full.astype(np.float32), b.astype(np.float32))
    rest = np.flatnonzero(aside)
    if len(rest):
        own, truth = [cells[i] for i in rest], y[rest]
        heats = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0]

        def loss(heat: float) -> float:
            model.heat = heat
            return -np.log(model.chances(own)[np.arange(len(rest)), truth] + 1e-12).mean()

        model.heat = min(heats, key=loss)
        chance = model.chances(own)
        guess, top = chance.argmax(1), chance.max(1)
        odd = np.minimum(1 - chance[:, 0], 1 - model.chances([np.unique(c) for c in own])[:, 0])[truth == 0]
        model.odd = float(np.clip(np.nextafter(odd.max(initial=0.0), 2), SURE, 0.9999))
        for least in np.linspace(0.5, 0.95, 10):
            model.least = float(least)
            sure = (top >= least) & (guess > 0) & (guess < UNKNOWN)
            if not sure.any() or (guess != truth)[sure].mean() <= WRONG:
                break
    return model


def confirmed(words: list[bytes], family: str) -> float:
    """The largest share of a template's distinct words that a paragraph has."""
    own = set(words)
    return max(len(own & t) / len(t) for t in _TEMPLATE_WORDS[family])


_TEMPLATE_WORDS = {f: [frozenset(words_of(t.encode())) for t in ts] for f, ts in TEMPLATES.items()}
#: Words of a family's templates that stand in few other families': its names.
_NAMES = {f: {w for t in ts for w in t if sum(any(w in x for x in other) for other in _TEMPLATE_WORDS.values()) < 3}
          for f, ts in _TEMPLATE_WORDS.items()}


def fit(docs: DataFrame, other: tuple[str, ...] = OTHER) -> Model:
    """The classifier; "none" rows come from the ``docs(id, text)`` with the smallest hashes of their ids."""
    keyed = docs.where("text is not null").select(F.xxhash64("id").alias("h"), F.xxhash64("text").alias("t"), "text")
    keys = keyed.select("h", "t").orderBy("h", "t").limit(NEGATIVES // 4).collect()  # hashes alone, no texts
    named = docs.sparkSession.createDataFrame([(k["h"], k["t"]) for k in keys], "h long, t long").distinct()
    first = F.transform(F.slice(F.filter(F.split("text", "\n"), lambda x: F.length(x) > 20), 1, LINES),
                        lambda x: F.array_join(F.slice(F.split(x, " "), 1, WORDS), " "))
    # one row a key at most, whatever the number of equal rows
    picked = keyed.join(F.broadcast(named), ["h", "t"]).groupBy("h", "t").agg(F.min(first).alias("p")).orderBy("h", "t")
    lines = [words_of(p.encode())[:WORDS] for r in picked.collect() for p in r["p"]]
    lines = [w for w in lines if w and not MARKS & set(w)][:NEGATIVES]
    joined = [x for w in lines for x in w]
    windows = [joined[k:k + size] for size, stride in WINDOWS for k in range(0, min(len(joined), 40 * NEGATIVES), 10 * stride)]
    rng = np.random.default_rng(9)
    rows = _variants(rng, lines) + [(w, "none") for w in lines + windows if w] + [([], "none")] * 4
    for sentence in other:
        rows += [(words_of(sentence.encode()), "none")] * 8
    for _ in range(400 * bool(lines)):  # a few words, once or again and again: no notice either
        phrase = [_some(rng, lines) for _ in range(int(rng.integers(1, 4)))]
        rows.append((phrase, "none"))
        rows.append(((phrase * 48)[:int(rng.integers(6, 49))], "none"))
    order = rng.permutation(len(rows))
    return train([rows[k] for k in order])


def verdict_of(model: Model, words: list[bytes], chance: np.ndarray) -> tuple[str, float]:
    """Family and confidence of a piece ("none", "unknown" or a family)."""
    k = 1 + int(chance[1:UNKNOWN].argmax())
    if chance[k] == chance.max() and chance[k] >= model.least and confirmed(words, FAMILIES[k]) >= CONFIRM:
        return FAMILIES[k], float(chance[k])
    if 1 - chance[0] >= model.odd:  # and not for a few n-grams said often: by distinct ones as well
        odd = 1 - max(float(chance[0]), float(model.chances([np.unique(grams(words))])[0, 0]))
        if odd >= model.odd:
            return "unknown", odd
    return "none", float(chance[0])


def judge(model: Model, pieces: list[list[bytes]]) -> list[tuple[str, float]]:
    """Family and confidence of each piece of words."""
    return [verdict_of(model, w, c) for w, c in zip(pieces, model.chances([grams(w) for w in pieces]), strict=True)]


def paragraphs(text: bytes) -> list[list[list[bytes]]]:
    """Runs of lines with words, each line as its words."""
    out: list[list[list[bytes]]] = [[]]
    for line in text.split(b"\n"):
        words = words_of(line)
        if words:
            out[-1].append(words)
        elif out[-1]:
            out.append([])
    return out if out[-1] else out[:-1]


def pieces(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines and windows of a paragraph with lines of these lengths."""
    ends = np.cumsum(lengths)
    total = int(ends[-1])
    short = np.asarray(lengths) <= LINE_WORDS
    lo, hi = [(ends - lengths)[short]], [ends[short]]
    for size, stride in WINDOWS:
        if len(lengths) > 1 or total > size:
            k = np.arange(0, max(1, total - size + stride), stride)
            lo.append(k)
            hi.append(np.minimum(k + size, total))
    return np.concatenate(lo), np.concatenate(hi)


def verdict(found: list[tuple[int, int, list[bytes], str, float]]) -> tuple[dict[str, float], bool]:
    """Families of a paragraph with their confidences, and whether it is unknown, from its pieces that are not none."""
    best = sorted((-confirmed(w, f), k, lo, hi, f, p) for k, (lo, hi, w, f, p) in enumerate(found) if f != "unknown")
    taken: list[tuple[int, int, str]] = []
    families: dict[str, float] = {}
    for _, _, lo, hi, f, p in best:
        if all(f == g or hi <= a or b <= lo for a, b, g in taken):
            taken.append((lo, hi, f))
            families[f] = max(p, families.get(f, 0.0))
    return families, not families and bool(found)


def judge_paragraphs(model: Model, held: list[list[list[bytes]]], hashes: WordHash) -> list[tuple[dict[str, float], bool]]:
    """:func:`verdict` of each paragraph; all their pieces are judged, a stretch of words at a time."""
    flat = [[w for line in x for w in line] for x in held]
    found: list[list] = [[] for _ in held]
    stretch: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def look():
        if not stretch:
            return
        runs_ = [flat[i][at:at + STRETCH + LINE_WORDS] for i, at, _, _ in stretch]
        base = np.cumsum([0, *map(len, runs_)])
        h = hashes.of([w for r in runs_ for w in r])
        lo = np.concatenate([x - at + b for (_, at, x, _), b in zip(stretch, base, strict=False)])
        hi = np.concatenate([x - at + b for (_, at, _, x), b in zip(stretch, base, strict=False)])
        who = np.repeat(np.arange(len(stretch)), [len(x) for _, _, x, _ in stretch])
        chance = model.window_chances(h, lo, hi)
        for k in np.flatnonzero((chance.argmax(1) > 0) | (1 - chance[:, 0] >= model.odd)).tolist():
            i, at, _, _ = stretch[who[k]]
            a, z = (int(x) - int(base[who[k]]) + at for x in (lo[k], hi[k]))
            f, p = verdict_of(model, flat[i][a:z], chance[k])
            if f != "none":
                found[i].append((a, z, flat[i][a:z], f, p))
        stretch.clear()

    size = 0
    for i, lines in enumerate(held):
        lo, hi = pieces([len(x) for x in lines])
        for at in range(0, len(flat[i]), STRETCH):
            own = (lo >= at) & (lo < at + STRETCH) if len(flat[i]) > STRETCH else slice(None)
            stretch.append((i, at, lo[own], hi[own]))
            size += min(STRETCH, len(flat[i]) - at)
            if size >= STRETCH:
                look()
                size = 0
    look()
    return [verdict(x) for x in found]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, families, n_paragraphs, n_unknown, confidence)`` per row; confidence: of the surest family."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(own))
    schema = pa.schema([("id", pa.int64()), ("families", pa.list_(pa.string())), ("n_paragraphs", pa.int64()),
                        ("n_unknown", pa.int64()), ("confidence", pa.float64())])

    def read(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in raw(b.column(1))]
        families, n, unknown, sure = [], [], [], []
        hashes = WordHash(limit=300_000)
        for at in range(0, len(texts), 64):
            part = [paragraphs(t) for t in texts[at:at + 64]]
            said = iter(judge_paragraphs(shared.value, [x for doc in part for x in doc], hashes))
            for doc in part:
                own_families: dict[str, float] = {}
                own_unknown = 0
                for _ in doc:
                    got, odd = next(said)
                    own_unknown += odd
                    for f, p in got.items():
                        own_families[f] = max(p, own_families.get(f, 0.0))
                families.append(sorted(own_families))
                n.append(len(doc))
                unknown.append(own_unknown)
                sure.append(max(own_families.values(), default=0.0))
        return as_batch({"id": b.column(0), "families": families, "n_paragraphs": n, "n_unknown": unknown,
                         "confidence": sure}, schema)

    out = map_batches(own, read, "id long, families array<string>, n_paragraphs long, n_unknown long, confidence double")
    return out.withColumnRenamed("id", id_col)
