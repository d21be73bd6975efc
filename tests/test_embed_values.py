"""The built-in embedder's values, term by term."""

import re
from collections import Counter

import numpy as np

from semweave.operators.embed import hashing_embedder
from tests.conftest import SF01

M = 0xFFFFFFFF


def murmur3(data: bytes, seed: int) -> int:
    """32-bit murmur3 as a signed number."""
    def turn(x, r):
        return (x << r | x >> (32 - r)) & M

    h, whole = seed, len(data) // 4 * 4
    for i in range(0, whole, 4):
        k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & M
        h = (turn(h ^ turn(k, 15) * 0x1B873593 & M, 13) * 5 + 0xE6546B64) & M
    if data[whole:]:
        k = int.from_bytes(data[whole:], "little") * 0xCC9E2D51 & M
        h ^= turn(k, 15) * 0x1B873593 & M
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & M
    h = (h ^ h >> 13) * 0xC2B2AE35 & M
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_values_are_hashed_counts_of_unit_length(spark):
    texts = spark.read.parquet(f"{SF01}/documents.parquet").selectExpr("doc_id AS paper_id", "text AS abstract")
    texts = texts.unionByName(spark.createDataFrame(
        [(-1, ""), (-2, "Ünïcode WORDS, words; naïve_x 12"), (-3, "a ab abc abcd abcde")], "paper_id long, abstract string"))
    for dim in (512, 37):
        got = {r[0]: np.array(r[1], np.float32) for r in hashing_embedder(texts, dim=dim).select("paper_id", "embedding").collect()}
        for r in texts.collect():
            v = np.zeros(dim)
            for w, n in Counter(re.findall(r"\w+", r["abstract"].lower())).items():
                v[murmur3(w.encode(), 42) % dim] += n
            size = np.sqrt((v * v).sum())
            assert np.allclose(got[r["paper_id"]], v / size if size else v, atol=1e-6), r["paper_id"]
