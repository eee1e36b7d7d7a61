"""Importance resampling against a brute-force version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillon.llm import resampling

from .conftest import ODD

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]).encode() for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(rows, target, share=25, seed=7, longest=2, buckets=10_000, least=20):
    bucket = lambda f: zlib.crc32(f) % buckets
    own = [features(t, longest) for _, t in rows]
    s = Counter(bucket(f) for _, fs in own for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text, longest)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in s}
    out = []
    for (i, text), (words, fs) in zip(rows, own, strict=True):
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words), text])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], (r[0] is not None, r[0] or 0), r[1]))
    for n, r in enumerate(able[: share * len(able) // 100], 1):
        r[4] = n
    return out


def corpus(n, seed):
    draw = random.Random(seed)
    vocabulary = ["The", "cat", "naïve", "x1", "é", "b" * 70, "日本", "a_b", "it's", *(f"w{k}" for k in range(50))]
    return [(k, draw.choice([" ", "\n", " - "]).join(draw.choice(vocabulary) for _ in range(draw.choice([0, 1, 2, 19, 20, 21, 60])))) for k in range(n)]


@pytest.mark.parametrize(("longest", "buckets", "share"), [(2, 10_000, 25), (1, 50, 60), (4, 997, 33)])
def test_resample_against_brute_force(spark, longest, buckets, share):
    rows, target = corpus(300, 1), [t for _, t in corpus(20, 2)] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    benchmark = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, benchmark, share=share, longest=longest, buckets=buckets).collect()
    want = plain(rows, target, share=share, longest=longest, buckets=buckets)
    assert sorted(map(tuple, got)) == sorted(tuple(r[:5]) for r in want)
    assert any(r[4] for r in want) and any(r[4] is None for r in want)


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_hashes_of_cut_blocks(monkeypatch, size):
    """However small the blocks are, each occurrence of an n-gram is hashed once."""
    monkeypatch.setattr(resampling, "BLOCK", size)
    texts = [t or "" for _, t in corpus(60, 3)] + ["   ", "--", "x" * 500 + " y z"]
    for longest in (1, 2, 3, 5):
        got = [Counter() for _ in texts]
        for block in resampling.blocks((t.encode() for t in texts), longest):
            for crc, new, sizes in block.hashes():
                for c, row in zip(crc[new].tolist(), np.repeat(block.rows, sizes)[new].tolist(), strict=True):
                    got[row][c] += 1
        assert got == [Counter(map(zlib.crc32, features(t, longest)[1])) for t in texts]


def test_suffix_order_sorts_to_the_depth():
    draw = random.Random(5)
    for depth in (1, 2, 3, 4, 7):
        sizes = [draw.randrange(1, 9) for _ in range(40)]
        pieces = [[draw.randrange(1, 4) for _ in range(n)] for n in sizes]
        left = np.concatenate([np.arange(n, 0, -1) for n in sizes])
        order = resampling.suffix_order(np.concatenate(pieces), left, depth)
        suffixes = [p[k:][:depth] for p in pieces for k in range(len(p))]
        assert [suffixes[k] for k in order.tolist()] == sorted(suffixes)


def test_checksums_extend():
    draw = random.Random(6)
    texts = [draw.randbytes(draw.randrange(40)) for _ in range(200)]
    tails = [draw.randbytes(draw.randrange(1, resampling.REACH + 1)) for _ in range(200)]
    as_array = lambda xs: np.array(list(xs), np.int64)
    got = resampling.extended(as_array(map(zlib.crc32, texts)), as_array(map(len, tails)), as_array(map(zlib.crc32, tails)))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(texts, tails, strict=True)]


def test_odd_documents(spark, odd, lettered, none):
    target = spark.createDataFrame([("hello there word",), (None,)], "text string")
    got = resampling.resample(odd, target, share=60, least_words=1).collect()
    want = plain(ODD, ["hello there word"], share=60, least=1)
    assert sorted(map(tuple, got), key=repr) == sorted((tuple(r[:5]) for r in want), key=repr)
    assert resampling.resample(lettered, target).count() == len(ODD)
    assert resampling.resample(none, target).count() == 0
    assert resampling.resample(odd, target.where("false")).count() == len(ODD)  # no target: no gain of one over another but by how common it is


def test_drawn_documents_keep_their_columns(spark, odd):
    target = spark.createDataFrame([("word word",)], "text string")
    drawn = resampling.drawn_documents(odd, target, share=50, least_words=1)
    assert drawn.columns == odd.columns
    want = [r[0] for r in plain(ODD, ["word word"], share=50, least=1) if r[4]]
    assert {r.doc_id for r in drawn.collect()} == set(want)
