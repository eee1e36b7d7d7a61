from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import fingerprint, neardup
from quillon.llm.components import _with_least as connected_parts
from quillon.llm.components import connected

from .conftest import ODD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, k):
    w = WORDS.findall(lower(t))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def components(rows, k, percent):
    """For each row its set's size and the places of the rows of its component."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in enumerate(sets):
        for b, u in enumerate(sets[:a]):
            common = len(s & u)
            if s and u and 100 * common >= percent * (len(s) + len(u) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    members = defaultdict(list)
    for a in range(len(rows)):
        members[find(a)].append(a)
    return [(len(s), members[find(a)]) for a, s in enumerate(sets)]


def by_brute_force(rows, k, percent):
    """(id, set's size, component_id) of each row; the smallest id of a component is its name, null only if all are."""
    least = lambda places: min((rows[p][0] for p in places if rows[p][0] is not None), default=None)
    return sorted(((i, n, least(places)) for (i, _), (n, places) in zip(rows, components(rows, k, percent), strict=True)), key=repr)


def near_corpus(n=160, seed=4):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n):
        if rows and draw.random() < 0.6:
            words = draw.choice(rows)[1].split()
            for _ in range(draw.choice([0, 1, 2, 3, 5, 8])):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            if draw.random() < 0.3:
                words += [draw.choice(vocabulary)] * draw.choice([1, 2, 10])
        else:
            words = [draw.choice(vocabulary) for _ in range(draw.choice([1, 2, 3, 5, 8, 30, 80, 200]))]
        rows.append((len(rows) * 3, " ".join(words)))
    return rows


@pytest.mark.parametrize(("k", "seed"), [(2, 4), (2, 9), (5, 4)])
def test_near_groups_against_brute_force(spark, k, seed, monkeypatch):
    rows = near_corpus(seed=seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = neardup.near_groups(docs, k, 80).collect()
    assert told(out) == by_brute_force(rows, k, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_blocks_do_not_lose_links(spark, monkeypatch):
    """Clusters and buckets that are cut into small blocks give the same groups."""
    rows = near_corpus(80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("BLOCK", "STEP", "SET_BLOCK", "SET_STEP"):
        monkeypatch.setattr(neardup, name, 1)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 300)
    out = neardup.near_groups(docs, 2, 80).collect()
    assert told(out) == by_brute_force(rows, 2, 80)


@pytest.mark.parametrize("prefix", ["", "d"])
def test_near_groups_of_odd_documents(odd, lettered, none, prefix):
    """Every row has a result, whatever its id is: null, repeated or text."""
    docs = lettered if prefix else odd
    rows = [(None if i is None else f"d{i:03d}" if prefix else i, t) for i, t in ODD]
    assert told(neardup.near_groups(docs, 2, 80).collect()) == by_brute_force(rows, 2, 80)
    assert neardup.near_groups(none).count() == 0
    kept = neardup.drop_near(docs, 2, 80)
    assert kept.columns == docs.columns
    left = Counter(shingle_key(r.text) for r in kept.collect())
    for a, (n, places) in enumerate(components(rows, 2, 80)):
        assert sum(left[key] for key in {shingle_key(rows[p][1]) for p in places}) == (1 if n else left[shingle_key(rows[a][1])])
    assert left[shingle_key("")] == sum(1 for _, t in rows if not WORDS.findall(t or ""))


def shingle_key(t):
    return frozenset(shingles(t, 2))


def told(out):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr)


def test_long_texts_in_one_cluster(spark):
    """A cluster of texts of 40 000 words each, cut into blocks by its shingles."""
    draw = random.Random(3)
    base = [f"w{draw.randrange(10**6)}" for _ in range(40_000)]
    rows = []
    for i in range(8):
        words = list(base)
        for _ in range(100 * i):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    out = neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2, 80).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(i, 0) for i in range(8)}


def test_hubs_are_not_gathered(spark):
    """The links of a star of 100 000 rays stay where they are: no task of the joins gets a large part of them."""
    n = 100_000
    links = spark.range(n, numPartitions=8).select((F.col("id") + 1).alias("a"), F.lit(0).cast("long").alias("b"))
    least = spark.createDataFrame([(0, 0, n)], "a long, m long, n long").unionByName(spark.range(n).select((F.col("id") + 1).alias("a"), F.lit(0).cast("long").alias("m"), F.lit(1).cast("long").alias("n")))
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    met = connected_parts(back, least, 2 * n)
    sizes = [r["count"] for r in met.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == n and max(sizes) <= n // 8
    out = connected(links)
    assert out.where("component = 0").count() == n + 1


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    out = {r.id: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: find(x) for x in out}
    assert {x for a, b in edges if a != b for x in (a, b)} == set(out)


def test_sketch_estimates():
    draw = np.random.RandomState(0)
    for want in (0.95, 0.9, 0.8):
        errors = []
        for _ in range(200):
            common = draw.randint(0, 2**63, int(1000 * want)).astype(np.uint64)
            rest = lambda: draw.randint(0, 2**63, int(1000 * (1 - want) / 2)).astype(np.uint64)
            a, b = (np.unique(np.r_[common, rest()]) for _ in range(2))
            bits = np.bitwise_count(neardup.signature(a)[1] ^ neardup.signature(b)[1]).sum()
            errors.append(neardup.estimated(bits) - want)
        assert abs(np.mean(errors)) < 0.03 and 5 * np.std(errors) < neardup.MARGIN


def edit(rows):
    """(id, text) in descending order of ids, each with its edited text."""
    ordered = sorted(rows, key=lambda r: -r[0])
    for (i, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        h = len(t) // 2
        yield i, t, t[: len(t) - h] + u[:h]


def test_edited_fingerprints(spark):
    rows = [(i, t or "") for i, t in near_corpus(60)] + [(500, ""), (501, "Ünï 👍 x"), (502, "word " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs).collect()}
    assert len(out) == len(rows)
    texts = dict(rows)
    estimates, truths = [], []
    for i, t, edited in edit(rows):
        r = out[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.next_id == (max((k for k in texts if k < i), default=max(texts)))
        assert r.edited_fingerprint == r.fingerprint or t != edited
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        a, b = shingles(t, 5), shingles(edited, 5)
        if len(a | b) > 20:
            estimates.append(r.near_edited)
            truths.append(len(a & b) / len(a | b))
    assert np.abs(np.array(estimates) - np.array(truths)).mean() < 0.05
    assert len({r.fingerprint for r in out.values()}) == len({lower(t) for t in texts.values()})


def split_words(t):
    return re.split(r"[\x20\x09-\x0D]+", (t or "").strip(" \t\n\x0b\x0c\r").lower())


def test_fingerprints_by_brute_force(spark):
    """Bins, minima, densification and packing against plain Python; only the hashes are Spark's."""
    rows = near_corpus(60) + [(i or 0, t) for i, t in ODD]
    word = {r.w: r.h for r in spark.createDataFrame([(w,) for w in sorted({w for _, t in rows for w in split_words(t)})], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    runs = {}
    for _, t in rows:
        hashes = [word[w] for w in split_words(t)]
        runs[t] = [tuple(hashes[k : k + 5]) for k in range(max(1, len(hashes) - 4))]
    every = sorted({x for r in runs.values() for x in r})
    value = {tuple(r.x): r.h for r in spark.createDataFrame([(list(x),) for x in every], "x array<long>").select("x", F.xxhash64("x").alias("h")).collect()}
    docs = spark.createDataFrame(list(enumerate(t for _, t in rows)), "doc_id long, text string")
    full = {}
    for n, (_, t) in enumerate(rows):
        minima = {}
        for h in (value[x] for x in runs[t]):
            b = (h >> 57) + 64
            minima[b] = min(h, minima.get(b, h))
        full[n] = [minima[b] if b in minima else next(minima[j] for j in fingerprint.ORDERS[b] if j in minima) for b in range(fingerprint.BINS)]
    digits = spark.createDataFrame(list(full.items()), "n long, v array<long>").select("n", F.transform("v", lambda v, i: F.xxhash64(v, i)).alias("v"))
    want = {r.n: "".join(f"{h & 15:x}" for h in r.v) for r in digits.collect()}
    assert {r.doc_id: r.fingerprint.lower() for r in fingerprint.fingerprints(docs).collect()} == want


def test_fingerprints_of_odd_documents(odd, lettered, none):
    """A row for every document: null ids come last, rows that repeat an id follow each other."""
    for docs in (odd, lettered):
        out = fingerprint.edited_fingerprints(docs).collect()
        assert sorted(map(repr, (r.doc_id for r in out))) == sorted(map(repr, (r.doc_id for r in docs.collect())))
        assert Counter(r.next_id for r in out) == Counter(r.doc_id for r in out)
    twice = [r for r in fingerprint.edited_fingerprints(odd).collect() if r.doc_id == 9]
    assert {(r.next_id, r.edited_sha256) for r in twice} == {(9, hashlib.sha256(b"a a").hexdigest()), (8, hashlib.sha256(b"a x").hexdigest())}
    assert fingerprint.edited_fingerprints(none).count() == 0
    one = fingerprint.edited_fingerprints(odd.where("doc_id = 6")).first()
    assert one.next_id == 6


def test_likeness(spark):
    draw = random.Random(2)
    pairs = [([draw.getrandbits(64) - 2**63 for _ in range(8)],) * 2 for _ in range(3)] + [tuple([draw.getrandbits(64) - 2**63 for _ in range(8)] for _ in range(2)) for _ in range(5)]
    out = spark.createDataFrame(pairs, "a array<long>, b array<long>").select("a", "b", fingerprint.likeness(F.col("a"), F.col("b")).alias("l")).collect()
    digits = lambda x: "".join(f"{v % 2**64:016x}" for v in x)
    for r in out:
        same = sum(c == d for c, d in zip(digits(r.a), digits(r.b), strict=True)) / 128
        assert r.l == pytest.approx(max(0.0, (same - 1 / 16) / (15 / 16)))
