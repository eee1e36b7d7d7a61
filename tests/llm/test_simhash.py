"""SimHash groups against a brute-force version, with and without full buckets."""

from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import common, simhash

from .conftest import ODD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, size=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lowered)
    if not words:
        return 0
    parts = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, distance):
    left, out = set(range(len(values))), [0] * len(values)
    while left:
        todo = [min(left)]
        root = todo[0]
        left.discard(root)
        while todo:
            x = todo.pop()
            out[x] = root
            new = {y for y in left if (values[x] ^ values[y]).bit_count() <= distance}
            left -= new
            todo += new
    return out


def plain_groups(rows, size=3, distance=2):
    values = [plain_fingerprint(t, size) for _, t in rows]
    roots = plain_components(values, distance)
    least = {r: min((i for (i, _), o in zip(rows, roots, strict=True) if o == r and i is not None), default=None) for r in set(roots)}
    return sorted(((i, f"{v:016x}", least[r]) for (i, _), v, r in zip(rows, values, roots, strict=True)), key=repr)


def corpus(n, seed):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        if rows and draw.random() < 0.7:
            words = draw.choice(rows)[1].split()
            if words:
                words[draw.randrange(len(words))] = draw.choice(["Alpha", "beta", "γάμμα"])
        else:
            words = [f"w{draw.randrange(300)}" for _ in range(draw.choice([0, 1, 2, 3, 4, 60, 400]))]
        rows.append((k * 7 % 1000, draw.choice([" ", "\n", "\t "]).join(words)))
    return rows


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 1])
def test_groups_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash.links, "__defaults__", (2, bucket))
    rows = corpus(250, 3) + [(5000, None), (5001, ""), (5002, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, simhash.simhash_groups(docs).collect()), key=repr)
    want = plain_groups(rows)
    assert got == want
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want})  # some fingerprints differ and are linked


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("bucket", [1, 20, 1000])
def test_links_of_full_buckets(spark, distance, bucket):
    draw = random.Random(distance)
    values = {0, 2**64 - 1, 1 << 63}
    while len(values) < 400:  # chains and stars of few bits, and values of their own
        v = draw.choice(sorted(values)) if draw.random() < 0.8 else draw.getrandbits(64)
        for _ in range(draw.choice([1, 2, 3, 4])):
            v ^= 1 << draw.randrange(64)
        values.add(v)
    values = sorted(values)
    prints = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "print long").repartition(3)
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    place = {v: n for n, v in enumerate(values)}
    for a, b in simhash.links(prints, distance, bucket).collect():
        a, b = a % 2**64, b % 2**64
        assert 0 < (a ^ b).bit_count() <= distance
        root[find(place[a])] = find(place[b])
    want = plain_components(values, distance)
    names = {}
    assert all(names.setdefault(find(n), want[n]) == want[n] for n in range(len(values)))
    assert len({find(n) for n in range(len(values))}) == len(set(want))


def test_buckets_stay_whole_whatever_the_join(spark):
    """The join that drops lone fingerprints begins as a shuffle and turns out small enough to be sent: buckets are still not split."""
    draw = random.Random(4)
    alone, linked = [draw.getrandbits(63) for _ in range(8000)], [draw.getrandbits(63) for _ in range(500)]
    values = [*linked, *alone, *(v ^ 3 for v in linked)]  # the two of a link lie in different partitions
    prints = spark.createDataFrame(spark.sparkContext.parallelize([(v,) for v in values], 8), "print long")
    plan = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "256k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in plan.items():
        spark.conf.set(key, value)
    try:
        found = {frozenset(r) for r in simhash.links(prints, 2).collect()}
    finally:
        for key in plan:
            spark.conf.unset(key)
    assert found == {frozenset((v, v ^ 3)) for v in linked}


def test_a_full_bucket_meets_in_bounded_groups(spark):
    """2000 fingerprints that share half of their bits: no value has more than 65 of them about it, and rows grow as the bucket."""
    draw = random.Random(1)
    values = sorted({draw.getrandbits(32) for _ in range(2000)})
    prints = spark.createDataFrame([(v,) for v in values], "print long")
    found = {tuple(sorted(r)) for r in simhash._midpoint_links(prints, 2).collect()}
    assert len(found) < 65 * len(values)
    assert all((a ^ b).bit_count() <= 2 for a, b in found)


def test_fingerprints_of_odd_and_long_texts(monkeypatch):
    monkeypatch.setattr(common, "PIECE", 50)
    monkeypatch.setattr(simhash, "STEP", 7)
    draw = random.Random(2)
    texts = [t for _, t in ODD if t and len(t) < 1000] + ["", "a", "A b", "a\u00a0b c", "x" * 300 + " y", "y " + "x" * 300 + " z z"]
    texts += [" ".join(draw.choice(["a", "Bb", "x" * 70, "é"]) for _ in range(draw.randrange(60))) for _ in range(80)]
    for t in texts:
        for size in (1, 2, 3, 5):
            assert simhash.fingerprint(t.encode(), size) == plain_fingerprint(t, size), (t, size)


def test_odd_documents(odd, lettered, none):
    got = sorted(map(tuple, simhash.simhash_groups(odd).collect()), key=repr)
    assert got == plain_groups(ODD)
    as_text = [(None if i is None else f"d{i:03d}", t) for i, t in ODD]
    assert sorted(map(tuple, simhash.simhash_groups(lettered).collect()), key=repr) == plain_groups(as_text)
    assert simhash.simhash_groups(none).count() == 0


def test_distance_is_checked(odd):
    with pytest.raises(ValueError, match="distance"):
        simhash.simhash_groups(odd, distance=3)


def test_hash_is_the_engine_s(spark):
    """XXH64 with seed 42 is what xxhash64() gives for one text."""
    texts = ["", "a b c", "ünï code", "x" * 100]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert all(r.h % 2**64 == xxhash.xxh64_intdigest(r.t.encode(), 42) for r in rows)
