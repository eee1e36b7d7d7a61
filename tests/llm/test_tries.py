"""Prefix tries of conversations against a brute-force version."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def remainder(c, n):
    return c - n * int(c / n)


def plain(rows, family=5, heads=9):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(("" if c is None else str(c)).encode()) % heads
        base = own.get(c - remainder(c, family), []) if c is not None else []
        whole[c] = (*base[:h], *turns[h:]) if c is not None else tuple(turns)
    order = lambda c: (c is not None, c or 0)
    members = defaultdict(list)
    for c in sorted(whole, key=order):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    below = {}
    for path in sorted(members, key=len, reverse=True):
        leaves = sum(below[k][0] for k in children[path]) or 1
        saved = sum(below[k][1] for k in children[path]) + ((len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0)
        below[path] = leaves, saved
    out = []
    for path, ms in members.items():
        ends = ",".join("" if c is None else str(c) for c in ms if len(whole[c]) == len(path))
        out.append((ms[0], len(path), members[path[:-1]][0] if path else None, len(ms), len(children[path]), *below[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(n, seed, longest=9, texts=3):
    """Conversations of few different turns, so that many share how they begin; ids with gaps, some below zero."""
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-n, 2 * n), n):
        for k in range(draw.randrange(1, longest + 1)):
            rows.append((c, k if draw.random() < 0.98 or k else None, draw.choice(["user", "user", None]), draw.choice(["", None, "é", "x" * 40, *(f"t{i}" for i in range(texts))]) if k else "hi"))
    return [(c, k * 2, r, t) if k is not None else (c, k, r, t) for c, k, r, t in rows]


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(map(tuple, tries.prefix_trie(frame, **options).collect()), key=repr)


@pytest.mark.parametrize(("family", "heads", "longest"), [(5, 9, 9), (3, 4, 3), (7, 1, 5)])
def test_trie_against_brute_force(spark, family, heads, longest):
    rows = corpus(120, family, longest)
    got = run(spark, rows, family=family, heads=heads)
    assert got == plain(rows, family, heads)


def test_long_shared_beginnings_and_copies(spark, monkeypatch):
    monkeypatch.setattr(tries, "WIDTH", 4)
    monkeypatch.setattr(tries, "SLICE", 3)
    monkeypatch.setattr(tries, "PIECE", 32)  # ids are joined two by two
    rows = []
    for c in range(0, 60):
        length = 23 if c % 3 else 40
        rows += [(c, k, "user", f"t{k}" if k < 20 or c % 3 == 0 else f"own {c // 20}") for k in range(length)]
    assert run(spark, rows, heads=1) == plain(rows, heads=1)
    assert run(spark, rows) == plain(rows)


def test_empty_and_single_and_null(spark):
    assert run(spark, []) == []
    one = [(7, 0, "user", "a"), (7, 1, None, None)]
    assert run(spark, one) == plain(one)
    copies = [(c, k, "user", f"é{k}") for c in range(40) for k in range(3)]
    assert run(spark, copies) == plain(copies)
    turnless = [(4, 0, "user", "a")]  # its head would be that of a conversation that is not there
    assert run(spark, turnless) == plain(turnless)
    odd = [*one, (None, None, None, None), (None, 1, "user", "a"), (8, 1, "user", "a"), (8, 1, "user", "a"), (9, None, "", ""), (9, 5, "user", "x" * 100_000)]
    assert run(spark, odd) == plain(odd)


def test_a_conversation_of_many_ranges_is_numbered_by_several_tasks(spark):
    rows = [(1, k, "user", f"turn {k}") for k in range(4000)] + [(2, k, "user", "x") for k in range(100)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = tries.ordered(frame)
        got = sorted((r.c, r.pos, r.upto) for r in numbered.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, upto = [], 0
    for k in range(4000):
        upto += len(f"turn {k}")
        want.append((1, k + 1, upto))
    assert got == want + [(2, k + 1, k + 1) for k in range(100)]


def test_hash_of_many_ids_is_that_of_their_list(spark, monkeypatch):
    monkeypatch.setattr(tries, "PIECE", 160)
    members = spark.range(1000).select((F.col("id") % 3).alias("n"), F.when(F.col("id") > 500, 1).otherwise(0).cast("long").alias("d1"), F.col("id").alias("c")).repartition(7)
    got = {(r.n, r.d1): r.ends for r in tries.end_hashes(members, ["n", "d1"]).collect()}
    groups = defaultdict(list)
    for i in range(1000):
        groups[(i % 3, int(i > 500))].append(str(i))
    assert got == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in groups.items()}


def test_clashing_columns(spark):
    rows = corpus(20, 8)
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("c", "pos", "bytes", "x1", "x2", "place", "rep", "depth", "n", "h", "head", "upto", "part"):
        frame = frame.withColumn(name, F.lit("z"))
    assert sorted(map(tuple, tries.prefix_trie(frame).collect()), key=repr) == plain(rows)
