from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import common, dedup, mixing

from .conftest import ODD


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("hashed", [dedup.content_hash, lambda c: F.lit(b"same")], ids=["hash", "all collide"])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_groups(odd, keep, hashed):
    groups = defaultdict(list)
    for i, t in ODD:
        groups[lower(t)].append(i)
    out = dedup.exact_groups(odd, keep=keep, hashed=hashed).collect()
    assert len(out) == len(ODD)
    want = sorted((i, {"min": min, "max": max}[keep]([x for x in groups[lower(t)] if x is not None]), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in ODD if i is not None)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out if r.doc_id is not None) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out)


def test_empty(none):
    assert dedup.exact_groups(none).count() == 0 and dedup.drop_exact(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_drop_keeps_columns(odd):
    kept = dedup.drop_exact(odd)
    assert kept.columns == odd.columns
    assert sorted(lower(r.text) for r in kept.collect()) == sorted({lower(t) for _, t in ODD})


def test_rows_delivered_twice_stay_once(spark):
    """One row of each group of equal texts, also where rows repeat an id and a text, or have no id at all."""
    rows = [(1, "a"), (1, "a"), (1, "A"), (None, "b"), (None, "b"), (None, "c"), (2, "c"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for keep in ("min", "max"):
        assert sorted(((r.doc_id, lower(r.text)) for r in dedup.drop_exact(docs, keep=keep).collect()), key=repr) == [(1, "a"), (2, "c"), (None, ""), (None, "b")]


def test_repeated_ids_are_judged_by_their_texts(spark):
    docs = spark.createDataFrame([(3, "b"), (5, "a"), (5, "B"), (7, "a")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in dedup.drop_exact(docs).collect()) == [(3, "b"), (5, "a")]


def corpus(spark, n=600):
    draw = random.Random(3)
    rows = [(i, " ".join(["word"] * draw.randrange(0, 60)), draw.choice(["a", "a", "a", "b", None, "c"])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def targets_of(sizes, weights=(1, 2, 3), most=3.0):
    """Shares by weight with caps, the excess shared again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: most * sizes[s] for s in over}


def test_mix(spark):
    docs, rows = corpus(spark)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = targets_of(sizes)
    out = mixing.mix(docs)
    assert sorted(out.collect()) == sorted(mixing.mix(docs.repartition(7)).collect())
    taken = defaultdict(int)
    for r in out.collect():
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        assert r.taken // max(r["size"], 1) in (r.epochs, r.epochs + 1) or r["size"] == 0
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 5 or n == 3 * sizes[s]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(taken.values())


def mix_by_hand(rows, rest, draws):
    """The documents (places in rows) that fill a budget: rounds in the order of keys, then the nearest one."""
    order, taken, gap = sorted(range(len(rows)), key=lambda p: (draws[p], rows[p][0], rows[p][1])), set(), rest
    for _ in range(mixing.ROUNDS):
        upto, now = 0, []
        for p in order:
            if p in taken or rows[p][1] > gap:
                continue
            upto += rows[p][1]
            if upto > gap:
                break
            now.append(p)
        taken.update(now)
        gap -= sum(rows[p][1] for p in now)
    near = [(abs(gap - rows[p][1]), draws[p], rows[p][0], p) for p in order if p not in taken and rows[p][1] > 0 and abs(gap - rows[p][1]) < gap]
    return taken | ({min(near)[3]} if near else set())


@pytest.mark.parametrize("slice_", [5_000, 20])
def test_budgets_by_hand(spark, monkeypatch, slice_):
    """Sources with a few very long documents: the budget is filled in rounds, whatever the slices are."""
    monkeypatch.setattr(mixing, "SLICE", slice_)
    draw = random.Random(7)
    rows = [(i, " ".join(["word"] * draw.choice([0, 1, 5, 30, 60, 2000 if i % 50 == 0 else 9])), draw.choice("abbc")) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    draws = {r.doc_id: r.e for r in mixing._keyed(docs, "doc_id", "text", "source", None, "", []).select(F.col("_id").alias("doc_id"), F.col("_e").alias("e")).collect()}
    out = {r.doc_id: r for r in mixing.mix(docs).collect()}
    for s in "abc":
        own = [(i, len(t.split())) for i, t, x in rows if x == s]
        first = out[own[0][0]]
        epochs = int(first.target // first.source_size)
        extra = mix_by_hand(own, first.target - epochs * first.source_size, [draws[i] for i, _ in own])
        assert all(out[i].taken == n * (epochs + (p in extra)) for p, (i, n) in enumerate(own))
        assert abs(sum(out[i].taken for i, _ in own) - first.target) <= 5


def test_slices_are_slices_at_any_weight(spark):
    """Slices of a source have a bounded number of documents where all weights are 1/4 or a millionth."""
    for weight in (0.25, 1e-6):
        e = spark.range(200_000).select((-F.log(mixing.uniform(F.col("id"))) / weight).alias("_e"))
        sizes = [r["count"] for r in e.groupBy(mixing._slice(F.lit(200_000)).alias("k")).count().collect()]
        assert max(sizes) < 1.2 * mixing.SLICE and len(sizes) < 20 * 200_000 / mixing.SLICE


def test_mix_of_odd_documents(odd, lettered):
    for docs in (odd, lettered):
        out = mixing.mix(docs).collect()
        assert len(out) == len(ODD)
        assert {r.taken for r in out if r["size"] == 0} == {0}
        mixed = mixing.mixed_documents(docs)
        assert mixed.columns == docs.columns
        assert mixed.select(F.sum(mixing.word_count(F.coalesce("text", F.lit(""))))).first()[0] == sum(r.taken for r in out)


def test_many_sources(spark, monkeypatch):
    """A plan of more sources than are broadcast is joined by a shuffle, with the same result."""
    docs, _ = corpus(spark)
    want = sorted(mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "SOURCES", 1)
    assert sorted(mixing.mix(docs).collect()) == want


def test_weighted_documents_come_first(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.when(F.col("id") % 4 < 2, 9.0).otherwise(1.0).alias("w"))
    out = mixing.mix(docs, weights=(1, 3), weight_col="w").where("source = 'a'").join(docs, "doc_id").groupBy("w").agg(F.sum(F.when(F.col("taken") > 0, 1).otherwise(0)).alias("n")).collect()
    n = {r.w: r.n for r in out}
    assert n[9.0] > 2 * n[1.0] > 0


def test_quality_weights(spark):
    texts = ["plain words of prose go here", "a b c d e f", "9999 $$$$ #### 1234", "", "x" * 500, "mostly words 1 2"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mixing.quality_weight(F.col("t"), mixing.word_count(F.col("t"))).alias("w")).collect()
    w = {r.t: r.w for r in rows}
    assert w[texts[0]] == 1.0 and w[texts[1]] == 0.25 and w[texts[2]] == 1 / 64 and w[""] == 0.25 and w[texts[4]] == 0.25
    assert w[texts[5]] == pytest.approx((1 - 4 * 2 / 16) ** 2)


@pytest.mark.parametrize("n", [0, 1, 5_000])
def test_key_filter(spark, n):
    """Every key passes, few others do, and rows are told apart by id and text whatever the id is."""
    keys = spark.range(n).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2"))
    maybe, count = common.key_filter(keys)
    assert count == n and keys.where(~maybe).count() == 0
    others = spark.range(100_000, 120_000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2"))
    assert others.where(maybe).count() < 0.02 * 20_000


def test_rows_are_dropped_by_id_and_text(spark):
    docs = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "a", 3), (None, None, 4), (2, "", 5), (1, "a", 6)], "doc_id long, text string, n int")
    gone = docs.where("n IN (1, 4)").select(*common.row_key(docs, "doc_id", "text")).distinct()
    assert sorted(r.n for r in common.without(docs, common.cut(gone), "doc_id", "text").collect()) == [2, 3, 5]
