from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing, quality, toxicity

from .conftest import ODD

SF = "/root/testdata/sf0.01"


def joined(spark, out, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return out.join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(label).alias("label")).toPandas()


def auc(g):
    good, bad = g.score[g.label == 1].to_numpy(), g.score[g.label == 0].to_numpy()
    return ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2) if len(good) and len(bad) else 1.0


@pytest.mark.parametrize(("operator", "label"), [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_held_out_accuracy(spark, operator, label):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = operator(docs, labels)
    assert out.count() == docs.count() and out.where("score NOT BETWEEN 0 AND 1 OR score IS NULL").count() == 0
    g = joined(spark, out, label)
    assert (g.predicted == g.label).mean() > 0.9 and auc(g) > 0.85
    for r in out.select("doc_id", "held_out").limit(200).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


@pytest.mark.parametrize(("operator", "label"), [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_odd_documents(spark, odd, none, operator, label):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (5, 1), (6, 0), (6, 1), (7, 1), (9, 0), (11, 1), (99, 1)], f"doc_id long, {label} int")
    out = operator(odd, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
    scores = {}
    for r in out:
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert scores[2] == scores[3]
    assert len(operator(odd, labels.where("false")).collect()) == len(ODD)
    assert operator(none, labels).count() == 0


@pytest.mark.parametrize(("operator", "label"), [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_labels_of_held_out_documents_are_not_learned_from(spark, operator, label):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn(label, F.when(quality.held_out(F.col("doc_id")), 1 - F.col(label)).otherwise(F.col(label)))
    some = docs.where("doc_id < 200")
    a, b = ({r.doc_id: r.score for r in operator(some, x).collect()} for x in (labels, turned))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)


def test_keep_good(spark, odd):
    labels = spark.createDataFrame([(i, 1) for i in range(1, 14)], "doc_id long, quality int")
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_scores_weigh_a_mix(spark):
    """Scores of the classifier go on as weights: of equal documents those of better text are taken sooner."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = quality.keep_good(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), score_col="worth", least=0.0).where("source is not null")
    assert good.columns == [*docs.columns, "worth"]
    mixed = mixing.mix(good.withColumn("worth", F.when(F.col("worth") > 0.5, 1.0).otherwise(0.05)), weight_col="worth")
    met = mixed.join(good.select("doc_id", (F.col("worth") > 0.5).alias("better")), "doc_id").where("size > 0 and target < source_size")
    share = {r.better: r.share for r in met.groupBy("better").agg(F.avg((F.col("taken") > 0).cast("int")).alias("share")).collect()}
    assert share[True] > share[False] + 0.15


def test_rows_are_judged_by_their_texts(spark):
    """Every row is judged by its own text: rows without an id, and rows that repeat one."""
    draw = random.Random(5)
    good = lambda: " ".join(draw.choice(["the", "house", "of", "many", "rooms", "is", "open"]) for _ in range(40)) + "."
    bad = lambda: " ".join(draw.choice(["$$", "||", "#1!", "CLICK", "9999"]) for _ in range(40))
    rows = [(i, good() if i % 2 else bad()) for i in range(400)] + [(None, bad()), (None, good()), (1, bad()), (0, good())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2, 400)], "doc_id long, quality int")
    kept = {(r.doc_id, r.text) for r in quality.keep_good(docs, labels).collect()}
    assert kept == {(i, t) for i, t in rows if "house" in t or "rooms" in t or "the" in t}


def least_squares_rising(y, w):
    """The best rising fit by the min-max formula, in quadratic time: max over starts of min over ends of weighted means."""
    n = len(y)
    mean = lambda i, j: sum(w[k] * y[k] for k in range(i, j + 1)) / sum(w[i : j + 1])
    return [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_isotonic_by_brute_force(seed):
    draw = random.Random(seed)
    bins = [(x / 30, n, sum(draw.random() < x / 30 for _ in range(n))) for x in range(30) for n in [draw.randrange(1, 9)]]
    places, levels = quality.pooled(bins)
    assert (np.diff(levels) > 0).all() and (np.diff(places) > 0).all()
    want = least_squares_rising([b[2] / b[1] for b in bins], [b[1] for b in bins])
    pools = sorted(set(np.round(want, 12)))
    assert np.allclose(levels, pools)
    for level, place in zip(levels, places, strict=True):  # a pool stands at the mean place of its documents
        own = [b for b, v in zip(bins, want, strict=True) if abs(v - level) < 1e-9]
        assert place == pytest.approx(sum(b[0] * b[1] for b in own) / sum(b[1] for b in own))


def test_ridge_by_a_dense_solve(spark):
    """Weights, calibration and scores against one dense system over all fitted documents."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    stats = quality.document_statistics(docs)
    model = quality.fit(stats, labels)
    fold = labels.where("quality IS NOT NULL").select("doc_id", "quality", (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold")), F.lit(4)) == 0).alias("c"))
    rows = stats.join(fold, "doc_id").orderBy("doc_id").collect()
    x, y = np.array([r.stats for r in rows if not r.c]), np.array([r.quality for r in rows if not r.c], float)
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    z = quality.fourier(x, mean, scale, 0)
    penalty = quality.RIDGE * len(x) * np.diag(np.r_[1e-6, np.ones(quality.FEATURES)]) / quality.FEATURES
    want = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    assert np.allclose(z @ model.weights, z @ want, atol=1e-6)
    held = np.array([r.stats for r in rows if r.c])
    bins = {}
    for v, r in zip(model.raw(held), [r for r in rows if r.c], strict=True):
        k = int(np.floor((max(min(v, 1.4999), -0.5) + 0.5) * quality.BINS / 2))
        n, total = bins.get(k, (0, 0))
        bins[k] = (n + 1, total + r.quality)
    places, levels = quality.pooled([((k + 0.5) / (quality.BINS / 2) - 0.5, *bins[k]) for k in sorted(bins)])
    assert np.allclose(model.knots, places) and np.allclose(model.levels, levels)


def test_noisy_or_gradient_by_finite_differences():
    draw = np.random.RandomState(3)
    docs, terms = 30, 7
    toxic = draw.rand(docs) < 0.4
    each = [(d, s, t) for d in range(docs) for s in range(draw.randint(0, 4)) for t in draw.choice(terms, draw.randint(1, 4), replace=False)]
    doc, sentence, term = np.array(each).T
    at = np.r_[draw.normal(size=terms), -1.5]

    def by_hand(v):
        total = 0.0
        for d in range(docs):
            clean = 1 / (1 + np.exp(v[-1]))
            for s in {e[1] for e in each if e[0] == d}:
                x = sum(v[t] for a, b, t in each if (a, b) == (d, s))
                clean *= (1 + np.exp(v[-1])) / (1 + np.exp(v[-1] + max(x, 0)))
            total -= np.log(1 - clean if toxic[d] else clean)
        return total

    loss, slope = toxicity.loss_and_slope(at[:-1], at[-1], toxic, doc, sentence, term)
    assert loss == pytest.approx(by_hand(at))
    for k in range(terms + 1):
        step = np.eye(terms + 1)[k] * 1e-5
        assert slope[k] == pytest.approx((by_hand(at + step) - by_hand(at - step)) / 2e-5, abs=1e-6)


def test_the_sample_is_bounded(spark):
    """A fit takes as many labelled documents as its bound says, those of the smallest hashes, however many there are."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    labels = docs.select("doc_id", F.lit(0).alias("toxic"))
    taken = toxicity._sample(docs.withColumn("text", F.col("doc_id").cast("string")), labels, "doc_id", "text", "toxic", 300)
    want = docs.orderBy(F.xxhash64(F.col("doc_id").cast("string"))).limit(300)
    assert {r.text for r in taken.collect()} == {str(r.doc_id) for r in want.collect()}


def test_fourier_features_approximate_the_kernel():
    draw = np.random.RandomState(0)
    x = draw.normal(size=(40, len(quality.NAMES)))
    z = quality.fourier(x, np.zeros(x.shape[1]), np.ones(x.shape[1]), 0)[:, 1:]
    distance = ((x[:, None] - x) ** 2).sum(2)
    want = np.exp(-distance / (2 * quality.WIDTH**2 * x.shape[1]))
    assert np.abs(z @ z.T - want).mean() < 0.06


def test_offending_sentences(spark):
    draw = random.Random(0)
    words = "a fine day the sun is out all well you are here now come see them go".split()
    sentence = lambda *extra: " ".join([*draw.sample(words, 5), *extra]).capitalize() + "."
    rows = [(i, " ".join([sentence(), *([sentence("blorp")] if i % 3 == 0 else []), sentence(), f"Number {i}."])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels)
    found = toxicity.sentences(docs, model).collect()
    assert all("blorp" in r.sentence_text for r in found)
    texts = dict(rows)
    assert all(texts[r.doc_id][r.start : r.end] == r.sentence_text for r in found) and len(found) == 100
    fresh = spark.createDataFrame([(1, "x\nblorp! Such a BLORP"), (2, "Nothing of note")], "doc_id long, text string")
    assert {r.doc_id: r.score > 0.5 for r in toxicity.score(fresh, model).collect()} == {1: True, 2: False}


def test_noisy_or():
    model = toxicity.Model({"bad": 3.0, "fine": -1.0}, -2.0)
    p = lambda z: 1 / (1 + np.exp(-z))
    assert model.document("So bad") == pytest.approx(p(1.0))
    assert model.document("So bad. Other. BAD bad") == pytest.approx(1 - (1 - p(1.0)) ** 2 / (1 - p(-2.0)))
    assert model.document("Fine. Fine.") == model.document("") == pytest.approx(p(-2.0)) == pytest.approx(model.leak())
    assert model.sentence("nothing known") == model.sentence("fine") == 0


def test_the_score_is_the_noisy_or_of_the_sentences(spark):
    """What is located explains the score: the leak and all sentences give it back."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels)
    clean = {}
    for r in toxicity.sentences(docs, model, least=1e-12).collect():
        clean[r.doc_id] = clean.get(r.doc_id, 1 - model.leak()) * (1 - r.score)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(clean) > 50
    assert all(s == pytest.approx(1 - clean.get(i, 1 - model.leak()), abs=1e-9) for i, s in scores.items())


def test_length_alone_is_not_toxic(spark):
    draw = random.Random(1)
    words = "a fine day the sun is out all well you are here now come see them go".split()
    text = lambda toxic: " ".join(" ".join([*draw.sample(words, 5), *(["blorp"] if toxic and k == 1 else [])]).capitalize() + "." for k in range(3))
    docs = spark.createDataFrame([(i, text(i % 3 == 0)) for i in range(300)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    clean = "The sun is out.\n" * 50_000
    long = spark.createDataFrame([(1, clean), (2, clean + "Such a blorp is here."), (3, "The sun is out.")], "doc_id long, text string")
    model = toxicity.fit(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(long, model).collect()}
    assert scores[1] < 0.5 < scores[2] and scores[1] == scores[3]
    unlabelled = toxicity.fit(docs, labels.withColumn("toxic", F.lit(0)))  # clean labels only
    assert all(r.score < 0.5 for r in toxicity.score(long, unlabelled).collect())
