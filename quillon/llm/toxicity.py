"""Toxicity by multiple-instance learning: sentence scores are learned from document labels through a noisy-or.

A document is toxic if any of its sentences is, or of itself: P(doc) = 1 - (1 - leak) prod(1 - p(sentence)), with leak = sigmoid(b) and
1 - p(sentence) = (1 + e^b) / (1 + e^(b + x)), where x is the sum of the weights of its terms, or 0 if that is less. So a sentence of known
terms alone in a text has the log-odds b + x, one without any is never toxic, and length alone makes no document toxic. This is what is fitted, what scores a
document, and what sentences() gives. Terms are words and beginnings of words, so that inflected and compound words share
what is learned. Only documents have labels; the noisy-or's gradient tells sentences apart.

1. A bounded sample of labelled documents (FIT of them, the smallest digests of ids) is matched with the texts.
2. Terms that mark toxic documents of the sample become features, TERMS of them at most, by chi-squared.
3. Weights start at a part of the terms' log-odds and are held near it, so that a term which others explain away
   keeps some weight. Gradient steps: each partition of the sample returns one vector, the driver takes the step.
4. One pass over all texts scores every sentence, and so every document; sentences() locates the offending ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, map_batches, text_of
from quillon.llm.quality import held_out

#: Labelled documents that a model is fitted on, at most. Their ids are broadcast: 16 bytes each.
FIT = 20_000
#: Terms a model knows, at most, and toxic documents in which a term must stand at least.
TERMS, LEAST_DOCS = 4096, 3
#: Letters of the beginnings of words that are terms.
BEGINNINGS = (4, 5, 6, 7)
#: The part of its log-odds that a weight starts from.
PRIOR = 0.25
#: Gradient steps, their size, and the pull of weights toward where they started.
STEPS, RATE, DECAY = 60, 0.1, 1e-4
#: Partitions of the sample.
PARTS = 8

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+(?!\s)[^.!?\n]+)*[.!?]*")


def spans(text: str) -> list[tuple[int, int]]:
    """Begin and end of each sentence: up to marks that white space follows, or to a line's end."""
    return [m.span() for m in _SENTENCE.finditer(text) if not m.group().isspace()]


def terms_of(text: str) -> set[str]:
    """The words of a text, lower-cased, and the beginnings of longer ones, marked by a star."""
    words = set(_WORD.findall(text.lower()))
    out = set(words)
    for k in BEGINNINGS:
        out.update([w[:k] + "*" for w in words if len(w) > k])
    return out


def _softplus(z: float) -> float:
    """-log(1 - sigmoid(z))."""
    return z if z > 30 else math.log1p(math.exp(z))


@dataclass(frozen=True)
class Model:
    """Weights of terms, and the bias of a document; of a bounded size."""

    weights: dict[str, float]
    bias: float

    def leak(self) -> float:
        """The probability that a document without known terms is toxic."""
        return -math.expm1(-_softplus(self.bias))

    def sentence(self, text: str) -> float:
        """The probability that a sentence is toxic; a term that it repeats counts once."""
        return -math.expm1(-self._excess(terms_of(text)))

    def _excess(self, terms: set[str]) -> float:
        x = sum(self.weights[t] for t in terms if t in self.weights)
        return _softplus(self.bias + x) - _softplus(self.bias) if x > 0 else 0.0

    def document(self, text: str) -> float:
        """The probability of the noisy-or of all sentences and the leak."""
        total = _softplus(self.bias)
        if not self.weights.keys().isdisjoint(terms_of(text)):
            total += sum(self._excess(terms_of(text[a:b])) for a, b in spans(text))
        return -math.expm1(-total)


def bags(text: str) -> list[set[str]]:
    """The terms of each sentence."""
    return [terms_of(text[a:b]) for a, b in spans(text)]


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, bound: int) -> DataFrame:
    """(label, text) of a bounded sample of the labelled documents. Of an id's labels the largest counts.

    The sample is of the smallest hashes of ids. A threshold that `bound` of them lie below, with six standard deviations
    to spare, leaves little more than the sample to be sorted, however many labels there are.
    """
    own = labels.where(labels[id_col].isNotNull() & labels[label_col].isNotNull()).groupBy(labels[id_col].cast("string").alias("key")).agg(F.max(label_col).cast("int").alias("label"))
    own = own.withColumn("place", F.xxhash64("key"))  # ids meet as text, whatever their types
    share = (bound + 6 * math.sqrt(bound) + 50) / max(1, own.count())
    if share < 1:
        own = own.where(F.col("place") < int(-(2**63) + share * 2**64))
    taken = cut(own.orderBy("place", "key").limit(bound))  # at most `bound` rows of an id and a label, whatever the corpus: safe to broadcast
    texts = docs.select(docs[id_col].cast("string").alias("key"), text_of(docs, text_col).alias("text"))
    return texts.join(F.broadcast(taken), "key").select("label", "text")


def loss_and_slope(weights: np.ndarray, bias: float, toxic: np.ndarray, doc: np.ndarray, sentence: np.ndarray, term: np.ndarray) -> tuple[float, np.ndarray]:
    """The noisy-or's loss, -log P(label) summed over documents, and its slope by weights and (last) bias.

    toxic has an entry per document; doc, sentence and term have one for each term of each sentence that has any.
    """
    own, place = np.unique(np.c_[doc, sentence], axis=0, return_inverse=True)
    place = place.reshape(-1)
    x = np.bincount(place, weights[term], len(own))
    counts = x > 0
    odds = lambda z: 1 / (1 + np.exp(-z))
    excess = np.where(counts, np.logaddexp(0, bias + x) - np.logaddexp(0, bias), 0.0)
    total = np.logaddexp(0, bias) + np.bincount(own[:, 0], excess, len(toxic))  # -log P(clean)
    total = np.clip(total, 1e-9, 500.0)
    loss = np.where(toxic, -np.log(-np.expm1(-total)), total).sum()
    pull = np.where(toxic, -1 / np.expm1(total), 1.0)  # by total: 1 for a clean document, -P(clean) / P(toxic) for a toxic one
    rise = np.where(counts, odds(bias + x), 0.0) * pull[own[:, 0]]
    by_bias = pull.sum() * odds(bias) + (rise - counts * odds(bias) * pull[own[:, 0]]).sum()
    return float(loss), np.r_[np.bincount(term, rise[place], len(weights)), by_bias]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = FIT) -> Model:
    """Fits a model to the labels (id, 0 or 1) of documents that may be learned from. Null ids and labels are left out.

    Without labels of both kinds every document has the log-odds of the share of toxic documents (1/2 without any).
    """
    sample = cut(_sample(docs, labels, id_col, text_col, label_col, bound).repartition(PARTS))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flushed() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "clean", "toxic"])

        for batch in batches:
            for label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[bool(label)].update(terms_of(text))
                if len(counts[0]) + len(counts[1]) > 200_000:
                    yield flushed()
        yield flushed()

    n = {bool(r.label): r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic_n, clean_n = n.get(True, 0), n.get(False, 0)
    if not toxic_n or not clean_n:
        share = (toxic_n + 0.5) / (toxic_n + clean_n + 1)
        return Model({}, float(np.log(share / (1 - share))))
    both = map_batches(sample, words, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    p, q = F.col("toxic") / toxic_n, F.col("clean") / clean_n
    share = (F.col("toxic") + F.col("clean")) / (toxic_n + clean_n)
    chi = (p - q) ** 2 / (share * (1 - share) + 1e-9)
    best = both.where((F.col("toxic") >= LEAST_DOCS) & (p > 2 * q)).orderBy(chi.desc(), "word").limit(TERMS).collect()  # TERMS rows at most
    terms = sorted(r.word for r in best)
    place = {w: i for i, w in enumerate(terms)}
    odds = {r.word: math.log((r.toxic + 0.5) / (toxic_n + 1)) - math.log((r.clean + 0.5) / (clean_n + 1)) for r in best}
    prior = np.array([PRIOR * odds[w] for w in terms])

    def instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document: the label, and for each term of each sentence that has any the sentence and the term."""
        for batch in batches:
            labels, sentences, ids = [], [], []
            for label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                some = [x for x in ([place[w] for w in bag if w in place] for bag in bags(text)) if x]
                labels.append(label)
                sentences.append([k for k, x in enumerate(some) for _ in x])
                ids.append([i for x in some for i in x])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(sentences, kind), pa.array(ids, kind)], ["label", "sentences", "ids"])

    ready = cut(map_batches(sample, instances, "label int, sentences array<long>, ids array<long>"))

    def gradient(weights: np.ndarray, bias: float) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(len(weights) + 1)
            for batch in batches:
                lists = batch.column("sentences")
                doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                out += loss_and_slope(weights, bias, batch.column("label").to_numpy() == 1, doc, lists.flatten().to_numpy(), batch.column("ids").flatten().to_numpy())[1]
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["g"])

        parts = map_batches(ready, run, "g array<double>").collect()  # PARTS vectors of TERMS + 1 numbers at most
        return np.sum([r.g for r in parts], axis=0) / (toxic_n + clean_n)

    return _descend(gradient, prior, terms)


def _descend(gradient: Callable[[np.ndarray, float], np.ndarray], prior: np.ndarray, terms: list[str]) -> Model:
    """Adam steps from the prior weights and a low bias: a document without known terms is hardly ever toxic."""
    at = np.r_[prior, -6.0]
    first, second = np.zeros(len(at)), np.zeros(len(at))
    for step in range(1, STEPS + 1):
        g = gradient(at[:-1], float(at[-1])) + DECAY * np.r_[at[:-1] - prior, 0.0]
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        rate = RATE * (1 - 0.9 * step / STEPS)
        at = at - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model({w: float(x) for w, x in zip(terms, at[:-1], strict=True)}, float(at[-1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score for each row: the probability that it is toxic. A null text counts as empty."""
    slim = docs.select(docs[id_col].alias(id_col), text_of(docs, text_col).alias("_text"))
    fields = slim.select(id_col).schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.document(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], [id_col, "score"])

    return map_batches(slim, run, f"{fields}, score double")


def sentences(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sentence (number from 0), start, end (code points), sentence_text, score: the sentences whose score is at least `least`."""
    slim = docs.select(docs[id_col].alias(id_col), text_of(docs, text_col).alias("_text"))
    fields = slim.select(id_col).schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for number, (a, b) in enumerate(spans(text)):
                    p = model.sentence(text[a:b])
                    if p >= least:
                        rows.append(k)
                        found.append((number, a, b, text[a:b], p))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], [id_col, "sentence", "start", "end", "sentence_text", "score"])

    return map_batches(slim, run, f"{fields}, sentence int, start long, end long, sentence_text string, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", least: float = 0.5) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted (1 if score >= least).

    Only the text makes a score. Labels of held-out documents are not learned from. Null and empty texts get the
    score of a text without known terms; rows that repeat an id get a score each; a null id has no label. An empty table
    gives no rows.
    """
    model = fit(docs, labels.where(~held_out(labels[id_col])), id_col, text_col, label_col)
    scored = score(docs, model, id_col, text_col)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
