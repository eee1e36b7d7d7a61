"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated isotonically.

1. One pass over the texts gives each document a vector of statistics of its bytes, words and lines.
2. Random Fourier features of the standardized statistics approximate a Gaussian kernel. Each partition of
   labelled documents adds up its part of the normal equations; the parts are summed row by row of the matrix.
   The driver solves one system of a fixed size, whatever the corpus.
3. Labelled documents that took no part in the fit are counted in narrow bins of their raw scores; adjacent
   bins are pooled until the shares of good documents rise, and scores are read off the line through the pools.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, map_batches, row_key, text_of, with_key, without

FEATURES = 384
RIDGE = 1e-3
#: The kernel's width, in standard deviations of a statistic times the root of their number.
WIDTH = 1.0
#: Bins of raw scores from -0.5 to 1.5.
BINS = 2048
#: Standardized statistics beyond this are cut off, so that odd documents stay within what was fitted.
CLIP = 6.0

_STOPS = frozenset(b"the of and to in is that for it with as was on be by de la que le et des les en un du est der die und das von zu den mit ist el los del las por con una para se".split())
_MARKS = b".,;:!?'\"-|#$%&*<>(){}[]/\\=_@"


def _classes() -> np.ndarray:
    """Each byte's class: 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 above ASCII, 7... the marks."""
    table = np.zeros(256, np.int64)
    table[ord("a") : ord("z") + 1] = 1
    table[ord("A") : ord("Z") + 1] = 2
    table[ord("0") : ord("9") + 1] = 3
    table[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 4
    table[0x0A] = 5
    table[0x80:] = 6
    for i, mark in enumerate(_MARKS):
        table[mark] = 7 + i
    return table


_CLASS = _classes()
_PLAIN, _SYMBOL = frozenset(b".,;:!?'\"-"), frozenset(b"|#$%&*<>{}[]/\\=_@")
NAMES = (
    "log_bytes", "log_words", "mean_word", "sd_word", "long_words", "distinct_words", "herdan", "stop_words", "lower", "upper", "digits",
    "above_ascii", "blanks", "line_ends", "plain_marks", "symbols", "exclamation", "stops", "commas", "pipes", "byte_entropy",
    "log_lines", "mean_line", "repeated_lines", "capital_words", "symbol_words",
)


def statistics(raw: bytes) -> list[float]:
    """The statistics of a text in UTF-8, in the order of NAMES; an empty text has zeros."""
    if not raw:
        return [0.0] * len(NAMES)
    data = np.frombuffer(raw, np.uint8)
    bytes_of = np.bincount(data, minlength=256)
    by_class = np.bincount(_CLASS, weights=bytes_of, minlength=7 + len(_MARKS))
    n = len(raw)
    words = raw.split()
    count = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    distinct = set(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = bytes_of[bytes_of > 0] / n
    lowered = raw.lower().split() if by_class[2] else words
    stops = sum(map(_STOPS.__contains__, lowered))
    last = [w[-1] for w in words]
    plain = sum(bytes_of[m] for m in _PLAIN)
    symbols = sum(bytes_of[m] for m in _SYMBOL)
    upper_words = sum(map(bytes.isupper, words)) if by_class[2] else 0
    return [
        np.log1p(n), np.log1p(len(words)), sizes.mean(), sizes.std(), float((sizes > 12).mean()), len(distinct) / count,
        np.log1p(len(distinct)) / np.log1p(count), stops / count, by_class[1] / n, by_class[2] / n, by_class[3] / n,
        by_class[6] / n, by_class[4] / n, by_class[5] / n, plain / n, symbols / n, bytes_of[0x21] / n, bytes_of[0x2E] / n, bytes_of[0x2C] / n, bytes_of[0x7C] / n,
        float(-(share * np.log2(share)).sum()),
        np.log1p(len(lines)), np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), upper_words / count,
        sum(map(_SYMBOL.__contains__, last)) / count,
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """id, stats (array of double) and the columns of `keep` for each row; a null text counts as empty."""
    kept = docs.select(docs[id_col].alias(id_col), *keep)
    slim = docs.select(docs[id_col].alias(id_col), *keep, text_of(docs, text_col).alias("_text"))
    fields = kept.schema.simpleString()[len("struct<") : -1]
    names = [*kept.columns, "stats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t.encode()) for t in batch.column(batch.num_columns - 1).to_pylist()], np.float64).reshape(-1)
            stats = pa.FixedSizeListArray.from_arrays(pa.array(rows), len(NAMES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], stats], names)

    return map_batches(slim, run, f"{fields}, stats array<double>")


@dataclass(frozen=True)
class Model:
    """A fitted classifier, of a fixed size. Without any labels, weights are zeros and every score is 1/2."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray
    seed: int = 0

    def features(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.mean, self.scale, self.seed)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.levels)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, seed: int) -> np.ndarray:
    """Random Fourier features of rows of statistics, and a constant."""
    draw = np.random.RandomState(seed)
    x = np.clip((stats - mean) / scale, -CLIP, CLIP)
    frequency = draw.normal(size=(len(mean), FEATURES)) / (WIDTH * np.sqrt(len(mean)))
    phase = draw.uniform(0, 2 * np.pi, FEATURES)
    return np.c_[np.ones(len(x)), np.sqrt(2 / FEATURES) * np.cos(x @ frequency + phase)]


def _stats_of(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(NAMES))


def pooled(bins: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of (place, count, sum) by pooling adjacent violators: places and levels of the pools."""
    pools: list[list[float]] = []
    for place, count, total in bins:
        pools.append([place * count, count, total])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    places = np.array([p[0] / p[1] for p in pools])
    return places, np.array([p[2] / p[1] for p in pools])


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", seed: int = 0) -> Model:
    """Fits a model to document_statistics() and labels (id, 0 or 1) of documents that may be learned from.

    Null ids and labels are left out; of an id's labels the smallest counts. Three quarters of the labelled
    documents, told apart by a digest of the id, fit the ridge regression, and the rest calibrate it.
    """
    own = labels.where(labels[id_col].isNotNull() & labels[label_col].isNotNull()).groupBy(labels[id_col].cast("string").alias("_key")).agg(F.min(label_col).cast("double").alias("_label"))
    keyed = stats.select(stats[id_col].cast("string").alias("_key"), "stats")  # ids meet as text, whatever their types
    known = keyed.join(own, "_key").select("_label", "stats", (F.pmod(F.xxhash64("_key", F.lit("fold")), F.lit(4)) == 0).alias("_calibrates"))
    known = cut(known)
    fitted = known.where("NOT _calibrates")
    d = len(NAMES)
    sums = fitted.agg(F.count("*"), *[f(F.get("stats", F.lit(i))) for i in range(d) for f in (F.avg, F.stddev_pop)]).first()
    if not sums[0]:
        return Model(np.zeros(d), np.ones(d), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]), seed)
    mean, spread = np.array(sums[1::2]), np.array(sums[2::2])
    scale = np.where(spread > 1e-9, spread, 1.0)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = fourier(_stats_of(batch.column("stats")), mean, scale, seed)
            total += z.T @ np.c_[z, batch.column("_label").to_numpy()]
        rows = pa.FixedSizeListArray.from_arrays(pa.array(total.reshape(-1)), total.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), rows], ["row", "part"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, part in zip(batch.column(0).to_pylist(), batch.column(1).flatten().to_numpy().reshape(-1, FEATURES + 2), strict=True):
                totals[row] = totals[row] + part if row in totals else part.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([x.tolist() for x in totals.values()], pa.list_(pa.float64()))], ["row", "part"])

    schema = "row int, part array<double>"
    equations = map_batches(map_batches(fitted.select("stats", "_label"), parts, schema).repartition("row"), summed, schema)
    system = np.array([r.part for r in sorted(equations.collect(), key=lambda r: r.row)])  # FEATURES + 1 rows
    count = sums[0]
    ridge = RIDGE * count * np.diag(np.r_[1e-6, np.ones(FEATURES)]) / FEATURES
    weights = np.linalg.solve(system[:, :-1] + ridge, system[:, -1])
    model = Model(mean, scale, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]), seed)

    bins = (
        _apply(known.where("_calibrates"), model.raw, ["_label"])
        .groupBy(F.floor((F.greatest(F.least("score", F.lit(1.4999)), F.lit(-0.5)) + 0.5) * (BINS / 2)).alias("bin"))
        .agg(F.count("*").alias("n"), F.sum("_label").alias("good")).orderBy("bin").collect()
    )  # BINS rows at most
    places, levels = pooled([((b.bin + 0.5) / (BINS / 2) - 0.5, b.n, b.good) for b in bins])
    if not bins:
        places, levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return Model(mean, scale, weights, places, np.clip(levels, 0, 1), seed)


def _apply(stats: DataFrame, value: object, keep: list[str]) -> DataFrame:
    fields = stats.select(*keep).schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch], keep: list[str] = keep) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(value(_stats_of(batch.column("stats"))), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), scores], [*keep, "score"])

    return map_batches(stats.select(*keep, "stats"), partial(run, keep=keep), f"{fields}, score double")


def score(stats: DataFrame, model: Model) -> DataFrame:
    """score for each row of document_statistics(), beside its other columns: 0 to 1, higher for better documents."""
    return _apply(stats, model.score, [c for c in stats.columns if c != "stats"])


def held_out(id_col: Column) -> Column:
    """Whether a document's labels are never learned from: crc32(id as text) mod 5 is 0. Null ids are not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.3) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted (1 if score >= least).

    Only the text makes a score. Labels of held-out documents are not learned from. Null and empty texts get the
    score of an empty text; rows that repeat an id get a score each (a label counts for each of them); a null id
    has no label. Without any usable label every score is 1/2. An empty table gives no rows.
    """
    return _scored(docs, labels, id_col, text_col, label_col, least, ()).select(id_col, "held_out", "score", "predicted")


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, least: float, keep: tuple[Column, ...]) -> DataFrame:
    stats = cut(document_statistics(docs, id_col, text_col, keep))
    model = fit(stats, labels.where(~held_out(labels[id_col])), id_col, label_col)
    scored = score(stats, model)
    return scored.withColumns({"held_out": held_out(F.col(id_col)), "predicted": (F.col("score") >= least).cast("int")})


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.3, score_col: str | None = None,
) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns. Every row is judged by its own text,
    whatever its id is. With score_col, a name that docs has not, the rows have their scores, and are moved to meet them."""
    scored = _scored(docs, labels, id_col, text_col, label_col, least, row_key(docs, id_col, text_col))
    if score_col is None:
        return without(docs, cut(scored.where("predicted = 0").select("h1", "h2").distinct()), id_col, text_col)
    good = scored.where("predicted = 1").groupBy("h1", "h2").agg(F.max("score").alias("score"))
    return with_key(docs, id_col, text_col).join(good, ["h1", "h2"]).select("row.*", F.col("score").alias(score_col))
