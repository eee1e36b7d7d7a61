"""Target-distribution importance resampling: documents drawn by how much their n-grams look like a target's.

1. In each partition the words of a block of texts become numbers, and the block's suffixes are sorted to the depth of the longest
   n-gram. Neighbours in that order that share their first n words (an LCP of n or more) are one run: all occurrences of one n-gram.
2. A run is hashed once, by extending the checksum of the run of n - 1 words that it lies in, and its hash is scattered to its occurrences.
3. The first pass counts features by bucket, summed by task before they are moved: at most `buckets` rows leave a task. The logarithms of
   the ratios of target and corpus are a table of `buckets` gains.
4. The second pass gives every document the mean gain of its features. Gumbel noise from its id turns that into a score whose highest
   values are a sample without replacement; ranks follow from the counts of scores and from the order inside a score.

Texts do not leave their tasks. Scores are whole numbers between about -100 000 and 100 000 (a thousand times a logarithm of counts,
and noise of 23 000 at most), which bounds the table of their counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import UPPER, cut, map_batches, row_key, text_of, with_key

#: Bytes of text that a block of suffixes is made of, about.
BLOCK = 4 << 20
#: Bytes of a word, and the blank before it, up to which checksums are extended by tables.
REACH = 63
#: A-Z become a-z; ASCII characters other than letters and digits become blanks.
_SIGNS = bytes(c for c in range(128) if not (chr(c).isalnum()))
_PLAIN = bytes.maketrans(UPPER.encode() + _SIGNS, UPPER.lower().encode() + b" " * len(_SIGNS))
#: Scores that share a step of the ladder by which ranks are counted, as a power of two.
_RUNG = 8


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """For each number of bytes up to REACH, what a CRC-32 becomes when so many zero bytes follow, as four tables of 256: the
    checksum is linear, so that crc(a + b) is crc(a), shifted by the length of b, xor crc(b)."""
    step = np.arange(256, dtype=np.int64)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ 0xEDB88320, step >> 1)
    now = np.arange(256, dtype=np.int64) << np.array([[0], [8], [16], [24]])
    out = [now]
    for _ in range(REACH):
        now = (now >> 8) ^ step[now & 255]
        out.append(now)
    return np.array(out).reshape(-1)


def extended(crc: np.ndarray, size: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The CRC-32 of texts of given checksums, each followed by bytes of a given number (REACH at most) and checksum."""
    base = size << 10
    out = tail.copy()
    for k in range(4):
        out ^= _shifts()[base + (k << 8) + ((crc >> (8 * k)) & 255)]
    return out


class Block:
    """Pieces of texts, and which text each is from."""

    def __init__(self, longest: int) -> None:
        self.longest = longest
        self.pieces: list[bytes] = []
        self.rows: list[int] = []
        self.known: list[int] = []
        self.size = 0

    def add(self, row: int, piece: bytes, known: int) -> None:
        """A piece of text `row`, whose first `known` words were in the piece before."""
        self.pieces.append(piece)
        self.rows.append(row)
        self.known.append(known)
        self.size += len(piece)

    def words(self) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The number of each word in order, how many words each piece has, and the words by their number; numbers begin at 1."""
        parts = pc.ascii_split_whitespace(pa.array(self.pieces, pa.large_string()))
        flat = parts.values
        filled = pc.not_equal(pc.binary_length(flat), 0)
        upto = np.r_[0, np.cumsum(filled.to_numpy(zero_copy_only=False))]
        coded = flat.filter(filled).dictionary_encode()
        _, offsets, data = coded.dictionary.buffers()
        at, raw = np.frombuffer(offsets, np.int64, len(coded.dictionary) + 1).tolist(), data.to_pybytes() if data else b""
        words = [b"", *(raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True))]
        return coded.indices.to_numpy().astype(np.int64) + 1, np.diff(upto[parts.offsets.to_numpy()]), words

    def hashes(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For n = 1, 2, ...: the CRC-32 of the n-gram at each place, whether a new n-gram begins there, and the words of each piece."""
        ids, sizes, words = self.words()
        ends = np.cumsum(sizes)
        place = np.arange(len(ids)) - np.repeat(ends - sizes, sizes)
        left = np.repeat(sizes, sizes) - place  # words from here to the end of the piece
        known = np.repeat(np.array(self.known, np.int64), sizes) - place  # an n-gram of so many words or fewer was in the piece before
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        spaced = np.array([zlib.crc32(b" " + w) for w in words], np.int64)

        order = suffix_order(ids, left, self.longest)
        fresh = np.zeros(len(ids), bool)  # in that order: the LCP with the suffix before is below n
        fresh[:1] = True
        crc = np.zeros(len(ids), np.int64)
        for n in range(1, self.longest + 1):
            nth = word_at(ids, left, n - 1)[order]
            fresh[1:] |= nth[1:] != nth[:-1]
            first = np.flatnonzero(fresh)
            last, before = nth[first], crc[order[first]]
            if n == 1:
                run = np.array([zlib.crc32(words[w]) for w in last.tolist()], np.int64)
            else:
                run = extended(before, np.minimum(length[last], REACH), spaced[last])
                for k in np.flatnonzero(length[last] > REACH).tolist():
                    run[k] = zlib.crc32(b" " + words[last[k]], int(before[k]))
            crc = np.empty(len(ids), np.int64)
            crc[order] = np.repeat(run, np.diff(np.append(first, len(ids))))
            yield crc, (left >= n) & (known < n), sizes


def word_at(ids: np.ndarray, left: np.ndarray, ahead: int) -> np.ndarray:
    """The number of the word so many words ahead of each place; 0 beyond the end of its stretch."""
    if not ahead:
        return ids
    out = np.zeros_like(ids)
    out[:-ahead] = ids[ahead:]
    out[left <= ahead] = 0
    return out


def suffix_order(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of a block, sorted by the first `depth` words of each suffix at least: ranks are doubled."""
    rank, known = ids, 1
    while known < depth:
        pair = rank * (int(rank.max(initial=0)) + 1) + word_at(rank, left, known)
        known *= 2
        if known < depth:
            rank = np.unique(pair, return_inverse=True)[1] + 1
        else:
            rank = pair
    return np.argsort(rank)


def blocks(texts: Iterator[bytes], longest: int) -> Iterator[Block]:
    """The words of texts in blocks of about BLOCK bytes. A long text is cut between words, and goes on with the last words before the cut."""
    block = Block(longest)
    for row, raw in enumerate(texts):
        plain, begin, kept = raw.translate(_PLAIN), 0, []
        while begin < len(plain):
            end = plain.find(b" ", begin + BLOCK) if len(plain) - begin > BLOCK else -1
            end = len(plain) if end < 0 else end
            piece = b" ".join([*kept, plain[begin:end]]) if kept else plain[begin:end]
            block.add(row, piece, len(kept))
            begin = end
            if block.size >= BLOCK:
                yield block
                block = Block(longest)
            if begin < len(plain) and longest > 1:
                kept = piece.rsplit(None, longest - 1)[1 - longest :]
    if block.size:
        yield block


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (t.encode() for t in batch.column("text").to_pylist())


def bucket_counts(docs: DataFrame, buckets: int, longest: int, text_col: str = "text") -> DataFrame:
    """bucket, n: how many n-grams of 1 to `longest` words of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in blocks(_texts(batch), longest):
                for crc, new, _ in block.hashes():
                    total += np.bincount(crc[new] % buckets, minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bucket", "n"])

    slim = docs.select(text_of(docs, text_col).alias("text"))
    return map_batches(slim, run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int, longest: int, text_col: str = "text") -> np.ndarray:
    """For each bucket a thousand times the logarithm of how much likelier it is in the target, smoothed by one, rounded down."""
    found = []
    for table in (docs, target):
        n = np.zeros(buckets, float)
        for r in bucket_counts(table, buckets, longest, text_col).collect():  # `buckets` rows at most
            n[r.bucket] = r.n
        found.append(n)
    s, t = found
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, h1, h2 (row_key), n_words, n_features, weight for each row: the mean gain of its features, rounded down; 0 for none."""
    slim = docs.select(docs[id_col].alias("id"), *row_key(docs, id_col, text_col), text_of(docs, text_col).alias("text"))
    fields = slim.select("id", "h1", "h2").schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, total = np.zeros((3, batch.num_rows), np.int64)
            for block in blocks(_texts(batch), longest):
                for n, (crc, new, sizes) in enumerate(block.hashes()):
                    some = sizes > 0
                    begin, rows = (np.cumsum(sizes) - sizes)[some], np.array(block.rows)[some]
                    if not len(begin):
                        continue
                    own = np.add.reduceat(new.astype(np.int64), begin)
                    np.add.at(features, rows, own)
                    np.add.at(total, rows, np.add.reduceat(np.where(new, gain[crc % len(gain)], 0), begin))
                    if n == 0:
                        np.add.at(words, rows, own)
            mean = total // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, (words, features, mean))], ["id", "h1", "h2", "n_words", "n_features", "weight"])

    return map_batches(slim, run, f"{fields}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def _ranked(scored: DataFrame, share: int, least_words: int) -> DataFrame:
    """scored (id, n_words, n_features, score, ...; cut) with rank: 1, 2, ... for the `share` percent of rows of enough words that score highest."""
    able = scored.where(F.col("n_words") >= least_words)
    levels = able.groupBy("score").agg(F.count("*").alias("n")).withColumn("rung", F.shiftright("score", _RUNG))
    ladder = levels.groupBy("rung").agg(F.sum("n").alias("n"))  # about a thousand rows at most
    down = Window.orderBy(F.desc("rung")).rowsBetween(Window.unboundedPreceding, -1)
    ladder = ladder.select("rung", F.coalesce(F.sum("n").over(down), F.lit(0)).alias("over"), F.floor(F.lit(share) * F.sum("n").over(Window.partitionBy()) / 100).alias("draw"))
    inside = Window.partitionBy("rung").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.join(ladder, "rung").select("score", "draw", (F.col("over") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("above")).where("above < draw")
    levels = cut(levels)

    joined = scored.join(F.broadcast(levels), "score", "left").withColumn("in", F.col("above").isNotNull() & (F.col("n_words") >= least_words))  # levels: a row a score
    place = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy("id", "n_features"))
    hit = joined.where("in").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= F.col("draw"), F.col("rank")))
    rest = joined.where(~F.col("in")).withColumn("rank", F.lit(None).cast("long"))
    return hit.unionByName(rest).drop("above", "draw", "in")


def _scored(docs: DataFrame, target: DataFrame, share: int, seed: int, longest: int, buckets: int, least_words: int, id_col: str, text_col: str) -> DataFrame:
    weighed = weights(docs, gains(docs, target, buckets, longest, text_col), longest, id_col, text_col)
    return _ranked(cut(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed))), share, least_words)


def resample(
    docs: DataFrame, target: DataFrame, share: int = 25, seed: int = 7, longest: int = 2, buckets: int = 10_000, least_words: int = 20,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: id, n_features, weight, score, rank.

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII; A-Z are lower-cased. Features are all runs of 1 to
    `longest` words, repeats counted. Of the rows with at least `least_words` words, the `share` percent (rounded down) with the highest scores are
    drawn and have their rank; ties go to the smaller id, and those of one id to the smaller text; for all others rank is null. A null or empty text has
    no features and the weight 0. A null id is noise of its own and comes first among ties; rows that repeat an id score by their own texts.
    Other columns are not looked at. An empty table gives no rows; an empty target counts as one feature in every bucket.
    """
    out = _scored(docs, target, share, seed, longest, buckets, least_words, id_col, text_col)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of docs that resample() draws, with all their columns. Rows that repeat both id and text are drawn together."""
    given = {"share": 25, "seed": 7, "longest": 2, "buckets": 10_000, "least_words": 20} | options
    keys = _scored(docs, target, id_col=id_col, text_col=text_col, **given).where("rank is not null").select("h1", "h2").distinct()
    return with_key(docs, id_col, text_col).join(keys, ["h1", "h2"], "left_semi").select("row.*")
