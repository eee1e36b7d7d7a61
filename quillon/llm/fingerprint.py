"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Only DataFrame functions. Words are hashed once, shingles of five words hash their words' hashes, and the high bits of a
shingle's hash name its bin; sorting a document's hashes puts each bin's minimum first. Which bins are filled is kept as a
bitmap of two numbers, so that a bin's minimum is found by counting bits. An empty bin takes the minimum of the first filled
bin in its own fixed random order of bins, the same order in every document, as optimal densification asks. Four low-order
bits of each bin's minimum, mixed with the bin's number, are packed into eight numbers; two fingerprints are compared by XOR and a population count.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, cut, row_key, text_of

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 4
#: Bins in one packed number, and packed numbers of a fingerprint.
PER_WORD = 64 // LOW_BITS
PACKED = BINS // PER_WORD
#: Bins that are tried one by one before the whole order of an empty bin is searched.
TRIES = 6
#: Rows of a range of ids, about.
RANGE = 50_000


def _orders() -> list[list[int]]:
    """For each bin, the fixed random order in which the others are tried."""
    draw = random.Random(20_170_806)
    return [draw.sample(range(BINS), BINS) for _ in range(BINS)]


ORDERS = _orders()


def _table(numbers: object, kind: str) -> Column:
    return F.from_json(F.lit(str(numbers)), kind)


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the packed fingerprint of a text column (not null): PACKED numbers with LOW_BITS for each of BINS bins.

    Words are runs of anything but ASCII white space, lower-cased. A text of fewer than five words is one shingle, the
    empty text among them. Each step is a column of its own, so that it is computed once.
    """
    words, hashes, shingles, minima, low, high, filled = (f"_{out}_{x}" for x in ("words", "hashes", "shingles", "minima", "low", "high", "filled"))
    kept = df.columns
    step = df.withColumn(words, F.split(F.lower(F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r"))), SPACE))
    step = step.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    last = F.greatest(F.size(hashes) - (SHINGLE - 1), F.lit(1))
    step = step.withColumn(
        shingles, F.sort_array(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(F.col(hashes), i, F.lit(SHINGLE)))))
    )
    bin_of = lambda h: F.shiftright(h, 64 - BIN_BITS).cast("int") + BINS // 2  # noqa: E731 - in the order of the hashes
    step = step.withColumn(
        minima, F.filter(shingles, lambda h, i: (i == 0) | (F.shiftright(h, 64 - BIN_BITS) != F.shiftright(F.get(F.col(shingles), i - 1), 64 - BIN_BITS)))
    )
    bits = lambda of: F.aggregate(minima, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseOR(of(bin_of(h))))
    step = step.withColumn(low, bits(lambda b: F.when(b < 64, _bit(b)).otherwise(F.lit(0).cast("long"))))
    step = step.withColumn(high, bits(lambda b: F.when(b >= 64, _bit(b - 64)).otherwise(F.lit(0).cast("long"))))

    def own(i: Column) -> Column:
        """The minimum of a bin, null if it is empty: minima come in the order of bins, so counting filled bins finds it."""
        half = F.when(i < 64, F.col(low)).otherwise(F.col(high))
        bit, below = _bit(i % 64), F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), i % 64))
        before = F.bit_count(half.bitwiseAND(below)) + F.when(i < 64, 0).otherwise(F.bit_count(F.col(low)))
        return F.when(half.bitwiseAND(bit) != 0, F.get(F.col(minima), before))

    step = step.withColumn(filled, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), own))
    tries = _table([j for o in ORDERS for j in o[:TRIES]], "array<int>")
    orders = _table(ORDERS, "array<array<int>>")
    at = lambda j: F.get(F.col(filled), j)

    def value(i: Column) -> Column:
        first = [at(F.get(tries, i * TRIES + k)) for k in range(TRIES)]
        rest = F.get(F.filter(F.transform(F.get(orders, i), at), lambda x: x.isNotNull()), F.lit(0))
        return F.coalesce(at(i), *first, rest)

    mask = (1 << LOW_BITS) - 1
    pack = lambda w: F.aggregate(
        F.sequence(w * PER_WORD, w * PER_WORD + (PER_WORD - 1)), F.lit(0).cast("long"),
        lambda acc, i: F.shiftleft(acc, LOW_BITS).bitwiseOR(F.xxhash64(value(i), i).bitwiseAND(F.lit(mask).cast("long"))),
    )
    return step.select(*kept, F.transform(F.sequence(F.lit(0), F.lit(PACKED - 1)), pack).alias(out))


def as_text(packed: Column) -> Column:
    """A packed fingerprint as BINS hexadecimal digits."""
    return F.concat(*[F.lpad(F.hex(F.get(packed, F.lit(k))), 16, "0") for k in range(PACKED)])


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, with the chance agreement of low bits taken out; 0 to 1."""
    ones = F.lit(sum(1 << (LOW_BITS * k) for k in range(PER_WORD)))
    differing = F.lit(0)
    for k in range(PACKED):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        any_bit = x
        for shift in range(1, LOW_BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, shift))
        differing = differing + F.bit_count(any_bit.bitwiseAND(ones))
    chance = 1.0 / (1 << LOW_BITS)
    return F.greatest(F.lit(0.0), ((BINS - differing) / float(BINS) - chance) / (1.0 - chance))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars (code points), fingerprint (as text) for each row; a null text counts as empty."""
    slim = docs.select(docs[id_col].alias(id_col), text_of(docs, text_col).alias("_text"))
    slim = with_fingerprint(slim.withColumn("n_chars", F.char_length("_text").cast("long")), "_text", "_packed")
    return slim.select(id_col, "n_chars", as_text(F.col("_packed")).alias("fingerprint"))


def in_order(rows: DataFrame) -> DataFrame:
    """Adds next (a struct h1, h2, copy, packed, id) and previous (h1, h2, copy, n_chars) to rows of (id, h1, h2, copy, n_chars,
    packed), in descending order of ids, null ones last, as a ring.

    Ranges of ids are sorted on their own; the ends of the ranges, one row for each, tell what follows a range.
    """
    order = [F.col("id").desc_nulls_last(), F.col("h1").desc(), F.col("h2").desc(), F.col("copy").desc()]
    count = max(1, -(-rows.count() // RANGE))
    ranges = cut(rows.repartitionByRange(count, *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(*order)
    next_ = F.struct("h1", "h2", "copy", "packed", "id")
    previous = F.struct("h1", "h2", "copy", "n_chars")
    place = F.struct(F.col("id").isNotNull().alias("p"), "id", "h1", "h2", "copy")
    ends = ranges.groupBy("_range").agg(F.max_by(next_, place).alias("top"), F.min_by(previous, place).alias("bottom"))
    down, ring = Window.orderBy("_range"), Window.partitionBy()  # over one row for each range
    ends = ends.select(
        F.col("_range").alias("_r"),
        F.coalesce(F.lead("top").over(down), F.min_by("top", "_range").over(ring)).alias("_next"),
        F.coalesce(F.lag("bottom").over(down), F.max_by("bottom", "_range").over(ring)).alias("_previous"),
    )
    met = ranges.join(ends, F.col("_range") == F.col("_r"))
    return met.select(
        "id", "h1", "h2", "copy", "n_chars", "packed",
        F.coalesce(F.lead(next_).over(inside), F.col("_next")).alias("next"),
        F.coalesce(F.lag(previous).over(inside), F.col("_previous")).alias("previous"),
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with copy, which counts those of one (h1, h2) from 1. They are numbered where they are: a partition counts its own, and
    the counts of the partitions before it, one row for each partition and key, tell where it begins."""
    placed = cut(rows.withColumn("_place", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_place", 33)))
    counts = placed.groupBy("h1", "h2", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("h1", "h2").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("h1", "h2", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("h1", "h2", "_part").orderBy("_place"))
    return placed.withColumn("_own", own).join(counts, ["h1", "h2", "_part"]).withColumn("copy", F.col("_before") + F.col("_own")).select(*rows.columns, "copy")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next row,
    descending by id; after the last comes the first. Null texts count as empty. Null ids come after all others, and rows
    that repeat an id follow each other in an order that their ids and texts fix, equal ones among them. A single row is
    its own next. An empty table gives no rows.
    """
    texts = docs.select(docs[id_col].alias("id"), *row_key(docs, id_col, text_col), text_of(docs, text_col).alias("text"))
    prints = with_fingerprint(texts.withColumn("n_chars", F.char_length("text").cast("long")), "text", "packed")
    prints = cut(prints.select("id", "h1", "h2", "n_chars", "packed"))  # made once, though ranges are sampled before they are dealt
    repeats = cut(prints.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"))
    rows = prints.withColumn("copy", F.lit(1).cast("long"))
    by_key, keys = texts.select("h1", "h2", "text"), ["h1", "h2"]
    if not repeats.isEmpty():  # rows that repeat both the id and the text are told apart by a number
        again = prints.join(repeats.select("h1", "h2"), ["h1", "h2"], "left_semi")
        rows = rows.join(repeats.select("h1", "h2"), ["h1", "h2"], "left_anti").unionByName(_numbered(again))
        by_key, keys = by_key.dropDuplicates(["h1", "h2"]), ["h1", "h2", "copy"]
    places = cut(in_order(rows))

    half = lambda n: F.floor(n / 2).cast("int")
    left = by_key.join(places.drop("previous"), ["h1", "h2"])
    left = left.withColumn("head", F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half(F.col("n_chars")))).drop("text")
    right = by_key.join(places.select("h1", "h2", "previous"), ["h1", "h2"])
    right = right.select("previous.h1", "previous.h2", "previous.copy", F.substring(F.col("text"), F.lit(1), half(F.col("previous.n_chars"))).alias("tail"))
    edited = left.join(right if "copy" in keys else right.drop("copy"), keys).withColumn("edited", F.concat("head", "tail")).drop("head", "tail")
    edited = with_fingerprint(edited, "edited", "edited_packed")
    return edited.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("packed")).alias("fingerprint"), as_text(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next.packed")).alias("near_next"),
        F.col("next.id").alias("next_id"),
    )
