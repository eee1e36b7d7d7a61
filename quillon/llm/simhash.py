"""Near duplicates by SimHash: fingerprints cut into blocks, joined on blocks, verified by Hamming distance.

1. One pass over the texts votes on the bits of each row's fingerprint; texts do not leave their tasks.
2. Rows of one fingerprint form a class, which the fingerprint itself names.
3. Pigeonhole: a fingerprint is cut into `distance + 2` blocks, and `distance` differing bits leave two of them alone. So
   close fingerprints share a pair of blocks, which is the key on which they meet; a spanning forest of the pairs within
   the distance leaves each bucket.
4. A bucket of more than BUCKET fingerprints is not compared pairwise. Its members meet at the midpoints between
   them instead: two fingerprints within two bits are both within one bit of some third value, and at most 65
   fingerprints are within one bit of any value, however full the bucket is.
5. The components of the links are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, dealt, map_batches, text_of, whole_groups, word_pieces
from quillon.llm.components import connected
from quillon.llm.neardup import _edges, _forest, _group_bounds

BITS = 64
#: Fingerprints of a bucket that are compared pairwise at most; larger buckets meet at midpoints.
BUCKET = 1_000
#: Shingles that are hashed in one step.
STEP = 1 << 17
_SEED = 42
_PLACE = (np.arange(8, dtype=np.int64) << 8)[None, :]
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """The SimHash of a text as an unsigned number: a bit is 1 if it is set in over half of the shingles' hashes."""
    votes = np.zeros((8, 256), np.int64)
    total, short = 0, b""
    digest = xxhash.xxh64_intdigest
    for words in word_pieces(raw.lower(), shingle - 1):
        if len(words) < shingle:
            short = b" ".join(words)
            continue
        joined = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(size) - 1
        starts = (ends - size + 1)[: len(words) - shingle + 1]
        ends = ends[shingle - 1 :]
        for k in range(0, len(starts), STEP):
            a, b = starts[k : k + STEP].tolist(), ends[k : k + STEP].tolist()
            own = np.array([digest(joined[x:y], _SEED) for x, y in zip(a, b, strict=True)], "<u8")
            votes += np.bincount((own.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256)
            total += len(own)
    if not total:
        return digest(short, _SEED) if short else 0
    return int(np.packbits(2 * (votes @ _BYTE_BITS) > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, print (the fingerprint as a signed number) for each row."""
    slim = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    fields = slim.select("id").schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.encode(), shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "print"])

    return map_batches(slim, run, f"{fields}, print long")


def block_keys(value: Column, distance: int) -> Column:
    """The keys on which a fingerprint meets others: for each two of its distance + 2 blocks, those blocks' bits and which they are."""
    edges = [round(k * BITS / (distance + 2)) for k in range(distance + 3)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    pairs = list(combinations(masks, 2))
    return F.array(*(F.struct(F.lit(n).alias("which"), value.bitwiseAND(F.lit(signed(p | q)).cast("long")).alias("bits")) for n, (p, q) in enumerate(pairs)))


def _bucket_links(rows: DataFrame, distance: int) -> DataFrame:
    """Forests (a, b) of the pairs within the distance in each bucket of (which, bits, print), sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["which", "bits"]):
            prints = table.column("print").to_numpy()
            own = prints.view(np.uint64)
            bound = _group_bounds(table, ["which", "bits"])
            size = np.diff(bound)
            group, full = np.repeat(np.arange(len(size)), size), np.repeat(size, size)
            out_a, out_b = [], []
            for k in range(1, 8):  # small buckets: all pairs, by their distance in the table
                i = np.flatnonzero((full[:-k] <= 8) & (group[:-k] == group[k:])) if len(own) > k else np.empty(0, np.int64)
                i = i[np.bitwise_count(own[i] ^ own[i + k]) <= distance]
                out_a.append(prints[i])
                out_b.append(prints[i + k])
            for g in np.flatnonzero(size > 8).tolist():
                part, names = own[bound[g] : bound[g + 1]], prints[bound[g] : bound[g + 1]]
                near = lambda i, left: np.bitwise_count(part[left] ^ part[i]) <= distance  # noqa: B023, E731
                if links := _forest(len(part), near):
                    a, b = np.array(links).T
                    out_a.append(names[a])
                    out_b.append(names[b])
            yield _edges(out_a, out_b)

    return map_batches(rows.select("which", "bits", "print"), run, "a long, b long")


def _midpoint_links(prints: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) of distinct fingerprints (print) one or two bits apart, however many share their blocks.

    Each fingerprint goes to itself and to its 64 neighbours. Two fingerprints two bits apart meet at the two values between
    them, and all that meet at a value are within two bits of one another, so that the smallest is linked to each. For a
    distance of one, those who meet at a fingerprint are linked to it.
    """
    flips = (F.col("print").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")) for k in range(BITS))
    met = prints.select("print", F.explode(F.array("print", *flips)).alias("middle"))
    centre = F.col("print") if distance == 2 else F.when(F.col("print") == F.col("middle"), F.col("print"))
    stars = met.groupBy("middle").agg(F.min(centre).alias("a"), F.count("*").alias("n")).where("n > 1 and a is not null")
    return met.join(stars.select("middle", "a"), "middle").where("print <> a").select("a", F.col("print").alias("b")).distinct()


def links(prints: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (print), whose components are those of all pairs within the distance."""
    keyed = prints.select("print", F.explode(block_keys(F.col("print"), distance)).alias("k")).select("print", "k.which", "k.bits")
    sizes = cut(keyed.groupBy("which", "bits").agg(F.count("*").alias("n")).where("n > 1"))
    met = keyed.join(sizes.where(F.col("n") <= bucket).select("which", "bits"), ["which", "bits"])
    out = _bucket_links(dealt(met, "which", "bits").sortWithinPartitions("which", "bits"), distance)
    hot = sizes.where(F.col("n") > bucket).select("which", "bits")
    if distance and not hot.isEmpty():
        crowd = cut(keyed.join(hot, ["which", "bits"]).select("print").distinct())
        out = out.unionByName(_midpoint_links(crowd, distance))
    return out


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fingerprint (16 lower-case hex digits), component_id.

    Texts are lower-cased (A-Z) and cut at ASCII white space; their shingles, repeats counted, are hashed by XXH64 with seed 42.
    A text of fewer words than a shingle has one, all its words; one without words (or null) has the fingerprint zero, which
    is linked like any other. Rows whose fingerprints differ in at most `distance` bits are linked; component_id
    is the smallest id reachable, null only where no row of a component has an id. Rows that repeat an id are documents of
    their own. Ids may be of any ordered type; other columns are not looked at; an empty table gives no rows.
    `distance` is 0, 1 or 2: what midpoints answer exactly.
    """
    if distance not in (0, 1, 2):
        raise ValueError("distance is 0, 1 or 2")
    signed = cut(fingerprints(docs, shingle, id_col, text_col))
    classes = cut(signed.groupBy("print").agg(F.min("id").alias("least")))
    roots = connected(links(classes.select("print"), distance)).select(F.col("id").alias("print"), F.col("component").alias("root"))
    rooted = cut(classes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("print", "component_id")
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return signed.join(named, "print").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")
