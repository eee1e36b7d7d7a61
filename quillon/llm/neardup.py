"""Near duplicates: banded MinHash, odd sketches for candidates, links confirmed on full sets.

1. One pass over the texts gives each row its number of distinct shingles, a 128-bit digest of the set, the keys
   of its MinHash bands, and an odd sketch: a parity bitmap into which each sample is folded.
2. Rows of one digest form a class, which one of them stands for.
3. Classes that share a band key meet. Two sketches' XOR population count estimates the similarity; a
   spanning forest of the pairs that may reach the threshold, with a wide margin, leaves each bucket.
4. The forests' components are clusters: whatever is linked is in one cluster. A cluster's full sets are
   then compared exactly. Each set is compared only with those that are not yet reached, and large clusters
   and buckets are cut into blocks, by rows and by shingles, that meet pairwise, so that no task holds more than
   two blocks.
5. The components of the confirmed links are the result.

The texts are read twice. They stay where they are, but for those of classes in clusters, which a filter of bounded size
finds before the shuffle; these are moved once, and their sets once for each two blocks that meet. No pairs within groups
are ever written. Rows are numbered inside, so that ids may be of any type, repeat, or be null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import UPPER, cut, keep_one, key_filter, map_batches, row_key, text_of, whole_groups
from quillon.llm.components import connected

SAMPLES = 256
ROWS, BANDS = 4, 32
SKETCH_BITS = 512
#: How far below the threshold an estimate may be for a pair to be looked at: six standard errors (0.04 each at 0.8).
MARGIN = 0.25
#: Members that a block of a bucket has at most, about, or STEP times the root of the bucket's members if that is more: so
#: neither blocks nor the number of blocks that a member is in grow faster than the root. The same for clusters, whose
#: members are sets, and the shingles that a block of sets has at most.
BLOCK, STEP = 500, 10
SET_BLOCK, SET_STEP, BLOCK_SHINGLES = 2_000, 20, 2 << 20

_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input reaches every bit of the output."""
    x = x + _U((0x632BE59BD9B4E019 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = 1 << 20
    one = np.full(n, _BASE, np.uint64)
    one[0] = 1
    back = np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    back[0] = 1
    return np.multiply.accumulate(one), np.multiply.accumulate(back)


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of a text's words in order: polynomials over their bytes, A-Z lower-cased."""
    data = np.frombuffer(raw.translate(_LOWER), np.uint8)
    space = _IS_SPACE[data]
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, back = _powers()
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):  # stretches that the table of powers covers
        at = starts[done]
        upto = max(done + 1, int(np.searchsorted(ends, at + len(power) - 1, "right")))
        if ends[done] - at > len(power) - 1:  # one word beyond the table
            value = 0
            for k in range(int(at), int(ends[done]), len(power) - 1):
                part = data[k : min(int(ends[done]), k + len(power) - 1)].astype(np.uint64)
                value = (value * 0x100000001B3 + int((part * power[: len(part)]).sum(dtype=np.uint64))) % 2**64
            out[done] = value
            done += 1
            continue
        part = data[at : ends[upto - 1]].astype(np.uint64) + _U(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        a, b = starts[done:upto] - at, ends[done:upto] - at
        out[done:upto] = mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))
        done = upto
    return out


def shingle_set(raw: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; with fewer words, the whole sequence is one."""
    words = word_hashes(raw)
    if not len(words):
        return words
    width = min(size, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = mix(out ^ words[k : len(words) - width + 1 + k], k)
    return np.unique(out if width == size else mix(out, 100 + width))


@lru_cache(maxsize=1)
def _ranks() -> np.ndarray:
    """For each bin, the place of every other in its own fixed random order."""
    return np.random.RandomState(7).rand(SAMPLES, SAMPLES).argsort(1).argsort(1).astype(np.int16)


def samples(hashes: np.ndarray) -> np.ndarray:
    """One-permutation MinHash with optimal densification: SAMPLES values of a sorted set of hashes."""
    bins = (hashes >> _U(56)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    filled = bins[first]
    out = np.empty(SAMPLES, np.uint64)
    out[filled] = hashes[first]
    if len(filled) < SAMPLES:
        empty = np.ones(SAMPLES, bool)
        empty[filled] = False
        empty = np.flatnonzero(empty)
        out[empty] = hashes[first[_ranks()[np.ix_(empty, filled)].argmin(1)]]
    return out


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketch (as 64-bit words) of a set."""
    own = mix(samples(hashes) + np.arange(SAMPLES, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
    rows = own[: ROWS * BANDS].reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = mix(keys ^ rows[:, k], k)
    bits = np.bincount((own >> _U(20)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return keys, np.packbits(bits.astype(np.uint8)).view(np.uint64)


def differing_bits(similarity: float) -> float:
    """The XOR population count that odd sketches of sets of this similarity have on average."""
    return SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * SAMPLES * (1 - similarity)))


def estimated(bits: np.ndarray) -> np.ndarray:
    """Estimated similarity for XOR population counts of two odd sketches."""
    part = np.clip(1 - 2 * np.asarray(bits, float) / SKETCH_BITS, 1e-9, 1)
    return np.clip(1 + SKETCH_BITS / (4 * SAMPLES) * np.log(part), 0, 1)


def signatures(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """id, h1, h2 (row_key), n_shingles, set_high, set_low, keys, sketch for each row."""
    slim = docs.select(docs[id_col].alias("id"), *row_key(docs, id_col, text_col), text_of(docs, text_col).alias("text"))
    fields = slim.select("id", "h1", "h2").schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, high, low, keys, sketches = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text.encode(), shingle)
                counts.append(len(s))
                if len(s):
                    k, sketch = signature(s)
                    high.append(int(mix(s, 11).sum(dtype=np.uint64).view(np.int64)))
                    low.append(int(mix(s, 12).sum(dtype=np.uint64).view(np.int64)))
                    keys.append(k.view(np.int64))
                    sketches.append(sketch.tobytes())
                else:
                    high.append(0)
                    low.append(0)
                    keys.append(np.empty(0, np.int64))
                    sketches.append(b"")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(x, pa.int64()) for x in (counts, high, low)), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["id", "h1", "h2", "n_shingles", "set_high", "set_low", "keys", "sketch"],
            )

    return map_batches(slim, run, f"{fields}, n_shingles long, set_high long, set_low long, keys array<long>, sketch binary")


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """rows (key, parts, id, text) with the text's packed shingle set instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.encode(), shingle).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], ["key", "parts", "id", "set"])

    return map_batches(rows.select("key", "parts", "id", "text"), run, "key long, parts long, id long, set binary")


def parts_of(members: Column, block: int, step: int) -> Column:
    """The number of parts that a group of so many members is cut into."""
    return F.ceil(members / F.greatest(F.lit(float(block)), step * F.sqrt(members)))


def in_blocks(df: DataFrame) -> DataFrame:
    """Rows of (key, parts, id, ...) with a column block instead of parts: a group's rows are dealt into its parts, and
    each two parts meet in a block of their own. Rows come sorted by (key, block), whole blocks in one partition."""
    own = F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    split = df.withColumn("own", own).withColumn("other", other)
    block = F.least("own", "other") * F.col("parts") + F.greatest("own", "other")
    split = split.withColumn("block", block).drop("parts", "own", "other")
    return split.repartition("key", "block").sortWithinPartitions("key", "block", "id")


def _forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the graph on 0..n-1; near(i, others) tells which of others are linked with i.
    A vertex that is reached is compared with unreached ones only."""
    left = np.arange(n)
    out: list[tuple[int, int]] = []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = near(i, left)
            if hit.any():
                new = left[hit]
                left = left[~hit]
                out += [(i, int(j)) for j in new]
                todo += new.tolist()
    return out


_EDGES = "a long, b long"


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    none = np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])


def _group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.r_[np.flatnonzero(change), table.num_rows]


def candidate_links(rows: DataFrame, floor: float) -> DataFrame:
    """Forests (a, b) of the pairs in each block of (key, block, id, sketch) whose estimate reaches floor."""
    most = differing_bits(floor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "block"]):
            ids = table.column("id").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(ids), -1)
            bound = _group_bounds(table, ["key", "block"])
            size = np.repeat(np.diff(bound), np.diff(bound))
            group = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
            out_a, out_b = [], []
            for k in range(1, 8):  # small groups: all pairs, by distance in the table
                i = np.flatnonzero((size[:-k] <= 8) & (group[:-k] == group[k:])) if len(ids) > k else np.empty(0, np.int64)
                if len(i):
                    i = i[np.bitwise_count(sketch[i] ^ sketch[i + k]).sum(1) <= most]
                    out_a.append(ids[i])
                    out_b.append(ids[i + k])
            for g in np.flatnonzero(np.diff(bound) > 8).tolist():
                own, own_ids = sketch[bound[g] : bound[g + 1]], ids[bound[g] : bound[g + 1]]
                near = lambda i, left: np.bitwise_count(own[left] ^ own[i]).sum(1) <= most  # noqa: B023, E731
                if links := _forest(len(own), near):
                    a, b = np.array(links).T
                    out_a.append(own_ids[a])
                    out_b.append(own_ids[b])
            yield _edges(out_a, out_b)

    return map_batches(rows.select("key", "block", "id", "sketch"), run, _EDGES)


def exact_links(rows: DataFrame, percent: int) -> DataFrame:
    """Forests (a, b) of the links in each block of (key, block, id, set), confirmed on full sets."""

    def links(ids: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(s) for s in sets])
        _, terms = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        start = np.r_[0, np.cumsum(size)]
        order = np.argsort(terms, kind="stable")
        posting, where = owner[order], np.r_[0, np.cumsum(np.bincount(terms))]

        def near(i: int, left: np.ndarray) -> np.ndarray:
            mine = terms[start[i] : start[i + 1]]
            if len(left) <= 16:
                common = np.array([len(np.intersect1d(mine, terms[start[j] : start[j + 1]], assume_unique=True)) for j in left.tolist()])
            else:
                lists = [posting[where[t] : where[t + 1]] for t in mine.tolist()]
                common = np.bincount(np.concatenate(lists), minlength=len(sets))[left]
            return 100 * common >= percent * (size[i] + size[left] - common)

        found = _forest(len(sets), near)
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return ids[a], ids[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "block"], 2_000):
            ids = table.column("id").to_numpy()
            bound = _group_bounds(table, ["key", "block"])
            out_a, out_b = [], []
            packed = table.column("set")
            for lo, hi in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
                sets = [np.frombuffer(packed[k].as_py(), np.uint64) for k in range(lo, hi)]
                if hi - lo == 2:
                    common = len(np.intersect1d(*sets, assume_unique=True))
                    if 100 * common >= percent * (len(sets[0]) + len(sets[1]) - common):
                        out_a.append(ids[lo : lo + 1])
                        out_b.append(ids[lo + 1 : hi])
                else:
                    a, b = links(ids[lo:hi], sets)
                    out_a.append(a)
                    out_b.append(b)
            yield _edges(out_a, out_b)

    return map_batches(rows.select("key", "block", "id", "set"), run, _EDGES)


def _groups(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, h1, h2, n_shingles, root, component_id for each row: root is a number that the rows of a component share."""
    signed = cut(signatures(docs, shingle, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    filled = signed.where("n_shingles > 0")
    digest = ["set_high", "set_low", "n_shingles"]
    classes = cut(filled.groupBy(*digest).agg(F.min("row").alias("rep"), F.min("id").alias("least_id")))
    first = cut(filled.join(classes.select(F.col("rep").alias("row")), "row", "left_semi"))

    keyed = first.select(F.col("row").alias("id"), F.explode("keys").alias("key"))
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = keyed.join(shared.select("key", parts_of(F.col("n"), BLOCK, STEP).alias("parts")), "key")
    met = met.join(first.select(F.col("row").alias("id"), "sketch"), "id")
    clusters = connected(candidate_links(in_blocks(met), percent / 100 - MARGIN))

    inside = cut(clusters.join(first.select(F.col("row").alias("id"), "h1", "h2", "n_shingles"), "id"))
    size = cut(inside.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")))
    parts = F.greatest(parts_of(F.col("n"), SET_BLOCK, SET_STEP), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    wanted = inside.join(size.select("component", parts.alias("parts")), "component").select("h1", "h2", "id", F.col("component").alias("key"), "parts")
    maybe, _ = key_filter(inside.select("h1", "h2"))
    texts = docs.select(*row_key(docs, id_col, text_col), text_of(docs, text_col).alias("text")).where(maybe)
    texts = texts.groupBy("h1", "h2").agg(F.any_value("text").alias("text")).join(wanted, ["h1", "h2"])
    links = exact_links(in_blocks(shingle_sets(texts, shingle)), percent)

    linked = cut(connected(links).select(F.col("id").alias("rep"), F.col("component").alias("root")).join(classes.select("rep", "least_id"), "rep"))
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = linked.select("rep", "root").join(least, "root")
    named = classes.join(named, "rep", "left").select(
        *digest, F.coalesce("root", "rep").alias("root"), F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("least_id")).alias("component_id")
    )
    columns = ["id", "h1", "h2", "n_shingles", "root", "component_id"]
    apart = signed.where("n_shingles = 0").select("id", "h1", "h2", "n_shingles", F.col("row").alias("root"), F.col("id").alias("component_id"))
    return filled.join(named, digest).select(*columns).unionByName(apart)


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Rows are linked when 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest id reachable over links, kept tells the row that has it. Texts are lower-cased (A-Z) and cut at ASCII
    white space. A text of fewer words than a shingle has one shingle, all its words; one without words (or null)
    has none and is linked with nothing. Ids may be of any ordered type. A row with a null id is a document like
    others, and its component_id is null only if no row of the component has an id; rows that repeat an id are
    documents of their own. An empty table gives no rows.
    """
    out = _groups(docs, shingle, percent, id_col, text_col)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each component, with all their columns: that of the smallest id, and of rows
    that repeat it one. Rows without words all stay."""
    kept = (F.col("n_shingles") == 0) | F.col("id").eqNullSafe(F.col("component_id"))
    decided = cut(_groups(docs, shingle, percent, id_col, text_col).select("h1", "h2", F.col("root").alias("group"), kept.alias("kept")))
    return keep_one(docs, decided, id_col, text_col)
