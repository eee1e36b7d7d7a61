"""Best-fit packing of tokenized documents into sequences, by hierarchical rounds.

Each partition packs its own pieces best-fit decreasing. Nearly full bins are final; underfull ones become
items of the next round, in which fewer partitions each get the bins of several, up to a bounded number, and
so on until one partition is left or rounds bring nothing more. A bin carries its members, of which there
are at most as many as it has tokens.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm.common import cut, map_batches, smaller, text_of

CAPACITY = 1024
END_ID = 2
#: Bins with at most so many free places are final.
SLACK = 4
#: Items that one partition packs at once, and bins that a partition of a later round gets, about.
BLOCK, FAN_IN_ROWS, FAN_IN = 200_000, 50_000, 8
#: Words whose ids a worker remembers, and bytes of them and their ids; both of two generations, so half of it for each.
WORDS, WORD_BYTES = 400_000, 64 << 20
#: Bytes of texts that are cut into words at once: only distinct words become Python objects.
SLICE_BYTES = 2 << 20

#: White space beyond ASCII. Runs of white space that hold some are left to the library.
_WIDE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _blank(data: np.ndarray) -> np.ndarray:
    """Which bytes are white space in ASCII."""
    return (data == 32) | (data - 9 < 5)  # of unsigned bytes


def _binary(ends: np.ndarray, data: pa.Buffer) -> pa.Array:
    """Values that lie one behind the other in data, each from one of the ends to the next."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), data])


def _ends(values: pa.Array) -> np.ndarray:
    return np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]


def _objects(values: pa.Array) -> list[bytes]:
    return values.to_numpy(zero_copy_only=False).tolist()


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words, each with the white space before it (white space at the end of a text is one more), and where those of
    each text end: large strings are cut in place, without an object for each word."""
    ends = _ends(texts) if len(texts) else np.zeros(1, np.int64)
    if ends[0] == ends[-1]:
        return pa.array([], pa.large_binary()), np.zeros(len(ends), np.int64)
    data = texts.buffers()[2]
    blank = _blank(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]])
    begins = np.r_[False, blank[1:] & ~blank[:-1]]
    begins[ends[:-1][ends[:-1] < ends[1:]] - ends[0]] = True
    places = np.r_[np.flatnonzero(begins) + ends[0], ends[-1]]
    return _binary(places, data), np.searchsorted(places, ends)


class Ids:
    """Ids of byte-level BPE, by word: a word with the white space before it is always encoded alike.

    The words of a batch are told apart in Arrow, and only distinct ones are looked up. New words go through the same
    vocabulary as ranks, many at once, parted by line ends; words with special strings or other white space, and texts
    with white space beyond ASCII, go through the tokenizers file.
    Words are remembered in two generations: once the younger is full it becomes the older, and what was the older is
    forgotten, but for words that were met again meanwhile.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str) -> None:
        self.library = Tokenizer.from_file(path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.quick = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.line_end = self.quick.encode_ordinary("\n")[0]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0  # bytes of known

    def by_library(self, raw: bytes) -> bytes:
        return np.array(self.library.encode(raw.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[bytes], odd: set[bytes]) -> None:
        """Remembers distinct words of one batch, whose texts bound what it adds; odd ones are for the library."""
        older = self.older
        if again := {word: older[word] for word in words if word in older}:
            self.known.update(again)
            self.held += sum(map(len, again)) + sum(map(len, again.values()))
            words = [word for word in words if word not in again]
        plain = [word for word in words if word not in odd]
        if plain:
            joined = b"\n".join(plain)
            ids = np.array(self.quick.encode_ordinary(joined.decode()), "<u4")
            lines = np.flatnonzero(ids == self.line_end)
            if len(lines) + 1 != len(plain):
                raise ValueError("line ends do not part the words")
            ends = np.r_[0, lines - np.arange(len(lines)), len(ids) - len(lines)] * 4
            self.known.update(zip(plain, _objects(_binary(ends, pa.py_buffer(ids[ids != self.line_end]))), strict=True))
            self.held += len(joined) - len(lines) + int(ends[-1])
        for word in odd.intersection(words):
            self.known[word] = ids_ = self.by_library(word)
            self.held += len(word) + len(ids_)

    def age(self) -> None:
        self.older, self.known = self.known, {}
        self.held = 0

    def words(self, values: pa.Array) -> pa.Array:
        """Ids of each word, of distinct ones."""
        first, ends, data = _ends(values)[:-1], _ends(values)[1:], np.frombuffer(values.buffers()[2], np.uint8)
        strange = _blank(data[first]) & ((data[first] != 32) | _blank(data[np.minimum(first + 1, ends - 1)]))
        strange |= pc.match_substring(values, "<|").to_numpy(zero_copy_only=False)
        odd = set(_objects(values.filter(pa.array(strange))))
        words = _objects(values)
        missing = [word for word in words if word not in self.known]
        if missing and (len(self.known) + len(missing) > WORDS // 2 or self.held > WORD_BYTES // 2):
            self.age()
            missing = words
        if missing:
            self.learn(missing, odd)
        return pa.array(map(self.known.__getitem__, words), pa.large_binary(), size=len(words))

    def batch(self, texts: pa.Array | list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers."""
        column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        wide = pc.match_substring_regex(column, _WIDE).to_numpy(zero_copy_only=False)
        words, upto = chunks(column.filter(pa.array(~wide)) if wide.any() else column)
        whole = memoryview(b"")
        if len(words):
            coded = words.dictionary_encode()
            ids = self.words(coded.dictionary).take(coded.indices)
            upto, whole = _ends(ids)[upto], memoryview(ids.buffers()[2])
        bounds = pairwise(upto.tolist())
        for k, by_library in enumerate(wide.tolist()):
            if by_library:
                yield self.by_library(column[k].as_py().encode())
            else:
                begin, end = next(bounds)
                yield bytes(whole[begin:end])


@lru_cache(maxsize=2)
def ids_of(path: str, ranks_path: str, pattern: str) -> Ids:
    return Ids(path, ranks_path, pattern)


def pieces(docs: DataFrame, tokenizer: tuple[str, str, str], capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32: the pieces of each document's ids, end_id after the last.

    Documents of more than `capacity` ids are cut into pieces of that many, of which the first may be
    shorter. A null or empty text is one piece that holds end_id only.
    """
    slim = docs.select(docs[id_col].alias(id_col), text_of(docs, text_col).alias("_text"))
    fields = slim.select(id_col).schema.simpleString()[len("struct<") : -1]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(*tokenizer)
        for whole in batches:
            for batch in smaller(whole, SLICE_BYTES):
                rows, number, start, length, crc = [], [], [], [], []
                for k, ids in enumerate(encode.batch(batch.column(1))):
                    ids += end
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)]
                    for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(k)
                        number.append(p)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32())]
                arrays += [pa.array(x, pa.int64()) for x in (start, length, crc)]
                yield pa.RecordBatch.from_arrays(arrays, [id_col, "piece", "start", "length", "ids_crc32"])

    return map_batches(slim, run, f"{fields}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, best-fit decreasing; ties in the order of the items."""
    bins = np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, count
            count += 1
        bins[i] = b
        room -= size
        if room:
            free[room].append(b)
            mask |= 1 << room
    return bins


def _pack(table: pa.Table, capacity: int) -> pa.RecordBatch:
    """Bins of bins: fill, members, with places of members moved to where their bin now starts."""
    fills = table.column("fill").to_numpy()
    members = table.column("members").combine_chunks()
    if isinstance(members, pa.ChunkedArray):
        members = members.chunk(0)
    bins = best_fit(fills, capacity)
    order = np.lexsort((np.arange(len(bins)), bins))
    bound = members.offsets.to_numpy().astype(np.int64)
    counts = np.diff(bound)[order]
    ends = np.cumsum(counts)
    index = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(bound[:-1][order], counts)
    flat = members.values.take(pa.array(index))
    fill = fills[order]
    first = np.r_[True, np.diff(bins[order]) != 0]
    upto = np.cumsum(fill)
    start = upto - fill
    moved = start - start[first][np.cumsum(first) - 1]
    place = flat.field("offset").to_numpy() + np.repeat(moved, counts)
    columns = [flat.field(f.name) if f.name != "offset" else pa.array(place, pa.int64()) for f in flat.type]
    struct = pa.StructArray.from_arrays(columns, fields=list(flat.type))
    firsts = np.flatnonzero(first)
    sums = np.add.reduceat(fill, firsts)
    offsets = np.r_[(ends - counts)[firsts], ends[-1]]
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)
    return pa.RecordBatch.from_arrays([pa.array(sums, pa.int64()), lists], ["fill", "members"])


def _round(bins: DataFrame, capacity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= BLOCK:
                yield _pack(pa.Table.from_batches(held).combine_chunks(), capacity)
                held, count = [], 0
        if held:
            yield _pack(pa.Table.from_batches(held).combine_chunks(), capacity)

    return map_batches(bins, run, bins.schema)


def pack(docs: DataFrame, tokenizer: tuple[str, str, str], capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their places: id, piece, start, length, ids_crc32, sequence_id, offset.

    tokenizer: the tokenizers file, the same vocabulary as ranks, and the pattern of its pre-tokens. Rows
    that repeat an id are packed as documents of their own, with equal columns but for their place. Null ids
    stay null. An empty table gives no rows. Reruns over the same files give the same sequences.
    """
    cut_pieces = cut(pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    member = F.struct(*[F.col(c) for c in cut_pieces.columns], F.lit(0).cast("long").alias("offset"))
    bins = cut_pieces.select(F.col("length").alias("fill"), F.array(member).alias("members"))
    done = [bins.where(F.col("fill") >= capacity - slack)]
    todo = bins.where(F.col("fill") < capacity - slack)
    parts, before = cut_pieces.rdd.getNumPartitions(), None
    while True:
        packed = cut(_round(todo, capacity))
        done.append(packed.where(F.col("fill") >= capacity - slack))
        todo = packed.where(F.col("fill") < capacity - slack)
        left = todo.count()
        least = -(-left // FAN_IN_ROWS)
        if left <= 1 or parts == 1 or (before is not None and parts <= least and left > 0.98 * before):
            done.append(todo)
            break
        parts, before = max(1, least, -(-parts // FAN_IN)), left
        key = F.xxhash64(F.col("members")[0][id_col], F.col("members")[0]["piece"], F.col("members")[0]["ids_crc32"])
        todo = todo.repartition(parts, key).sortWithinPartitions("fill", key)
    every = reduce(DataFrame.unionByName, done).withColumn("sequence_id", F.monotonically_increasing_id())
    out = every.select("sequence_id", F.explode("members").alias("m"))
    return out.select(*[F.col(f"m.{c}").alias(c) for c in cut_pieces.columns], "sequence_id", F.col("m.offset").alias("offset"))
