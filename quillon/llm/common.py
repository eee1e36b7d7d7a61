"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII takes the quick way, where lower() means the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def text_of(docs: DataFrame, text_col: str = "text") -> Column:
    """The text of a document; null counts as empty."""
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows are written to the shared folder once and read from there."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this package wrote, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spent(df: DataFrame) -> None:
    """Deletes the files of a cut() table that nothing reads any more."""
    plan = df._jdf.logicalPlan()
    file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
    if file is not None and file.isDefined():
        remove(df.sparkSession, file.get())


#: Bytes of a batch that Python code sees at once, about; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20


def smaller(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many bytes, or of one row."""
    if batch.num_rows < 2 or batch.nbytes <= most:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from smaller(batch.slice(0, half), most)
        yield from smaller(batch.slice(half), most)


def give_back() -> None:
    """Returns what is free to the system. Workers outlive their tasks, and idle ones count beside the JVM in an executor's memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """mapInArrow over batches of at most BATCH_BYTES, about: as Python objects a batch is held several times over.
    A task that ends leaves its worker no memory but what is in use."""

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(part for batch in batches for part in smaller(batch))
        finally:
            give_back()

    return df.mapInArrow(sized, schema)


#: Bytes of a text that are cut into words in one step.
PIECE = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_pieces(raw: bytes, overlap: int = 0) -> Iterator[list[bytes]]:
    """A text's words (runs of anything but ASCII white space) in lists of about PIECE bytes, so that a long text is never held
    as a list of all its words. Each list but the first begins with the last words before it, as many as overlap says."""
    held: list[bytes] = []
    begin = 0
    while begin < len(raw):
        blank = _BLANK.search(raw, min(len(raw), begin + PIECE))  # a word is not cut
        end = blank.start() if blank else len(raw)
        held += raw[begin:end].split()
        yield held
        held = held[max(0, len(held) - overlap) :] if overlap else []
        begin = end


def row_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits that tell rows of different ids or texts apart, whatever type the id has; a null id is an id of its own."""
    text = text_of(docs, text_col)
    return F.xxhash64(docs[id_col], text).alias("h1"), F.xxhash64(text, docs[id_col], F.lit(1)).alias("h2")


def with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (all columns of docs), h1, h2. Columns of docs stay inside the struct, so that no name of theirs can clash."""
    return docs.select(F.struct("*").alias("row"), *row_key(docs, id_col, text_col))


#: Bits of a filter for each key, and bits of a filter at most: 8 MB, whatever the number of keys.
FILTER_BITS_PER_KEY, FILTER_BITS = 16, 1 << 26


def key_filter(keys: DataFrame) -> tuple[Column, int]:
    """A Bloom filter over keys (h1, h2): a condition on columns h1 and h2 that holds for every key, and the number of keys.

    The filter has a bounded size. Beyond four million keys it lets more of the other rows through, and all of them in
    the end: it spares a shuffle, and the join that follows decides.
    """
    count = keys.count()
    size = 1 << 10
    while size < min(FILTER_BITS, count * FILTER_BITS_PER_KEY):
        size <<= 1
    places = [F.col("h1"), F.shiftrightunsigned("h1", 32), F.col("h2"), F.shiftrightunsigned("h2", 32)]
    places = [p.bitwiseAND(F.lit(size - 1)) for p in places]
    bit = lambda p: p.bitwiseAND(63).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("place")))
    words = keys.select(F.explode(F.array(*places)).alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    every = keys.sparkSession.range(size >> 6).select(F.col("id").alias("word")).join(words, "word", "left")
    filled = F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    bits = cut(every.agg(F.transform(filled, lambda w: w["bits"]).alias("bits"))).scalar()  # one row of FILTER_BITS at most
    hits = [F.call_function("shiftright", F.get(bits, F.shiftright(p, 6).cast("int")), bit(p)).bitwiseAND(F.lit(1)) == 1 for p in places]
    return hits[0] & hits[1] & hits[2] & hits[3], count


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose key (row_key) is not among gone (h1, h2: distinct, cut). Rows that cannot be among them by
    the filter stay where they are; only the others are moved and joined. docs is read twice and has to give the same rows."""
    rows = with_key(docs, id_col, text_col)
    maybe, count = key_filter(gone)
    if not count:
        return docs
    asked = rows.where(maybe).join(gone, ["h1", "h2"], "left_anti")
    return rows.where(~maybe).select("row.*").unionByName(asked.select("row.*"))


def keep_one(docs: DataFrame, decided: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that stay, given h1, h2, group and kept for each row: kept ones, and of the kept ones of a group
    only one, that of the smallest key. Rows that repeat a key repeat a row's id and text, and one of them stays."""
    gone = decided.where(~F.col("kept")).select("h1", "h2")
    crowded = cut(decided.where("kept").groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group"))
    if crowded.isEmpty():
        return without(docs, cut(gone.distinct()), id_col, text_col)
    rivals = decided.where("kept").join(crowded, "group")
    best = cut(rivals.groupBy("group").agg(F.min(F.struct("h1", "h2")).alias("best")))
    losers = rivals.join(best, "group").where(F.struct("h1", "h2") != F.col("best")).select("h1", "h2")
    left = with_key(without(docs, cut(gone.unionByName(losers).distinct()), id_col, text_col), id_col, text_col)
    one = best.select("best.h1", "best.h2")
    repeats = left.join(one, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    return left.join(one, ["h1", "h2"], "left_anti").unionByName(repeats).select("row.*")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys in one partition, for Python code that takes groups from sorted rows.

    repartition(*keys) does not promise this behind a join on the same keys: the planner leaves that shuffle out, and once the
    join turns out small it reads what was shuffled for the join by the tasks that wrote it. A hash of the keys is no key of a join.
    """
    return df.repartition(F.xxhash64(*keys))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 50_000, size: int = 32 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups, about `rows` rows or `size` bytes each, from batches that are sorted by their keys."""
    held: list[pa.RecordBatch] = []
    count = held_bytes = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        held_bytes += batch.nbytes
        if count < rows and held_bytes < size:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(table.num_rows, bool)
        for k in keys:
            column = table.column(k).to_numpy()
            last &= column == column[-1]
        end = table.num_rows - int(last[::-1].argmin()) if not last.all() else 0
        if end:
            yield table.slice(0, end)
        held, count, held_bytes = table.slice(end).to_batches(), 0, 0  # a group that goes on is looked at after as many rows again
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
