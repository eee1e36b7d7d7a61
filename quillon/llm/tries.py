"""Prefix trie of conversations, by partition refinement.

1. Turns are put in order by ranges of (conversation, turn), so that a conversation of any length is numbered by several tasks;
   what lies in earlier ranges is one number a range. From here on a turn is 128 bits of hash and a number of bytes.
2. Conversations are rebuilt: the head of one of their family, then their own turns.
3. Equal conversations are counted and stand as one.
4. Refinement: all begin in one class. A round looks at the next turns of the active classes' members (one turn, then two, four, up to
   WIDTH) and splits each class at each of them. A member that is alone retires: the rest of it is a unary chain that needs no round.
5. Fold: a node belongs to its smallest member, so what a member owns below a depth is a sum along it, and a subtree is the sum over
   the members of its top. Those sums are combined before they are moved.

No class is ever gathered: members carry the smallest id of their class, which names the node together with the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import cut, map_batches, spent

#: Turns by which a round refines at most.
WIDTH = 64
#: Turns of a conversation that meet what is known of it in one group, as a power of two.
SLICE = 16
#: Bytes of a list of ids that travel as one row.
PIECE = 1 << 16
#: What stands for a null id inside: smaller than all others.
NO_ID = -(1 << 63)
EMPTY = hashlib.sha256(b"").hexdigest()


def _decimal(c: Column) -> Column:
    return F.when(c == NO_ID, F.lit("")).otherwise(c.cast("string"))


def _given(c: Column) -> Column:
    return F.when(c != NO_ID, c)


def ordered(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """c (id), pos (1, 2, ... by turn), bytes of the text, upto (bytes of the turns up to this one), x1, x2 (hash of role and text)."""
    text = lambda name: F.coalesce(turns[name].cast("string"), F.lit(""))
    slim = turns.select(
        F.coalesce(turns[id_col].cast("long"), F.lit(NO_ID)).alias("c"), turns[turn_col].alias("turn"), F.octet_length(text(text_col)).cast("long").alias("bytes"),
        F.xxhash64(text(role_col), text(text_col)).alias("x1"), F.xxhash64(text(text_col), text(role_col), F.lit(1)).alias("x2"), F.monotonically_increasing_id().alias("place"),
    )
    keys = ["c", "turn", "x1", "x2", "place"]  # the last tells equal rows apart, so that ranges can cut between them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, pos, upto = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            c, size = batch.column("c").to_numpy(), batch.column("bytes").to_numpy()
            begin = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            length = np.diff(np.append(begin, len(c)))
            sums = np.cumsum(size)
            own_pos = np.arange(1, len(c) + 1) - np.repeat(begin, length)
            own_upto = sums - np.repeat(sums[begin] - size[begin], length)
            if c[0] == last:
                own_pos[: length[0]] += pos
                own_upto[: length[0]] += upto
            last, pos, upto = c[-1], own_pos[-1], own_upto[-1]
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(np.full(len(c), part)), pa.array(own_pos), pa.array(size), pa.array(own_upto), *batch.columns[2:4]], ["c", "part", "pos", "bytes", "upto", "x1", "x2"])

    ranged = slim.repartitionByRange(*keys).sortWithinPartitions(*keys).select("c", "bytes", "x1", "x2")
    numbered = cut(map_batches(ranged, run, "c long, part long, pos long, bytes long, upto long, x1 long, x2 long"))
    stretches = numbered.groupBy("c", "part").agg(F.max("pos").alias("n"), F.max("upto").alias("b"))
    cut_up = stretches.groupBy("c").agg(F.count("*").alias("parts")).where("parts > 1").select("c")  # at most one at each border of ranges
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stretches.join(F.broadcast(cut_up), "c").select("c", "part", F.sum("n").over(before).alias("n0"), F.sum("b").over(before).alias("b0")).where("n0 is not null")
    out = numbered.join(F.broadcast(offsets), ["c", "part"], "left")  # a row a range at most
    return out.select("c", (F.col("pos") + F.coalesce("n0", F.lit(0))).alias("pos"), "bytes", (F.col("upto") + F.coalesce("b0", F.lit(0))).alias("upto"), "x1", "x2")


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """The conversations of ordered() with the head of one of their family: the ids (c), and c, depth, bytes, rest, x1, x2.

    Conversation c has h = crc32(decimal c) % heads turns of conversation c - c % family (fewer if it is shorter, none if there is
    none) and then its own turns after its first h. rest counts the bytes of a turn and all after it.
    """
    h = F.crc32(_decimal(F.col("c"))) % heads
    slice_of = lambda pos: F.shiftright(pos, SLICE)
    first = turns.where((F.col("c") % family == 0) & (F.col("pos") < heads)).groupBy("c").agg(
        F.sort_array(F.collect_list(F.struct("pos", "bytes", "upto", "x1", "x2"))).alias("head")  # heads - 1 turns at most
    )
    own = turns.groupBy("c").agg(F.max("pos").alias("n"), F.max("upto").alias("total"), F.sum(F.when(F.col("pos") <= h, F.col("bytes")).otherwise(0)).alias("skipped"))
    head = F.slice("head", 1, F.col("h").cast("int"))
    plan = own.withColumns({"h": h, "base": F.col("c") - F.col("c") % family}).join(first.withColumnRenamed("c", "base"), "base", "left").withColumn("head", head)
    plan = cut(plan.select("c", "n", "h", "total", (F.col("total") - F.col("skipped")).alias("later"), "head", F.when(F.col("head").isNull(), 0).otherwise(F.size("head")).cast("long").alias("k")))
    taken = plan.select("c", "later", F.try_element_at("head", F.lit(-1))["upto"].alias("all"), F.explode("head").alias("t"))
    top = taken.select("c", F.col("t.pos").alias("depth"), "t.bytes", (F.col("all") - F.col("t.upto") + F.col("t.bytes") + F.col("later")).alias("rest"), "t.x1", "t.x2")
    known = plan.select("c", "h", "k", "total", F.explode(F.sequence(F.lit(0).cast("long"), slice_of(F.col("n")))).alias("slice"))
    tail = turns.where(F.col("pos") > h).withColumn("slice", slice_of(F.col("pos"))).join(known, ["c", "slice"])
    tail = tail.select("c", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), "bytes", (F.col("total") - F.col("upto") + F.col("bytes")).alias("rest"), "x1", "x2")
    return plan.select("c"), top.unionByName(tail)


def end_hashes(members: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ends: SHA-256 of each group's ids (c) in ascending order, as decimals joined by commas; (keys, c) are distinct.

    Ids are sorted by ranges, and ranges joined to texts of about PIECE bytes; what hashes a group reads such texts one by one.
    """
    fields = ", ".join(f"{k} long" for k in keys)

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
        if not batch.num_rows:
            return
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.r_[True, np.any([v[1:] != v[:-1] for v in columns], axis=0)]
        begin = np.flatnonzero(change)
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), batch.num_rows], strict=True):
            yield tuple(int(v[a]) for v in columns), a, b

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ids, texts = batch.column("c").to_pylist(), batch.column("text").to_pylist()
            for key, a, b in runs(batch):
                for k in range(a, b, PIECE >> 4):
                    out.append((*key, ids[k], ",".join(texts[k : min(b, k + (PIECE >> 4))])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], [*keys, "first", "text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, out = None, None, []
        for batch in batches:
            texts = batch.column("text")
            for key, a, b in runs(batch):
                for k in range(a, b):
                    if key == last:
                        state.update(b",")
                    else:
                        if last is not None:
                            out.append((*last, state.hexdigest()))
                        last, state = key, hashlib.sha256()
                    state.update(texts[k].as_py().encode())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], [*keys, "ends"])
                out = []
        if last is not None:
            out.append((*last, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], [*keys, "ends"])

    ranged = members.repartitionByRange(*keys, "c").sortWithinPartitions(*keys, "c").select(*keys, "c", _decimal(F.col("c")).alias("text"))
    texts = map_batches(ranged, joined, f"{fields}, first long, text string")
    return map_batches(texts.repartition(*keys).sortWithinPartitions(*keys, "first"), hashed, f"{fields}, ends string")


def _refined(rows: DataFrame, reps: DataFrame, top: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Splits the class of all reps (named top) turn by turn. rows: rep, n, copies, depth, bytes, rest, x1, x2.

    Gives, for each round, rep, depth, node, parent, n_convs, bytes, n for members of classes of several, and rep, depth, parent, rest, copies for
    those that are alone from that depth on. node and parent are the smallest members of the class there and one turn before.
    """
    shared, alone = [], []
    active = reps.select("rep", F.lit(top).cast("long").alias("cls"))
    begin, width = 0, 1
    while True:
        along = Window.partitionBy("rep").orderBy("depth")  # `width` rows a member
        turn = (F.xxhash64("x1", "x2", "depth"), F.xxhash64("x2", "depth", "x1"))
        part = rows.where((F.col("depth") > begin) & (F.col("depth") <= begin + width)).join(active, "rep")
        part = part.withColumns({f"p{k}": F.bit_xor(x).over(along) for k, x in enumerate(turn)})
        key = ["cls", "depth", "p0", "p1"]  # the class at the begin of the round and all turns since
        classes = part.groupBy(*key).agg(F.min("rep").alias("node"), F.count("*").alias("k"), F.sum("copies").alias("n_convs"))
        split = part.join(classes, key).withColumn("parent", F.coalesce(F.lag("node").over(along), F.col("cls")))
        split = cut(split.select("rep", "n", "copies", "depth", "bytes", "rest", "node", "parent", "k", "n_convs"))
        shared.append(split.where("k > 1").select("rep", "depth", "node", "parent", "n_convs", "bytes", "n"))
        first = F.min_by(F.struct("depth", "parent", "rest", "copies"), "depth")
        alone.append(split.where("k = 1").groupBy("rep").agg(first.alias("f")).select("rep", "f.*"))
        active = split.where((F.col("k") > 1) & (F.col("depth") == begin + width) & (F.col("n") > F.col("depth"))).select("rep", F.col("node").alias("cls"))
        if active.isEmpty():
            return shared, alone
        begin, width = begin + width, min(2 * width, WIDTH)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations: all ids (c), and their turns c, depth, bytes, rest, x1, x2 as rebuilt() gives them."""
    turns = cut(turns)
    digest = {"d1": F.bit_xor(F.xxhash64("x1", "x2", "depth")), "d2": F.bit_xor(F.xxhash64("x2", "depth", "x1"))}
    whole = turns.groupBy("c").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"), *(v.alias(k) for k, v in digest.items()))
    whole = cut(convs.join(whole, "c", "left").na.fill(0, ["n", "total", "d1", "d2"]))
    same = ["n", "d1", "d2"]
    reps = whole.groupBy(*same).agg(F.min("c").alias("rep"), F.count("*").alias("copies"), F.max("total").alias("total"))
    reps = cut(reps.join(end_hashes(whole.select(*same, "c"), same), same).select("rep", "n", "copies", "total", "ends"))
    facts = reps.agg(F.count("*").alias("n"), F.min("rep").alias("top"), F.sum("copies").alias("all")).first()
    rows = cut(turns.join(reps.select(F.col("rep").alias("c"), "n", "copies"), "c").withColumnRenamed("c", "rep"))
    spent(turns)
    if facts.n > 1:
        shared, alone = map(_union, _refined(rows, reps, facts.top))
    else:  # one sequence, or none: all of it is a chain
        alone = reps.select("rep", F.lit(1).cast("long").alias("depth"), F.col("rep").alias("parent"), F.col("total").alias("rest"), "copies")
        shared = reps.where("false").select("rep", F.col("n").alias("depth"), F.col("rep").alias("node"), F.col("rep").alias("parent"), F.col("copies").alias("n_convs"), F.col("n").alias("bytes"), "n")
    alone = cut(alone)
    top = lambda name: F.lit(facts.top).cast("long").alias(name)
    root = reps.select("rep", F.lit(0).cast("long").alias("depth"), top("node"), F.lit(None).cast("long").alias("parent"), F.lit(facts["all"]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("bytes"), "n")
    shared = cut(root.unionByName(shared))

    below = Window.partitionBy("rep").orderBy(F.desc("depth"))  # as long as what a member shares with others
    tails = alone.select("rep", ((F.col("copies") - 1) * F.col("rest")).alias("tail"), F.lit(1).cast("long").alias("leaf"))
    own = F.when(F.col("node") == F.col("rep"), (F.col("n_convs") - 1) * F.col("bytes")).otherwise(0)
    summed = shared.withColumn("own", F.sum(own).over(below)).join(tails, "rep", "left")
    summed = summed.groupBy("node", "depth").agg(F.sum(F.col("own") + F.coalesce("tail", F.lit(0))).alias("saved"), F.sum(F.coalesce("leaf", F.lit(0))).alias("leaves"))
    nodes = shared.where("node = rep").select("node", "depth", "parent", "n_convs")
    children = nodes.select("parent", "depth").unionByName(alone.join(reps.where("n > 0"), "rep", "left_semi").select("parent", "depth"))
    children = children.where("parent is not null").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("children"))
    ended = shared.where("depth = n").select("rep", "node", "depth").join(reps.select("rep", "ends"), "rep").drop("rep")
    at = ["node", "depth"]
    inner = nodes.join(summed, at).join(children, at, "left").join(ended, at, "left").select(
        _given(F.col("node")).alias("conv_id"), "depth", _given(F.col("parent")).alias("parent_conv_id"), "n_convs", F.coalesce("children", F.lit(0)).alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )
    chain = rows.join(alone.select("rep", F.col("depth").alias("since"), "parent").join(reps.select("rep", "ends"), "rep"), "rep").where("depth >= since")
    last = F.col("depth") == F.col("n")
    chain = chain.select(
        _given(F.col("rep")).alias("conv_id"), "depth", _given(F.when(F.col("depth") == F.col("since"), F.col("parent")).otherwise(F.col("rep"))).alias("parent_conv_id"),
        F.col("copies").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("copies") - 1) * F.col("rest")).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(EMPTY).alias("ends_sha256"),
    )
    return inner.unionByName(chain)


def prefix_trie(
    conversations: DataFrame, family: int = 5, heads: int = 9, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn_col, null first; turns that share one are ordered by a hash of role and text. Null roles and texts are
    empty. `family` and `heads` are those of rebuilt(); heads=1 leaves conversations as they are. A node is a sequence of turns with which some
    rebuilt conversation begins; it is named by its smallest member and its depth. Ids are whole numbers. A null id is a
    conversation too, with no head of another, smaller than all others and empty in ends_sha256; a node of its is named null. Rows that repeat
    are turns of their own. Other columns are not looked at. An empty table has no nodes.
    """
    return trie(*rebuilt(ordered(conversations, id_col, turn_col, role_col, text_col), family, heads))
