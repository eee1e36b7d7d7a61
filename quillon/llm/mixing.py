"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

A document gets the key e = -ln(u) / w, with u drawn from its id and w its quality weight; small keys come first. A source
takes its documents in whole epochs while its target allows. What is left of the target is its budget, filled in the order
of the keys: documents are taken while their running sum fits the budget; the first that does not fit ends a round, and the
next round goes on with the documents that are no larger than what is left. After ROUNDS rounds comes the one document that
brings the sum nearest to the target, if any does.

A round is a cut through a source's order, so all that it leaves is one key for each source. The cut is found in two
steps: keys are cut into slices, sums of slices tell in which of them the cut is, and running sums go through that slice
alone. No task sees a whole source, and whether a document is taken follows from its own row and its source's few numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import WORD, cut, spent, text_of

#: Documents a slice of a source has at most, about; for sources of more than SLICE ** 2 documents their root.
SLICE = 5_000
ROUNDS = 3
#: Sources whose plan is broadcast; a plan of more of them (some 300 bytes each) is joined by a shuffle.
SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


#: Digits and signs that prose has few of.
SYMBOLS = "[0-9#$%&*<>{}|=_@~^+]"


def quality_weight(text: Column, size: Column) -> Column:
    """A document's quality weight by its text alone, from 1/64 to 1, for mixes that are given none.

    Words of 4 to 13 characters on average, their blank included, count fully and others a quarter; of that the square of
    what digits and signs leave, a text being without worth where they are a quarter of it.
    """
    chars = F.greatest(F.char_length(text), F.lit(1))
    words = F.when((F.char_length(text) / F.greatest(size, F.lit(1))).between(4.0, 13.0), F.lit(1.0)).otherwise(F.lit(0.25))
    clean = F.lit(1.0) - F.least(F.lit(1.0), F.regexp_count(text, F.lit(SYMBOLS)) * F.lit(4.0) / chars)
    return F.greatest(F.lit(1 / 64), words * (clean * clean))


def uniform(key: Column, seed: str = "") -> Column:
    """A number in (0, 1) drawn from the digest of a key: 52 bits, the same in every run."""
    hexed = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Targets for sources, given (source, source_size) with one row per source.

    Sources in the order of code points, null last, weigh as `weights` says, repeating. They share the sum
    of all sizes by weight; no target is above `most` times its source's size, and what that leaves over is
    shared by weight among the others until none is above. With sources sorted by size / weight, those that
    reach their bound come first, so running sums find the common level at once.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    out = sizes.withColumn("_i", F.row_number().over(by_name) - 1)
    out = out.withColumn("_w", F.get(cycle, (F.col("_i") % len(weights)).cast("int")))
    out = out.withColumn("_cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_i")
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    out = out.withColumn("_level", level)
    out = out.withColumn("_open", F.col("_level") * F.col("_w") <= F.col("_cap"))
    out = out.withColumn("_common", F.max(F.when(F.col("_open"), F.struct(-F.col("_cap") / F.col("_w"), -F.col("_i"), "_level"))).over(everything)["_level"])
    share = F.least(F.col("_cap"), F.coalesce(F.col("_common") * F.col("_w"), F.col("_cap")))
    return out.select("source", "source_size", share.cast("double").alias("target"))


def _slice(docs: Column) -> Column:
    """The slice of a row with key _e in a source of so many documents.

    Slices are equal steps of ln(e). Whatever the weights are, ln(e) is a mixture of shifted copies of one distribution,
    whose density is 1/e = 0.368 at most, so a step of SLICE / 0.368 / docs has SLICE documents at most on average.
    """
    step = F.greatest(F.lit(float(SLICE)), F.sqrt(docs)) * 2.718281828459045 / docs
    return F.floor(F.log("_e") / step).cast("long")


def _sent(plan: DataFrame, sources: int) -> DataFrame:
    return F.broadcast(plan) if sources <= SOURCES else plan


def _round(keyed: DataFrame, plan: DataFrame, k: int, sources: int) -> DataFrame:
    """plan with _cut{k}, the last (e, id, size) that round k takes, null if none, and _gap{k + 1}, the budget after it."""
    rows = keyed.join(_sent(plan, sources), F.col("source").eqNullSafe(F.col("_s"))).where(_eligible(k)).withColumn("_slice", _slice(F.col("_docs")))
    slices = rows.groupBy("_s", "_slice").agg(F.sum("size").alias("_sum"), F.max(f"_gap{k}").alias("_gap"))
    upto = F.sum("_sum").over(Window.partitionBy("_s").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0))
    slices = slices.withColumn("_upto", upto).withColumn("_fits", F.col("_upto") <= F.col("_gap"))
    # the slice that the cut is in, what fits before it, and the slice before, where the cut is if the next takes nothing
    place = slices.groupBy("_s").agg(
        F.min(F.when(~F.col("_fits"), F.col("_slice"))).alias("_in"),
        F.coalesce(F.max(F.when(F.col("_fits"), F.col("_upto"))), F.lit(0)).alias("_before"),
        F.max(F.when(F.col("_fits"), F.col("_slice"))).alias("_last"),
    )
    near = rows.join(_sent(place.withColumnRenamed("_s", "_p"), sources), F.col("_s").eqNullSafe(F.col("_p"))).drop("_p")
    near = near.where((F.col("_slice") == F.col("_in")) | (F.col("_slice") == F.col("_last")))
    # rows that share key, id and size are taken together
    ties = near.groupBy("_s", "_e", "_id", "size").agg(F.sum("size").alias("_sum"), *[F.max(c).alias(c) for c in ("_slice", "_in", "_last", "_before", f"_gap{k}")])
    running = F.sum(F.when(F.col("_slice") == F.col("_in"), F.col("_sum")).otherwise(F.lit(0))).over(
        Window.partitionBy("_s").orderBy("_e", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    )
    ties = ties.withColumn("_upto", F.col("_before") + running).where(F.col("_upto") <= F.col(f"_gap{k}"))
    cuts = ties.groupBy("_s").agg(F.max(F.struct("_e", "_id", "size")).alias(f"_cut{k}"), F.max("_upto").alias("_taken")).withColumnRenamed("_s", "_p")
    out = plan.join(cuts, F.col("_s").eqNullSafe(F.col("_p")), "left").drop("_p")
    return out.withColumn(f"_gap{k + 1}", F.col(f"_gap{k}") - F.coalesce("_taken", F.lit(0))).drop("_taken")


def _taken_in(k: int) -> Column:
    return F.coalesce((F.col("size") <= F.col(f"_gap{k}")) & (F.struct("_e", "_id", "size") <= F.col(f"_cut{k}")), F.lit(False))


def _eligible(k: int) -> Column:
    """Rows that round k may take: not taken before, and no larger than what is left."""
    out = F.col("size") <= F.col(f"_gap{k}")
    for j in range(k):
        out = out & ~_taken_in(j)
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None, seed: str, keep: list[Column]) -> DataFrame:
    """_id, source, size, _e and the columns of `keep` for each row."""
    text = text_of(docs, text_col)
    size = word_count(text)
    weight = docs[weight_col].cast("double") if weight_col else quality_weight(text, size)
    weight = F.greatest(F.coalesce(weight, F.lit(1.0)), F.lit(1e-6))
    drawn = uniform(F.coalesce(docs[id_col].cast("string"), text), seed)
    out = docs.select(*keep, docs[id_col].alias("_id"), docs[source_col].cast("string").alias("source"), size.alias("size"), weight.alias("_w"), drawn.alias("_u"))
    return out.withColumn("_e", -F.log("_u") / F.col("_w")).drop("_w", "_u")


def _planned(keyed: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """What each source takes, one row for each: its name _s, source_size, target, epochs, gaps and cuts of the rounds, and
    the one document that comes last."""
    sums = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    sums = cut(sums)
    sources = sums.count()
    targets = source_targets(sums.select("source", "source_size"), weights, most).withColumnRenamed("source", "_s")
    plan = targets.join(sums.select("source", "_docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("source")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = cut(plan.withColumn("_gap0", F.col("target") - F.col("epochs") * F.col("source_size")))
    for k in range(ROUNDS):
        plan = cut(_round(keyed, plan, k, sources))
    gap = F.col(f"_gap{ROUNDS}")
    off = F.abs(gap - F.col("_sum"))
    rest = keyed.join(_sent(plan, sources), F.col("source").eqNullSafe(F.col("_s"))).where((F.col("size") > 0) & (F.col("size") < 2 * gap))
    for k in range(ROUNDS):
        rest = rest.where(~_taken_in(k))
    rest = rest.groupBy("_s", "_e", "_id", "size").agg(F.sum("size").alias("_sum"), F.max(f"_gap{ROUNDS}").alias(f"_gap{ROUNDS}")).where(off < gap)
    last = rest.groupBy("_s").agg(F.min(F.struct(off.alias("off"), "_e", "_id", "size")).alias("_last")).withColumnRenamed("_s", "_p")
    last = last.select("_p", F.struct("_last._e", "_last._id", "_last.size").alias("_last"))
    return _sent(cut(plan.join(last, F.col("_s").eqNullSafe(F.col("_p")), "left").drop("_p", "_docs")), sources)


def _times() -> Column:
    """How often a row of _keyed() beside its source's plan is taken."""
    taken = [_taken_in(k) for k in range(ROUNDS)]
    once = F.coalesce(F.struct("_e", "_id", "size") == F.col("_last"), F.lit(False))
    for t in taken:
        once = once | t
    return F.when(F.col("size") > 0, F.col("epochs") + once.cast("int")).otherwise(F.lit(0)).cast("long")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: float = 3.0,
    weight_col: str | None = None,
    seed: str = "",
) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, epochs, taken.

    size counts words; taken counts the words that the mix takes, repeats counted, always a multiple of size. Each source
    takes all documents `floor(target / source_size)` times, and some of them once more: in the order of their keys while
    they fit what is left of the target, in ROUNDS rounds of which each leaves out what is larger than the rest, and then
    the one that brings the sum nearest to the target, if any does. A null or empty text has size 0 and is taken 0 times; a
    null source is a source of its own. A null weight counts as 1, one below 1e-6 as 1e-6. The key of a null id is drawn
    from the text. Rows that repeat an id are documents with the same draw; those that repeat the size as well are taken
    together or not. An empty table gives no rows.
    """
    keyed = cut(_keyed(docs, id_col, text_col, source_col, weight_col, seed, []))
    plan = _planned(keyed, weights, most)
    out = keyed.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    return out.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "epochs", (F.col("size") * _times()).alias("taken"))


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: float = 3.0,
    weight_col: str | None = None,
    seed: str = "",
) -> DataFrame:
    """The mix itself: rows of docs with all their columns, each as many times as mix() takes it. Texts stay in the
    partitions they are in: each row is held against its source's plan."""
    keyed = cut(_keyed(docs, id_col, text_col, source_col, weight_col, seed, []))
    plan = _planned(keyed, weights, most)
    spent(keyed)
    rows = _keyed(docs, id_col, text_col, source_col, weight_col, seed, [F.struct("*").alias("row")])
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_s"))).select("row", _times().cast("int").alias("times")).where("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")
