"""Exact duplicates: groups by a 128-bit content hash, whose texts are compared byte for byte.

Only DataFrame functions. The text is moved once, as part of a grouping key that is combined before the
shuffle, so that a group of a third of all rows arrives as one row from each task. All later joins carry
hashes and ids, and their hot keys can be split by adaptive skew handling.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import ascii_lower, cut, keep_one, row_key, text_of


def content_hash(text: Column) -> Column:
    """128 bits of content hash."""
    return F.unhex(F.md5(text))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the smallest
    (keep="min") or largest (keep="max") id stays. A null text is an empty one, and empty texts form one
    group. Rows that repeat an id and text share one decision and each count in group_size. Null ids stay
    only in groups that have no other id. Other columns of docs are not looked at; an empty table gives
    no rows. `hashed` is the content hash; colliding texts are told apart by their bytes whatever it is.
    """
    out = _judged(docs, id_col, text_col, keep, hashed)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _judged(docs: DataFrame, id_col: str, text_col: str, keep: str, hashed: Callable[[Column], Column]) -> DataFrame:
    """id, h1, h2 (row_key), keep_id, group_size, text_sha256 for each row."""
    best = {"min": F.min, "max": F.max}[keep]
    base = docs.select(docs[id_col].alias("id"), *row_key(docs, id_col, text_col), ascii_lower(text_of(docs, text_col)).alias("_text"))
    base = base.withColumn("_hash", hashed(F.col("_text")))
    texts = base.groupBy("_hash", "_text").agg(best("id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = cut(
        texts.select("_hash", "keep_id", "group_size")
        .groupBy("_hash")
        .agg(best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("_texts"))
    )
    rows = base.select("id", "h1", "h2", "_hash", F.sha2("_text", 256).alias("text_sha256"))
    clashes = groups.where("_texts > 1").select("_hash")
    if clashes.isEmpty():
        out = rows.join(groups.drop("_texts"), "_hash")
    else:  # some hash has several texts: their rows are matched by the texts themselves
        apart = texts.join(clashes, "_hash", "left_semi")
        alike = base.join(clashes, "_hash", "left_semi").withColumn("text_sha256", F.sha2("_text", 256))
        columns = ["id", "h1", "h2", "keep_id", "group_size", "text_sha256"]
        out = (
            rows.join(groups.where("_texts = 1").drop("_texts"), "_hash").select(columns)
            .unionByName(alike.join(apart, ["_hash", "_text"]).select(columns))
        )
    return out


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group of equal texts, also where ids repeat or are
    null. The texts of rows that stay are not moved again, but for those that a filter of bounded size cannot tell apart."""
    judged = _judged(docs, id_col, text_col, keep, content_hash)
    kept = F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")
    return keep_one(docs, cut(judged.select("h1", "h2", F.col("text_sha256").alias("group"), kept)), id_col, text_col)
