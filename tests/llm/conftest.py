from __future__ import annotations

import pytest
from pyspark.sql import functions as F

#: Null, empty, blank, odd and very long texts, ties and repeats; ids repeat, and one is null.
ODD = [
    (1, "Hello there world"), (2, None), (3, ""), (4, " \t\n "), (5, "HELLO there world"), (6, "Ünïcode — “quotes” 日本語 👍"), (7, "word " * 30_000), (8, "x" * 200_000),
    (9, "a b"), (9, "a b"), (10, "a"), (None, "null id"), (11, "null id"), (12, "Ärger und ärger"), (13, "ÄRGER und ärger"), (14, "<|endoftext|> inside <|startoftext|>"), (15, "tab nbsp em \x1c fs"),
]


#: Names that operators use inside, or did.
CLASHES = [
    "_id", "_bad", "_stay", "_sha256", "_gone", "_copy", "_text", "_label", "_e", "_s", "_times", "row", "h1", "h2", "key", "place", "label", "stats", "predicted", "held_out",
    "keep_id", "group", "parts", "block", "source_size", "target", "taken", "times", "copy", "next", "packed", "fingerprint", "digest", "keep",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, with columns whose names clash with those that operators use inside."""
    rows = [(i, t, None if i == 2 else "en", None if i in (3, 7) else "s1", len(t or ""), "x", 1, "y", 0, 0.5, *(("z",) * len(CLASHES))) for i, t in ODD]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, size int, component_id string, kept int, score double"
    return spark.createDataFrame(rows, ", ".join([schema, *(f"{c} string" for c in CLASHES)])).repartition(3)


@pytest.fixture(scope="session")
def lettered(odd):
    """The same documents with ids that are text."""
    return odd.withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 3, "0")))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
