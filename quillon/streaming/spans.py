"""Samples and spans met as they arrive: a join of two streams by an interval of time.

Each side keeps what may still meet something of the other: a span until the watermark of samples is past its end, a sample until
the watermark of spans' ends is further past it than the longest span. Each (sample, span) comes out once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def samples_in_spans(samples: DataFrame, spans: DataFrame, by: list[str], delay: str, longest: str, at: str = "at") -> DataFrame:
    """Each sample of a stream once for every span [start, end) of another stream that is open when it is taken, with the span's name as `span`.

    delay: how much later than others of its stream a sample or (by its end) a span may come; what comes later is left out and counted
    (late_rows). longest: the longest that a span may be, which bounds how long samples are kept; a longer one is an error.
    """
    bound = F.expr(f"INTERVAL {longest}")
    sound = F.when(F.col("end") > F.col("start") + bound, F.raise_error(F.concat(F.lit(f"a span is longer than {longest}: "), "name")).cast("string")).otherwise(F.col("name"))
    s = spans.withWatermark("end", delay).select(*[F.col(c).alias(f"_s_{c}") for c in by], sound.alias("span"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    p = samples.withWatermark(at, delay)
    same = [F.col(c) == F.col(f"_s_{c}") for c in by]
    met = reduce(lambda a, b: a & b, [*same, F.col(at) >= F.col("_start"), F.col(at) < F.col("_end"), F.col(at) >= F.col("_end") - bound])
    return p.join(s, met).select(*samples.columns, "span")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query has left out as too late, as far back as it remembers."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
