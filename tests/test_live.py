"""Samples and spans as two streams: equal to the batch join, late rows counted, state bounded."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import StreamingQueryException

from quillon.operators import trace
from quillon.streaming import spans

SAMPLE, SPAN = "track string, at timestamp, v int", "track string, name string, start timestamp, end timestamp"


def moment(s):
    return datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s)


@pytest.fixture
def live(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run():
        stream = lambda name, schema: spark.readStream.schema(schema).parquet(str(tmp_path / name))
        met = spans.samples_in_spans(stream("samples", SAMPLE), stream("spans", SPAN), ["track"], "10 seconds", "60 seconds")
        query = met.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        return sorted((r.v, r.span) for r in spark.read.parquet(str(tmp_path / "out")).collect()), query

    return put, run


def test_two_streams_equal_the_batch(spark, live):
    put, run = live
    samples = [("b", moment(7), 1000)] + [("a", moment(s), s) for s in range(0, 100, 5)]
    opened = [("a", "x", moment(0), moment(30)), ("a", "y", moment(10), moment(20)), ("a", "z", moment(60), moment(60)), ("b", "x", moment(7), moment(28)), ("a", "w", moment(90), moment(96))]
    put("samples", samples[:8], SAMPLE)
    put("spans", opened[1:2], SPAN)
    run()
    put("samples", samples[8:], SAMPLE)
    put("spans", opened[:1] + opened[2:], SPAN)  # a span comes when it has ended, after its samples
    got, query = run()
    micros = lambda t: int(t.timestamp() * 1_000_000)
    batch = trace.samples_in_spans(
        spark.createDataFrame([(t, micros(at), v) for t, at, v in samples], "track string, at long, v int"),
        spark.createDataFrame([(t, n, micros(a), micros(b)) for t, n, a, b in opened], "track string, name string, start long, end long"), ["track"],
    )
    assert got == sorted((r.v, r.span) for r in batch.collect()) and len(got) > 5
    assert spans.late_rows(query) == 0


def test_late_rows_are_counted_and_state_is_given_up(live):
    put, run = live
    put("samples", [("a", moment(s), s) for s in (0, 1, 500)], SAMPLE)
    put("spans", [("a", "x", moment(490), moment(500))], SPAN)
    run()
    put("samples", [("a", moment(2), 2), ("a", moment(495), 495)], SAMPLE)  # the first is later than others by more than the delay
    put("spans", [("a", "late", moment(0), moment(5)), ("a", "y", moment(480), moment(510))], SPAN)
    got, query = run()
    assert got == [(495, "x"), (495, "y"), (500, "y")]
    assert spans.late_rows(query) == 2
    kept = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    assert kept[-1] <= 4  # what was there at the begin has gone


def test_longer_spans_are_errors(live):
    put, run = live
    put("samples", [("a", moment(0), 0)], SAMPLE)
    put("spans", [("a", "x", moment(0), moment(61))], SPAN)
    with pytest.raises(StreamingQueryException, match="longer than"):
        run()
