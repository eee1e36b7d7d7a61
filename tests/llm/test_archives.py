from __future__ import annotations

import gzip
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import warc


def test_loser_tree():
    draw = random.Random(0)
    for k in range(9):
        runs = [sorted((draw.randrange(20), i, n) for n in range(draw.randrange(0, 12))) for i in range(k)]
        assert list(warc.merged([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize(("buffer", "fan_in"), [(1000, 64), (7, 64), (5, 3), (1, 2)])
def test_merge_beyond_its_buffer(tmp_path, buffer, fan_in):
    """Stretches that go far beyond the buffer are merged over files, in more than one pass, and no file is left."""
    draw = random.Random(buffer)
    entry = lambda i: (f"k{draw.randrange(30)}", str(draw.randrange(3)), str(draw.randrange(5)), "a", i, 1, "response", "d")
    runs = [sorted(entry(100 * n + i) for i in range(draw.randrange(0, 20))) for n in range(12)]
    merge = warc.Merge(f"file://{tmp_path}/spill", buffer, fan_in, 4)
    merge.add(x for r in runs for x in r)
    assert len(merge.held) + len(merge.files) <= fan_in + 12 and merge.count < max(buffer, 2)
    out = [x for batch in merge.batches() for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    assert out == sorted(x for r in runs for x in r)
    assert not (tmp_path / "spill").exists() or not list((tmp_path / "spill").iterdir())


def test_a_merge_holds_bytes_not_entries(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "HELD", 50_000)
    merge = warc.Merge(f"file://{tmp_path}/spill", 10**9, 64, 4)
    entries = [("k" * 5000, "0", str(n), "a", n, 1, "response", "d") for n in range(100)]
    merge.add(iter(entries))
    assert merge.size < 50_000 and len(merge.files) > 5
    assert sum(b.num_rows for b in merge.batches()) == 100


def test_small_payloads_are_dealt_out(spark):
    df = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") < 20, F.lit("x" * 2000)).otherwise(F.lit("small")).alias("html"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = warc.captures(df)
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        kept = {r.keep for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 4000 and max(sizes) < 3500 and kept == {None, 19}


def test_ranges_larger_than_the_buffer(spark, tmp_path):
    df, rows = pages(spark)
    folder = f"file://{tmp_path}/w"
    runs = warc.write_archives(warc.captures(df.repartition(4)), folder)
    index = warc.merge_index(runs, folder, ranges=2, buffer=10, fan_in=3).collect()
    keys = [(r.url_key, r.timestamp, r.id, r.archive, r.offset) for r in index]
    assert len(keys) == len(rows) and keys == sorted(keys)
    seen = defaultdict(int)
    for r in index:  # histories go on over ranges
        seen[r.url_key] += 1
        assert r.place == seen[r.url_key]


def test_one_url_falls_into_many_ranges(spark, tmp_path):
    """Captures without ids of one URL and time are parted by their places."""
    df = spark.range(3000).select(F.lit(None).cast("long").alias("page_id"), F.lit("http://a").alias("url"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("html"))
    index = warc.merge_index(warc.write_archives(warc.captures(df), f"file://{tmp_path}/w"), f"file://{tmp_path}/w", ranges=6)
    sizes = [r["count"] for r in index.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 1500
    assert [r.place for r in index.collect()] == list(range(1, 3001))


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("http://www.Example.com/A?b=C#top", "com,example)/a?b=c"), ("https://example.com:443", "com,example)/"), ("https://example.com:8080/x", "com,example:8080)/x"),
        (None, ""), ("no url", "no url"), ("http://[bad", "http://[bad"), ("http://www2.a.org/", "org,a)/"),
    ],
)
def test_url_key(url, key):
    assert warc.url_key(url) == key


def pages(spark):
    draw = random.Random(1)
    big = [("p" * 999), ("q" * 1000), ("é" * 500), ("z" * 5000), "\r\n\r\nWARC/1.1\r\n" * 200]
    rows = [(i, f"http://h{i % 7}.com/{i % 3}", draw.choice([*big, None, "", "small"])) for i in range(200)]
    rows += [(500, None, "x" * 2000), (501, "bad\r\nurl ü", "x" * 2000), (None, "http://a", "y" * 3000), (502, "http://a", "y" * 3000), (503, "http://a", "y" * 3000), (503, "http://a", "y" * 3000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit(1), "digest": F.lit("x"), "date": F.lit("2020-01-02 03:04:05")}), rows


def test_round_trip(spark, tmp_path):
    df, rows = pages(spark)
    folder = f"file://{tmp_path}/w"
    index = warc.archive(df.repartition(3), folder, date_col="date")
    keys = [(r.url_key, r.timestamp, r.id) for r in index.collect()]
    assert keys == sorted(keys) and len(keys) == len(rows) and {k[1] for k in keys} == {"20200102030405"}
    out = warc.read_archives(index, folder).collect()
    groups = defaultdict(list)
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            groups[h].append(i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        keep = max(groups[h]) if h in groups else i
        want.append((-1 if i is None else i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if keep == i else "revisit", None if keep == i else keep))
    got = [(int(-1 if r.id is None else r.id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    bodies = {r.id: r.payload for r in out if r.record_type == "response" and r.id}
    assert all(bodies[str(i)] == (h or "").encode() for i, _, h in rows if i is not None and str(i) in bodies)
    for f in (tmp_path / "w").glob("*.gz"):
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n")
    assert warc.cdxj(index).count() == len(rows)


def test_no_pages(spark, tmp_path):
    df, _ = pages(spark)
    folder = f"file://{tmp_path}/w"
    assert warc.read_archives(warc.archive(df.where("false"), folder), folder).count() == 0


def test_damaged_records():
    good = warc.record("1", "u", warc.EPOCH, b"payload", hashlib.sha1(b"payload").hexdigest(), None, False)
    assert warc.parse(good)["payload"] == b"payload"
    for bad in (good[:-1], good.replace(b"payload", b"pAyload"), b"x" + good):
        with pytest.raises(ValueError):
            warc.parse(bad)
