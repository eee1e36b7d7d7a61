"""Large JSON documents read in blocks of any size."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.sources import documents, files


def profile(seed, n):
    draw = random.Random(seed)
    texts = ["a", 'q"uote', "back\\slash", '\\"', "br{ack[et]}", "é日本", "", '"kernels":[', "\\\\", "line\nend"]
    name = lambda: "".join(draw.choice(texts) for _ in range(draw.randrange(5)))
    kernels = [{"name": name(), "start_ns": k, "grid": name()} for k in range(n)]
    windows = [{"name": name(), "start_ns": 1, "end_ns": 2, "wall_ns": draw.randrange(99)} for _ in range(n // 3)]
    return {"host": name(), "device": "x", "kernels": kernels, "notes": {"kernels": [{"name": "no"}], "inner": {"name": "no"}}, "memcpys": [], "windows": windows, "dropped_spans": 3}


@pytest.mark.parametrize("block", [1, 7, 64, 1000, 1 << 20])
def test_blocks_of_any_size(tmp_path, monkeypatch, block):
    monkeypatch.setattr(documents, "MORE", max(1, block // 2))
    for seed in range(3):
        doc = profile(seed, 12)
        path = tmp_path / f"{seed}.json"
        path.write_text(json.dumps(doc, ensure_ascii=seed == 1, indent=seed or None))
        text = documents.Text(str(path))
        inside = depth = 0
        lists, found = [], []
        for begin in range(0, text.size, block):
            end = min(begin + block, text.size)
            lists += documents.borders_in(text, begin, end, inside, depth)
            found += documents.elements_in(text, begin, end, inside, depth)
            flips, out, within = documents.scanned(text, begin, end)
            inside, depth = (inside + flips) % 2, depth + (within if inside else out)
        assert (inside, depth) == (0, 0)
        lists.sort()
        assert [n for _, n in lists] == ["kernels", None, "memcpys", None, "windows", None]
        own = {n: [json.loads(v) for p, v in found if a < p < b] for (a, n), (b, _) in zip(lists[::2], lists[1::2], strict=True)}
        assert own == {k: doc[k] for k in own}


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_records_of_a_document(spark, tmp_path, block):
    doc = profile(5, 40)
    path = str(tmp_path / "p.json")
    with open(path, "w") as f:
        json.dump(doc, f)
    rows = documents.records(spark, path, "kernels", block).orderBy("ordinal").collect()
    assert [(r["name"], r.start_ns, r.grid) for r in rows] == [(k["name"], k["start_ns"], k["grid"]) for k in doc["kernels"]]
    assert documents.records(spark, path, "memcpys", block).count() == 0
    assert [r["name"] for r in documents.records(spark, path, "windows", block).orderBy("ordinal").collect()] == [w["name"] for w in doc["windows"]]


def test_written_in_parts_and_read_back(spark, tmp_path):
    path = str(tmp_path / "doc")
    kernels = spark.range(3000).select(F.concat(F.lit('k"{'), F.col("id") % 7).alias("name"), F.col("id").alias("start_ns"), F.col("id").alias("ordinal")).repartition(6)
    windows = spark.range(0).select(F.lit("w").alias("name"), F.col("id").alias("start_ns"), F.col("id").alias("ordinal"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        documents.profile_lines("gpu", 'ho"st}', kernels=kernels, windows=windows).write.text(path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    text = documents.Text(path)
    assert len(text.files) > 1
    doc = json.loads(text.read(0, text.size))
    assert (doc["host"], doc["device"], doc["windows"]) == ('ho"st}', "gpu", []) and [k["start_ns"] for k in doc["kernels"]] == list(range(3000))
    rows = documents.records(spark, path, "kernels", 5000).orderBy("ordinal").collect()
    assert [(r["name"], r.start_ns) for r in rows] == [(f'k"{{{i % 7}', i) for i in range(3000)]
    assert files.exists(spark, path) and documents.records(spark, path, "windows", 5000).count() == 0


def test_blocks_are_read_by_many_tasks(spark, tmp_path):
    doc = profile(6, 200)
    path = str(tmp_path / "p.json")
    with open(path, "w") as f:
        json.dump(doc, f)
    found = documents.elements(spark, path, 100).withColumn("task", F.spark_partition_id())
    assert found.count() == len(doc["kernels"]) + len(doc["windows"])
    per_task = [r["count"] for r in found.groupBy("task").count().collect()]
    assert len(per_task) > 10 and max(per_task) < 60


def test_ranges_of_a_written_document_follow_its_elements(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "ROWS", 100)
    path = str(tmp_path / "doc")
    kernels = spark.range(3000).select(F.concat(F.lit("k"), F.col("id") % 7).alias("name"), F.col("id").alias("start_ns"), F.col("id").alias("ordinal")).orderBy(F.xxhash64("id"))
    windows = kernels.where("ordinal < 2").select("name", "start_ns", (-F.col("ordinal")).alias("ordinal"))
    documents.profile_lines("gpu", "host", kernels=kernels, windows=windows).write.text(path)
    text = documents.Text(path)
    doc = json.loads(text.read(0, text.size))
    assert [k["start_ns"] for k in doc["kernels"]] == list(range(3000)) and [w["start_ns"] for w in doc["windows"]] == [1, 0]
    parts = [text.read(low, high).count(b"start_ns") for low, high, _ in text.files]
    assert sum(n > 0 for n in parts) >= 25 and max(parts) < 300
