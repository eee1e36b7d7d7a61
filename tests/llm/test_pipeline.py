from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quillon.llm import queries
from quillon.llm.common import cut

from .test_similar import by_brute_force, lower
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    """Each stage on what the one before it kept, against plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        rows = before.collect()
        if name != "pack":
            assert sorted(docs.columns) == sorted(before.columns)
        kept[name] = [r.doc_id for r in docs.collect()]
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            good = [i for i in (r.doc_id for r in rows) if labels.get(i) == 1]
            assert sum(i in set(kept[name]) for i in good) >= 0.97 * len(good)
        elif name == "exact_dedup":
            first = {}
            for r in rows:
                first[lower(r.text)] = min(r.doc_id, first.get(lower(r.text), r.doc_id))
            assert sorted(kept[name]) == sorted(first.values())
        elif name == "near_dedup":
            groups = by_brute_force([(r.doc_id, r.text) for r in rows], 5, 80)
            assert sorted(kept[name]) == sorted(i for i, _, c in groups if i == c)
        elif name == "mix":
            assert set(kept[name]) <= {r.doc_id for r in rows}
            assert max(kept[name].count(i) for i in set(kept[name])) <= 3
        elif name == "pack":
            ids = [r.doc_id for r in rows]
            assert {r.doc_id for r in docs.collect()} == set(ids)
            assert docs.where("piece = 0").count() == len(ids)


@pytest.mark.parametrize("ids", ["odd", "lettered"])
def test_stages_of_odd_documents(spark, request, ids):
    """Null, repeated and text ids, clashing names, and empty and long texts go through every stage."""
    docs = request.getfixturevalue(ids)
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, SF))
        assert out.count() > 0 and stage(spark, docs.where("false"), SF).count() == 0
        if name == "pack":
            assert out.where("piece = 0").count() == docs.count()
        else:
            assert out.columns == docs.columns
        docs = out


def test_run(spark):
    assert entry.queries()["pipeline"](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    out = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    plain = lambda r: tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r)
    assert sorted((plain(r) for r in out.select(columns).collect()), key=repr) == sorted((plain(r) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered(name):
    assert entry.queries()[name] is queries.QUERIES[name]


def test_packing_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_packing(rows, queries.op6_pack_sequences(spark, SF).collect(), 1024)
