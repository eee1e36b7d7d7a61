"""Literal cases of scalar functions."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillon.functions import exact, numeric, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in ((k, "string" if isinstance(v, str) or v is None else "double" if isinstance(v, float) else "long") for k, v in values.items()))) if values else spark.range(1)
    return row.select(column).first()[0]


@pytest.mark.parametrize(("shape", "blocks"), [("110x1x1", 110), ("(8, 2, 1)", 16), ("", 0), ("garbage", 0)])
def test_grid_blocks(spark, shape, blocks):
    assert one(spark, numeric.grid_blocks("s"), s=shape) == blocks


@pytest.mark.parametrize(("shape", "threads"), [("", 1), ("16xNx2", 32)])
def test_threads(spark, shape, threads):
    assert one(spark, numeric.threads_per_block("s"), s=shape) == threads


@pytest.mark.parametrize(
    ("rate", "g", "least", "fee", "setup", "run", "seconds", "usd"),
    [(4.56, 1, 0, 0.0, 4.0, 30.0, 34, 4.56 * 34 / 3600), (2.2, 60, 60, 0.0, 240.0, 30.0, 300, 2.2 * 300 / 3600), (3.6, 1, 120, 0.05, 0.0, 1.0, 120, 0.17)],
)
def test_billing(spark, rate, g, least, fee, setup, run, seconds, usd):
    billed = numeric.billed_seconds(F.lit(setup), F.lit(run), F.lit(g), F.lit(least))
    assert one(spark, billed) == seconds
    assert one(spark, numeric.cost(F.lit(rate), billed, F.lit(fee))) == pytest.approx(usd)


def test_observed_times(spark):
    assert one(spark, numeric.setup_seconds(F.lit(100.0), F.lit(104.0))) == 4.0
    assert one(spark, numeric.run_seconds(F.lit(104.0), F.lit(134.0))) == 30.0
    assert one(spark, numeric.setup_seconds(F.lit(100.0), F.lit(0.0))) == 0.0
    assert one(spark, numeric.run_seconds(F.lit(104.0), F.lit(0.0))) == 0.0


def test_names(spark):
    assert one(spark, exact.readable_name("s"), s="_ZN5numba5tests3jitE") == "numba.tests.jit"
    assert one(spark, exact.readable_name("s"), s="_ZN") == "_ZN"


@pytest.mark.parametrize(("value", "code"), [("0:0", 0), ("1:0", 1), ("0:9", 9), ("", None), ("garbage", None)])
def test_slurm_exit_code(spark, value, code):
    assert one(spark, text.slurm_exit_code("s"), s=value) == code


LOGS = [
    ("Traceback\nValueError: bad\nlast", None, "ValueError: bad"),
    ("sbatch: error: no such partition\nbye", None, "sbatch: error: no such partition"),
    ("one\ntwo\n", None, "two"),
    ("", None, "(no log output)"),
    ("", 137, "killed by SIGKILL (out of memory or walltime, exit 137)"),
    ("KeyError: x\nrunner: killed at walltime 10\nKeyError: y", None, "runner: killed at walltime 10"),
    ("\x1b[31m─── all done ───\x1b[0m", None, "all done"),
]


@pytest.mark.parametrize(("log", "code", "reason"), LOGS)
def test_failure_reason(spark, log, code, reason):
    code_column = F.lit(code).cast("int")
    assert one(spark, text.failure_reason("log", code_column), log=log) == reason


def test_excerpt(spark):
    log = "\n".join(map(str, range(20)))
    assert one(spark, text.log_excerpt("log", 3), log=log) == ["17", "18", "19"]
    assert one(spark, text.log_excerpt("log", 3), log="x") == ["x"]


def test_labels(spark):
    assert one(spark, text.labelled_study("s"), s="study:sid/trial-a") == "sid"
    assert one(spark, text.labelled_study("s"), s="other") == ""


@pytest.mark.parametrize(("log", "code"), [("a\nexit=3\nb", 3), ("exit=1\nexit=0", 0), ("exit=4\nexit=x", 4), ("none", None)])
def test_exit_marker(spark, log, code):
    assert one(spark, text.exit_marker("log", "exit="), log=log) == code


def test_canonical_digest(spark):
    import hashlib

    value = {"b": 1e-5, "a": "é", "c": None}
    want = hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, exact.canonical_digest("s"), s=json.dumps(value)) == want
    assert one(spark, exact.run_id("s"), s=json.dumps(value)) == want[:16]


@pytest.mark.parametrize("value", [0.00015, 2.00025, 1.0])
def test_rounding(spark, value):
    assert one(spark, exact.round4("v"), v=value) == round(value, 4)


@pytest.mark.parametrize(("expression", "value"), [("min(100, attempt * 50)", 100), ("attempt * 7 / 2", 10), ("7", 7), ("attempt // 2 - 3", -2)])
def test_resource(spark, expression, value):
    assert one(spark, exact.resource(expression, F.lit(3))) == value


@pytest.mark.parametrize("expression", ["__import__('os')", "attempt ** 2", "x", "min(1)", "1.5", "(", "True"])
def test_resource_refuses(spark, expression):
    with pytest.raises(ValueError):
        exact.resource(expression, F.lit(1))


@pytest.mark.parametrize(("constraint", "version", "ok"), [(">=1.2,<2", "1.9.1", True), (">=1.2,<2", "2.0", False), ("*", "1", True), ("^1.2", "9", True), ("==1.4.*", "1.4.7", True), ("~=1.4.2", "1.5.0", False), ("!=1.0", "1.0.0", False)])
def test_satisfies(spark, constraint, version, ok):
    assert one(spark, exact.satisfies("c", "v"), c=constraint, v=version) is ok


def test_activities(spark):
    assert one(spark, F.concat_ws(",", numeric.missing_activities(F.lit(0b0101), F.lit(0b1111)))) == "memcpy,sync"
    assert one(spark, numeric.activity_label(F.lit(3))) == "default"
    assert one(spark, numeric.activity_label(F.lit(6))) == "activity"
    assert one(spark, numeric.copy_kind(F.lit(42))) == "kind_42"


def test_json_list(spark):
    assert one(spark, text.json_list("s", "a.b"), s='noise {"a": {"b": ["x", "y"]}}') == ["x", "y"]
    assert one(spark, text.json_list("s", "a.b"), s="no report") == []
    assert one(spark, text.json_list("s", "a.c"), s='{"a": {"b": 1}}') == []
