"""The few scalar functions whose results must be Python's own: canonical JSON, rounding, mangled names, versions.

Each is an Arrow-batched pandas UDF around a few lines; nothing here sees more than one value at a time.
"""

from __future__ import annotations

import ast
import hashlib
import json
import operator
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType


@F.pandas_udf(StringType())
def readable_name(names: pd.Series) -> pd.Series:
    """The first three segments of a mangled name, joined by dots; other names unchanged."""

    def one(name: str | None) -> str | None:
        if name is None or not name.startswith("_ZN"):
            return name
        rest, parts = name[3:], []
        while m := re.match(r"[0-9]+", rest):
            size = int(m.group())
            parts.append(rest[m.end() : m.end() + size])
            rest = rest[m.end() + size :]
        return ".".join(parts[:3]) if parts else name

    return names.map(one)


@F.pandas_udf(DoubleType())
def round4(values: pd.Series) -> pd.Series:
    """Rounded to four places, halves as their binary value says."""
    return values.map(lambda v: None if pd.isna(v) else round(v, 4)).astype("float64")


def canonical(value: object) -> str:
    """Compact JSON with sorted keys and ASCII escapes."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(StringType())
def canonical_digest(texts: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form of a JSON text."""
    return texts.map(lambda t: None if t is None else hashlib.sha256(canonical(json.loads(t)).encode()).hexdigest())


def run_id(config_json: Column | str) -> Column:
    """16 digits that name a configuration, whatever the order of its keys."""
    return F.substring(canonical_digest(config_json), 1, 16)


def study_id(experiment: Column | str, space_json: Column | str, revision: Column | str) -> Column:
    """12 digits that name a study: of the experiment, the digest of its space, and the revision."""
    name = lambda x: F.col(x) if isinstance(x, str) else x
    return F.substring(F.sha2(F.concat_ws(":", name(experiment), canonical_digest(space_json), name(revision)), 256), 1, 12)


@F.pandas_udf(StringType())
def json_quoted(texts: pd.Series) -> pd.Series:
    """A cell of a tab-separated table: quoted as JSON where it holds a tab or a line end, or begins with a quote."""
    odd = lambda t: t.startswith('"') or "\t" in t or "\n" in t
    return texts.map(lambda t: "" if t is None else json.dumps(t) if odd(t) else t)


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul}


def resource(expression: str, attempt: Column | str) -> Column:
    """A resource expression over `attempt` as a column: whole numbers, + - * / //, min and max, cut to a whole number.

    Anything else is refused; the text itself never reaches the SQL parser.
    """
    try:
        tree = ast.parse(str(expression), mode="eval").body
    except SyntaxError as fault:
        raise ValueError(f"not an expression of resources: {expression!r}") from fault

    def build(node: ast.expr) -> Column:
        match node:
            case ast.Constant(value=int(v)) if not isinstance(v, bool):
                return F.lit(v).cast("double")
            case ast.Name(id="attempt"):
                return (F.col(attempt) if isinstance(attempt, str) else attempt).cast("double")
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _OPERATORS:
                return _OPERATORS[type(op)](build(a), build(b))
            case ast.BinOp(left=a, op=ast.Div(), right=b):
                return build(a) / build(b)
            case ast.BinOp(left=a, op=ast.FloorDiv(), right=b):
                return F.floor(build(a) / build(b)).cast("double")
            case ast.Call(func=ast.Name(id="min" | "max" as name), args=[_, _, *_] as args, keywords=[]):
                return {"min": F.least, "max": F.greatest}[name](*map(build, args))
        raise ValueError(f"resource expression {expression!r} has more than numbers, attempt, + - * / //, min and max")

    return build(tree).cast("long")


@F.pandas_udf(BooleanType())
def satisfies(constraints: pd.Series, versions: pd.Series) -> pd.Series:
    """Whether a version meets a constraint such as `>=1.2,<2`; what cannot be read (carets, paths, bare numbers) counts as met."""
    step = re.compile(r"\s*(==|!=|<=|>=|<|>|~=)\s*v?([0-9]+(?:\.[0-9]+)*)(\.\*)?\s*\Z")
    compare = {"==": operator.eq, "!=": operator.ne, "<=": operator.le, ">=": operator.ge, "<": operator.lt, ">": operator.gt}

    def numbers(text: str, width: int = 6) -> tuple[int, ...]:
        parts = [int(x) for x in text.split(".")]
        return tuple(parts + [0] * (width - len(parts)))

    def meets(have: tuple[int, ...], sign: str, wanted: str, prefix: bool) -> bool:
        size = len(wanted.split("."))
        if prefix:  # `== 1.2.*` and `!= 1.2.*` compare the numbers that are given
            return (have[:size] == numbers(wanted)[:size]) == (sign == "==")
        if sign == "~=":  # at least, and nothing before the last number changes
            return have >= numbers(wanted) and have[: size - 1] == numbers(wanted)[: size - 1]
        return compare[sign](have, numbers(wanted))

    def one(constraint: str | None, version: str | None) -> bool:
        parts = [step.match(p) for p in (constraint or "").split(",")]
        if None in parts or not version or not re.fullmatch(r"v?[0-9]+(\.[0-9]+)*", version):
            return True
        have = numbers(version.removeprefix("v"))
        return all(meets(have, m.group(1), m.group(2), bool(m.group(3))) for m in parts)

    return pd.Series([one(c, v) for c, v in zip(constraints, versions, strict=True)])
