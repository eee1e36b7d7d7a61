"""Declared against installed packages: differences, audits, requirement texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import exact


def missing(declared: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Declared rows that are not present, in their order."""
    return declared.join(present.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti").orderBy("ordinal")


def sync_plan(declared: DataFrame, installed: DataFrame, keep_satisfied: bool = True) -> DataFrame:
    """name, action: uninstall what is no longer declared, install what is not installed in a version that will do.

    Without keep_satisfied every declared package is installed again.
    """
    i = installed.select(F.col("name").alias("_name"), F.col("version").alias("_have"))
    gone = installed.join(declared.select(F.col("name").alias("_name")), F.col("name") == F.col("_name"), "left_anti").select("name", F.lit("uninstall").alias("action"))
    met = declared.join(i, F.col("name") == F.col("_name"), "left")
    if keep_satisfied:
        met = met.where(F.col("_have").isNull() | ~exact.satisfies("version", F.coalesce("_have", F.lit(""))))
    return gone.unionByName(met.select("name", F.lit("install").alias("action")))


def audited(packages: DataFrame) -> DataFrame:
    """Packages with damaged (roots are declared and none is left), outdated (a source is newer than the oldest artifact) and suspect.

    Rows have roots and surviving (arrays), source_times and artifact_times (arrays; null entries are missing files).
    """
    some = lambda c: F.filter(c, lambda t: t.isNotNull())
    zero = F.lit(0).cast("long")
    damaged = (F.size("roots") > 0) & (F.size("surviving") == 0)
    outdated = F.coalesce(F.array_max(some("source_times")), zero) > F.coalesce(F.array_min(some("artifact_times")), zero)
    return packages.withColumns({"damaged": damaged, "outdated": outdated, "suspect": damaged | outdated})


def names(packages: DataFrame) -> DataFrame:
    """Distinct names, whatever the case first."""
    return packages.select("name").distinct().orderBy(F.lower("name"), "name")


def native_artifacts(record: DataFrame, path_col: str = "path") -> DataFrame:
    """Rows of an install record whose file is a native library."""
    return record.where(F.col(path_col).rlike(r"\.(dylib|pyd|so)$"))


def newest(files: DataFrame, by: list[str], pattern: str) -> DataFrame:
    """Per tree: the newest modification time of the files that a pattern matches, 0 without any."""
    return files.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("path").rlike(pattern), F.col("mtime"))), F.lit(0).cast("long")).alias("newest"))


def environment_section(declared: DataFrame, installed: DataFrame, recorded: DataFrame) -> DataFrame:
    """One row: stale, damaged and absent packages as ordered lists, and the verdict: fail if any is damaged or absent, warn if any is stale.

    declared: name, digest; installed: name, damaged; recorded: name, digest.
    """
    i = installed.select("name", "damaged", F.lit(True).alias("_there"))
    r = recorded.select("name", F.col("digest").alias("_digest"))
    met = declared.join(i, "name", "left").join(r, "name", "left")
    listed = lambda c, n: F.array_sort(F.collect_list(F.when(c, F.col("name")))).alias(n)
    there = F.coalesce(F.col("_there"), F.lit(False))
    out = met.agg(listed(there & ~F.col("digest").eqNullSafe(F.col("_digest")), "stale"), listed(there & F.coalesce(F.col("damaged"), F.lit(False)), "damaged"), listed(~there, "absent"))
    return out.withColumn("verdict", F.when((F.size("damaged") > 0) | (F.size("absent") > 0), "fail").when(F.size("stale") > 0, "warn").otherwise("pass"))


def module_reference(module: Column | str, version: Column | str) -> Column:
    """`module@version`: `latest` for any, a leading `v` for plain numbers, names as they are; a range is an error."""
    m, v = (F.col(x) if isinstance(x, str) else x for x in (module, version))
    ranged = F.raise_error(F.concat(F.lit("a range is no version: "), v)).cast("string")
    name = F.when(v == "*", "latest").when(v.rlike("[<>=~^*,| ]"), ranged).when(v.rlike("^[0-9]"), F.concat(F.lit("v"), v)).otherwise(v)
    return F.concat(m, F.lit("@"), name)


def requirement(name: Column | str, version: Column | str, extras: Column | str) -> Column:
    """A requirement's version text; sources that cannot be spelled (an array of extras) are an error."""
    n, v, x = (F.col(c) if isinstance(c, str) else c for c in (name, version, extras))
    return F.when(F.size(x) > 0, F.raise_error(F.concat(n, F.lit(" has what no version can say: "), F.concat_ws(", ", F.array_sort(x)))).cast("string")).otherwise(v)


def shifted_path(path: Column | str) -> Column:
    """A path as a folder one level down spells it; absolute paths stay."""
    p = F.col(path) if isinstance(path, str) else path
    return F.when(p.startswith("/"), p).when(p == "", "..").otherwise(F.concat(F.lit("../"), p))


def resolution_digest(manifest_json: DataFrame, files: DataFrame) -> DataFrame:
    """One row: SHA-256 of a canonical manifest followed by each project file in the order of paths; a missing file counts as a zero byte."""
    listed = files.select("path", F.coalesce(F.hex("content"), F.lit("00")).alias("h"))
    body = listed.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: x["h"]), "").alias("_h"))
    both = manifest_json.select(F.hex(F.encode("value", "utf-8")).alias("_m")).crossJoin(body)  # one row each
    return both.select(F.sha2(F.unhex(F.concat("_m", "_h")), 256).alias("digest"))


def sync_state(digests: DataFrame) -> DataFrame:
    """Lines of name and digest, by name."""
    return digests.orderBy("name").select(F.format_string("%s %s", "name", "digest").alias("value"))
