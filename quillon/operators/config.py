"""Layered configuration as relational data: rows of (layer, path, value), later layers over earlier ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_union(base: Column | str, extra: Column | str) -> Column:
    """Distinct entries of two arrays, the base's first, each where it first stands."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(c(base), empty), F.coalesce(c(extra), empty)))


def ordered_distinct(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values with the place where each first stands."""
    return rows.groupBy(*by, value).agg(F.min("ordinal").alias("ordinal"))


def merged_layers(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per path: the value of its highest layer. Rows have layer, path, value; a version of `*` never overrides another.

    A layer that is written over twice has its last ordinal count, where there is one.
    """
    keys = [*(by or []), "path"]
    rank = F.struct(~((F.col("kind") == "version") & (F.col("value") == "*")), F.col("layer"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct("value", "layer"), rank).alias("_v")).select(*keys, "_v.*")


def overlay(base: DataFrame, own: DataFrame, key: str, scalars: list[str], maps: list[str], lists: list[str]) -> DataFrame:
    """Rows of `own` over the one row of `base`: set scalars win, maps merge by key, lists join as ordered unions."""
    b = base.select(*[F.col(c).alias(f"_b_{c}") for c in [*scalars, *maps, *lists]])
    none = lambda c: F.coalesce(c, F.create_map().cast("map<string,string>"))
    met = own.crossJoin(F.broadcast(b))  # the base is one row
    return met.select(
        key, *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_b_{c}")).alias(c) for c in scalars],
        *[_map_over(none(F.col(f"_b_{c}")), none(F.col(c))).alias(c) for c in maps], *[ordered_union(f"_b_{c}", c).alias(c) for c in lists],
    )


def _map_over(base: Column, over: Column) -> Column:
    """Two maps as one, the second's values winning, whatever the session's policy for repeated keys."""
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k))
    return F.map_concat(kept, over)


def map_over(base: Column | str, over: Column | str) -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return _map_over(c(base), c(over))


def filled(profiles: DataFrame, facts: DataFrame, key: str = "name") -> DataFrame:
    """Host profiles whose open fields are filled from probed facts: a kind of `auto`, an empty root or account."""
    f = facts.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in ("kind", "root", "account")])
    met = profiles.join(f, F.col(key) == F.col("_key"), "left")
    value = {
        "kind": F.when(F.col("kind") == "auto", F.coalesce("_kind", "kind")).otherwise(F.col("kind")),
        "root": F.coalesce(F.nullif(F.col("root"), F.lit("")), "_root", "root"), "account": F.coalesce(F.nullif(F.col("account"), F.lit("")), "_account", "account"),
    }
    return met.select(*[value[c].alias(c) if c in value else F.col(c) for c in profiles.columns])


def layer_order(scopes: DataFrame, env: str, no_default: bool = False) -> DataFrame:
    """Scopes of an environment with their layer number: the base and its platform overlays, the dev scope (default
    environment only), the named environment and its overlays. Without default, the base and its overlays are dropped.

    Scopes have kind (base, dev, env), name, platform (null for none), ordinal.
    """
    wide = F.col("platform").isNotNull()
    place = (
        F.when((F.col("kind") == "base") & F.lit(not no_default), F.when(wide, 1).otherwise(0))
        .when((F.col("kind") == "dev") & F.lit(env == "default"), 2)
        .when((F.col("kind") == "env") & (F.col("name") == env), F.when(wide, 4).otherwise(3))
    )
    ranked = scopes.withColumn("_place", place).where("_place IS NOT NULL")
    return ranked.withColumn("layer", F.struct("_place", "ordinal")).drop("_place")


def unresolved(hosts: DataFrame, containers: DataFrame, environments: DataFrame, reserved: tuple[str, ...] = ("defaults", "local")) -> DataFrame:
    """Broken references, one row each: host, field, value. Hosts may not take reserved names; empty fields refer to nothing."""
    def missing(field: str, known: DataFrame) -> DataFrame:
        used = hosts.where(F.coalesce(F.col(field), F.lit("")) != "")
        lost = used.join(known.select(F.col("name").alias("_known")), F.col(field) == F.col("_known"), "left_anti")
        return lost.select(F.col("name").alias("host"), F.lit(field).alias("field"), F.col(field).alias("value"))

    bad = hosts.where(F.col("name").isin(*reserved)).select(F.col("name").alias("host"), F.lit("name").alias("field"), F.col("name").alias("value"))
    return bad.unionByName(missing("container", containers)).unionByName(missing("environment", environments))


def local_paths(dependencies: DataFrame) -> DataFrame:
    """Per name: the local-path dependency of its highest layer."""
    found = dependencies.where(F.col("source_path").isNotNull())
    return found.groupBy("name").agg(F.max_by("source_path", "layer").alias("source_path"))


def expanded(platforms: DataFrame, environments: DataFrame) -> DataFrame:
    """Each platform with each environment that is raised on it. Both are tables of names in a manifest."""
    e = environments.select(F.col("name").alias("environment"), F.col("platforms").alias("_only"))
    p = platforms.select(F.col("name").alias("platform"))
    return p.join(e, F.col("_only").isNull() | F.array_contains(F.col("_only"), F.col("platform"))).drop("_only")


def resolved_plan(profile: Column, override: Column) -> Column:
    """An override over a profile's field; `none` clears it."""
    chosen = F.coalesce(F.nullif(override, F.lit("")), profile)
    return F.when(chosen == "none", F.lit("")).otherwise(chosen)


def plans(asked: DataFrame, profiles: DataFrame, environments: DataFrame, containers: DataFrame, base_vars: Column | None = None) -> DataFrame:
    """Execution plans: host, env, container (null for none), image, vars, for requests (host, env, container; empty for the
    profile's choice, a container of `none` for none at all).

    profiles have name, env, container and vars (a map), which win over base_vars; environments and containers (name, image)
    are what is declared. A host, environment or container that is not declared is an error.
    """
    p = profiles.select(F.col("name").alias("_host"), F.col("env").alias("_env"), F.col("container").alias("_container"), F.col("vars").alias("_vars"))
    met = asked.join(p, F.col("host") == F.col("_host"), "left")
    met = met.select("host", F.col("_host").isNotNull().alias("_known"), F.coalesce(F.nullif("env", F.lit("")), "_env").alias("env"), resolved_plan(F.col("_container"), F.col("container")).alias("_chosen"), "_vars")
    met = met.join(environments.select(F.col("name").alias("_e")).distinct(), F.col("env") == F.col("_e"), "left")
    met = met.join(containers.select(F.col("name").alias("_c"), "image"), F.col("_chosen") == F.col("_c"), "left")
    fault = lambda kind, value: F.raise_error(F.concat(F.lit(f"no {kind} "), F.coalesce(value, F.lit("")))).cast("string")
    host = F.when(F.col("_known"), F.col("host")).otherwise(fault("host", F.col("host")))
    env = F.when(F.col("_e").isNotNull() | ~F.col("_known"), F.col("env")).otherwise(fault("environment", F.col("env")))
    container = F.when(F.coalesce("_chosen", F.lit("")) == "", F.lit(None)).when(F.col("_c").isNotNull(), F.col("_c")).otherwise(fault("container", F.col("_chosen")))
    none = F.create_map().cast("map<string,string>")
    merged = _map_over(base_vars if base_vars is not None else none, F.coalesce("_vars", none))
    return met.select(host.alias("host"), env.alias("env"), container.alias("container"), "image", merged.alias("vars"))


def selectors(platform: Column | str) -> Column:
    """Names that a platform answers to, most specific first."""
    p = F.col(platform) if isinstance(platform, str) else platform
    family = F.substring_index(p, "-", 1)
    return F.array_compact(F.array(p, F.when(family != p, family), F.when(family.isin("linux", "osx"), "unix")))


def ancestors(paths: DataFrame, file_name: str, path: str = "path") -> DataFrame:
    """Distinct files of a name in every folder above the paths, shortest first, with the folder's depth."""
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    depths = paths.select(parts.alias("_p")).select("_p", F.explode(F.sequence(F.lit(0), F.size("_p") - 1)).alias("depth"))
    folder = F.concat_ws("/", F.slice("_p", F.lit(1), F.col("depth")))
    return depths.select("depth", F.when(F.col("depth") == 0, F.lit(file_name)).otherwise(F.concat(folder, F.lit("/" + file_name))).alias("file")).distinct()
