"""Tables that runs leave behind: state, checksum cache, completed paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored


def upsert(state: DataFrame, updates: DataFrame, keys: list[str], deleted: DataFrame | None = None) -> DataFrame:
    """The table with rows of the same keys replaced by the updates (of several for one key, the last by `updated` and then
    by all columns, so that reruns agree), and without the deleted paths."""
    order = [F.col(c).desc() for c in (*(["updated"] if "updated" in updates.columns else []), *state.columns)]
    last = updates.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__nth = 1").select(*state.columns)
    out = state.join(last.select(*keys), keys, "left_anti").unionByName(last)
    return out if deleted is None else out.join(deleted.select("path"), "path", "left_anti")


def pair_id(source: str, dest: str) -> Column:
    """One number for an ordered pair of locations, to part the state of several pairs by."""
    return F.xxhash64(F.lit(source), F.lit(dest))


def clear_state(state: DataFrame, source: str, dest: str) -> DataFrame:
    return state.where(F.col("pair_id") != pair_id(source, dest))


def pivot_state(state: DataFrame) -> DataFrame:
    """One row for each path: ps_size, ps_mtime, pd_size, pd_mtime, null where a side has no row, and in_ps and in_pd."""
    def side(name, p):
        of = F.col("side") == name
        return [F.max(F.when(of, F.col(c))).alias(f"{p}_{c}") for c in ("size", "mtime")] + [F.max(of).alias(f"in_{p}")]

    return state.groupBy("path").agg(*side("source", "ps"), *side("dest", "pd"))


def with_checksum(df: DataFrame, cache: DataFrame, kind: str, compute: Column) -> DataFrame:
    """df with checksum and from_cache. A cached value counts if path, time, size and kind are all the same; only the
    other rows compute theirs. Of repeated cache rows the smallest value counts, so that no row of df is repeated."""
    c = cache.where(F.col("checksum_type") == kind).groupBy("path", F.col("size").alias("__size"), F.col("mtime").alias("__mtime")).agg(F.min("checksum").alias("__checksum"))
    j = df.join(c, (df["path"] == c["path"]) & (df["size"] == c["__size"]) & (df["mtime"] == c["__mtime"]), "left").drop(c["path"])
    hit = F.col("__checksum").isNotNull()
    return j.select(*df.columns, F.when(hit, F.col("__checksum")).otherwise(compute).alias("checksum"), hit.alias("from_cache"))


def flag_cache(cache: DataFrame, existing: DataFrame) -> DataFrame:
    """The cache with `exists`: whether its path still does. One join, two shuffles."""
    there = existing.groupBy("path").agg(F.lit(True).alias("__there"))
    return cache.join(there, "path", "left").select(*cache.columns, F.coalesce("__there", F.lit(False)).alias("exists"))


def prune_cache(cache: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows kept, paths dropped) by whether the path still exists; what is met once is read by both."""
    flagged = stored(flag_cache(cache, existing))
    return flagged.where("exists").drop("exists"), flagged.where("not exists").select("path")


def cache_stats(cache: DataFrame, fast: tuple[str, ...] = ("md5", "fast")) -> DataFrame:
    is_fast = F.col("checksum_type").isin(*fast)
    return cache.agg(F.count("*").alias("total"), F.count_if(is_fast).alias("fast"), F.count_if(~is_fast).alias("cryptographic"))


def resume_problems(runs: DataFrame, now: Column, version: int = 1) -> DataFrame:
    """runs with `problem`, the first reason not to go on from a run's state; null for a good one."""
    bad = [
        ("version", F.col("version") != version),
        ("source", ~F.col("source").startswith("/")),
        ("destination", ~F.col("destination").startswith("/")),
        ("started", F.col("started").isNull()),
        ("checkpoint", F.col("checkpoint").isNull()),
        ("future", (F.col("started") > now) | (F.col("checkpoint") > now)),
        ("order", F.col("checkpoint") < F.col("started")),
        ("count", F.col("completed") > F.col("total")),
        ("action", ~F.col("action").isin("create", "update", "delete")),
    ]
    return runs.withColumn("problem", F.coalesce(*[F.when(c, name) for name, c in bad]))


def merge_profile(df: DataFrame, defaults: dict[str, object], always: tuple[str, ...] = ("resume",)) -> DataFrame:
    """For each option x of rows with arg_x and profile_x: what the argument says if it differs from the default, else
    the profile, else the default. For the options in `always` the profile goes first."""
    def pick(x, default):
        arg, profile = F.col(f"arg_{x}"), F.col(f"profile_{x}")
        if x in always:
            return F.coalesce(profile, arg, F.lit(default))
        return F.when(arg.isNotNull() & (arg != F.lit(default)), arg).otherwise(F.coalesce(profile, F.lit(default)))

    return df.select(*[c for c in df.columns if not c.startswith(("arg_", "profile_"))], *[pick(x, d).alias(x) for x, d in defaults.items()])
