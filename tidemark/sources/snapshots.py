"""Snapshots: one row for each keyed object, with path, size, mtime and is_dir at least."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ancestors, key_to_path, parent, relative_to
from .tree import TreeSource


def scan_tree(spark: SparkSession, root: str, content: bool = False, dirs: bool = True, links: DataFrame | None = None, follow: bool = False, parts: int = 16) -> DataFrame:
    """What lies below root: path relative to it, size, mtime, is_dir, is_symlink, symlink_target. Contents are read only if
    asked for; directories have none.

    A path without a scheme, or with `file:`, is a mounted tree, listed by `parts` tasks (tree.TreeSource): empty directories
    and links are rows, a link's target is kept as it is written and not followed, and there are inode, nlink, blocks and error
    (why a directory or file could not be read). With `follow` links are entered; one that leads to a directory above it has an error.

    Other schemes go through Spark's reader, which lists files alone: each directory with a file somewhere below it is a
    row, of size 0 and the time of its latest file. `links`, rows (path, target) of a listing that knows them, puts a
    link's row in the place of the file's that it was read through.
    """
    none = F.lit(None).cast("string")
    if "://" in root and not root.startswith("file:"):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        plain = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
        bare = "/" + root.split(":", 1)[-1].lstrip("/")
        out = files.select(relative_to(plain, bare).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.lit(False).alias("is_dir"), F.lit(False).alias("is_symlink"), none.alias("symlink_target"), "content")
        if not content:
            out = out.drop("content")
        if dirs:
            above = out.select(F.explode(ancestors(F.col("path"))).alias("path"), "mtime").groupBy("path").agg(F.max("mtime").alias("mtime"))
            rows = above.select("path", F.lit(0).cast("long").alias("size"), "mtime", F.lit(True).alias("is_dir"), F.lit(False).alias("is_symlink"), none.alias("symlink_target"))
            out = out.unionByName(rows, allowMissingColumns=True)
    else:
        spark.dataSource.register(TreeSource)
        options = {"path": root, "parts": parts, "follow": follow, "content": content}
        out = spark.read.format(TreeSource.name()).options(**options).load()
        out = out if dirs else out.where("not is_dir")
    if links is not None:
        known = links.select("path", F.col("target").alias("__target"))
        out = out.join(known, "path", "left").withColumns({"is_symlink": F.col("__target").isNotNull(), "symlink_target": F.col("__target")}).drop("__target")
    return out


def tree_targets(df: DataFrame, root: str) -> DataFrame:
    """A scan with symlink_target as a path of the tree: relative targets from their link's directory, absolute ones below
    root, without `.` and `..`; null for what lies outside."""
    inside = root.rstrip("/") + "/"
    target, up = F.col("symlink_target"), parent(F.col("path"))
    whole = F.when(target.startswith("/"), F.when(F.concat(target, F.lit("/")).startswith(inside), F.substring(target, len(inside) + 1, 1 << 30))).otherwise(F.concat_ws("/", F.when(up != "", up), target))
    # `..` takes one name back; with none to take, the target lies outside
    step = lambda at, name: F.when((name == "") | (name == "."), at).when(name != "..", F.concat(at, F.array(name))).when(F.size(at) > 0, F.slice(at, 1, F.size(at) - 1))
    names = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
    return df.withColumn("symlink_target", F.array_join(names, "/"))


def tree_changes(spark: SparkSession, root: str, state: str, initial: bool = True, parts: int = 16) -> DataFrame:
    """A stream of changes (path, ts, kind, is_dir) of a mounted tree, found by comparing listings; each trigger lists the
    tree in `parts` tasks. `state` is a folder that all executors share and that this stream has for itself. With `initial` what is
    there at first comes as created."""
    spark.dataSource.register(TreeSource)
    return spark.readStream.format(TreeSource.name()).options(path=root, state=state, initial=initial, parts=parts).load()


def scan_objects(inventory: DataFrame, prefix: str) -> DataFrame:
    """An object listing (key, size, mtime) as a snapshot of what lies below the prefix; a key that ends in a slash is a
    directory. The prefix itself is no row."""
    of = inventory.where(F.col("key").startswith(prefix)).withColumn("path", key_to_path(F.col("key"), prefix))
    is_dir = F.col("key").endswith("/")
    return of.where("path <> ''").select(F.when(is_dir, F.regexp_replace("path", "/+$", "")).otherwise(F.col("path")).alias("path"), F.when(is_dir, 0).otherwise(F.col("size")).alias("size"), "mtime", is_dir.alias("is_dir"))


def as_snapshot(df: DataFrame, key: Column, mtime: Column, content: Column | None = None, size: Column | None = None) -> DataFrame:
    """Any table as a snapshot; without a size it is the content's length in bytes."""
    if size is None and content is None:
        raise ValueError("a size or a content is needed")
    n = size if size is not None else F.octet_length(content)
    columns = [key.cast("string").alias("path"), n.cast("long").alias("size"), mtime.alias("mtime"), F.lit(False).alias("is_dir")]
    return df.select(*columns, *([content.alias("content")] if content is not None else []))


def with_sparse_flag(df: DataFrame) -> DataFrame:
    """is_sparse: over 4096 bytes, and at least so many more than the 512-byte blocks allocated hold."""
    allocated = F.col("blocks") * 512
    return df.withColumn("allocated_size", allocated).withColumn("is_sparse", (F.col("size") > 4096) & (allocated < F.greatest(F.col("size") - 4096, F.lit(0))))


def changes_only(events: DataFrame) -> DataFrame:
    """Of change events (path, ts, kind) those that create, modify or remove; batch or stream."""
    return events.where(F.col("kind").isin("create", "modify", "remove"))


def change_stream(spark: SparkSession, folder: str, schema: str, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Change events from parquet files as they arrive in a folder; max_files or max_bytes holds back what one trigger takes."""
    if max_files and max_bytes:
        raise ValueError("max_files and max_bytes exclude one another")
    reader = spark.readStream.schema(schema)
    for name, most in (("maxFilesPerTrigger", max_files), ("maxBytesPerTrigger", max_bytes)):
        reader = reader.option(name, most) if most else reader
    return changes_only(reader.parquet(folder))


def write_snapshot(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """A new version of a snapshot as parquet; codec is none, lz4 or zstd."""
    if codec not in ("none", "lz4", "zstd"):
        raise ValueError(f"unknown codec {codec}")
    df.write.mode("overwrite").option("compression", {"lz4": "lz4_raw"}.get(codec, codec)).parquet(path)
