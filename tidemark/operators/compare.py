"""One-way plans, their application, and audits. Two snapshots meet in one join on path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors
from .tables import stored

MODES = ("mtime", "size", "ignore_times", "checksum")
#: Verification modes and the checksum and block check that each asks for.
VERIFICATION = {"fast": ("none", False), "standard": ("fast", False), "verify": ("cryptographic", False), "paranoid": ("cryptographic", True)}


def pick_mode(size_only: bool = False, ignore_times: bool = False, checksum: bool = False) -> str:
    """The comparison that the options ask for; they exclude one another."""
    if size_only + ignore_times + checksum > 1:
        raise ValueError("size_only, ignore_times and checksum exclude one another")
    return "size" if size_only else "ignore_times" if ignore_times else "checksum" if checksum else "mtime"


def same_time(a: Column, b: Column, tolerance: int = 1) -> Column:
    """Whole seconds between them are at most the tolerance; so anything under two seconds is equal."""
    return F.floor(F.abs(F.unix_micros(a) - F.unix_micros(b)) / 1_000_000) <= tolerance


def _named(df: DataFrame, side: str) -> DataFrame:
    columns = [F.col(c).alias(f"{side}_{c}") for c in ("size", "mtime", "is_dir", *(["checksum"] if "checksum" in df.columns else []))]
    return df.select("path", *columns, F.lit(True).alias(f"in_{side}"))


def _changed(mode: str) -> Column:
    """Whether a file that both sides have needs an update, over src_ and dst_ columns."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "checksum":
        return F.coalesce(F.col("src_checksum") != F.col("dst_checksum"), F.lit(True))
    if mode == "ignore_times":
        return F.lit(True)
    # what is unknown on either side may differ
    sizes = F.coalesce(F.col("src_size") != F.col("dst_size"), F.lit(True))
    return sizes if mode == "size" else sizes | ~F.coalesce(same_time(F.col("src_mtime"), F.col("dst_mtime")), F.lit(False))


def _action(mode: str) -> Column:
    return F.when(F.col("in_src").isNull(), "delete").when(F.col("in_dst").isNull(), "create").when(F.col("src_is_dir"), "skip").when(_changed(mode), "update").otherwise("skip")


_PLAN = ("path", "action", "is_dir", "src_size", "dst_size", "src_mtime", "dst_mtime")


def plan_oneway(src: DataFrame, dst: DataFrame, mode: str = "mtime") -> DataFrame:
    """Rows (path, action, is_dir, src_size, dst_size, src_mtime, dst_mtime) for every source row: create, update or skip.

    A directory that exists is skipped. A file is updated if sizes differ or times do (mtime), if sizes differ (size),
    always (ignore_times), or if checksums differ (checksum); a size, time or checksum that is unknown on either side counts as
    different.
    """
    j = _named(src, "src").join(_named(dst, "dst"), "path", "left")
    return j.withColumn("action", _action(mode)).withColumn("is_dir", F.col("src_is_dir")).select(*_PLAN)


def plan_deletes(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Deletions, in the columns of plan_oneway(), of destination rows that the filtered source lacks."""
    gone = _named(dst, "dst").join(src.select("path"), "path", "left_anti")
    none = F.lit(None)
    return gone.select("path", F.lit("delete").alias("action"), F.col("dst_is_dir").alias("is_dir"), none.cast("long").alias("src_size"), "dst_size", none.cast("timestamp").alias("src_mtime"), "dst_mtime")


def plan_sync(src: DataFrame, dst: DataFrame, mode: str = "mtime", delete: bool = True) -> DataFrame:
    """plan_oneway() and, with `delete`, plan_deletes() in one join."""
    j = _named(src, "src").join(_named(dst, "dst"), "path", "full_outer" if delete else "left")
    return j.withColumn("action", _action(mode)).withColumn("is_dir", F.coalesce("src_is_dir", "dst_is_dir")).select(*_PLAN)


def _whole(df: DataFrame, side: str, columns: list[str]) -> DataFrame:
    return df.select("path", F.lit(True).alias(f"in_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in columns if c != "path"])


def apply_plan(src: DataFrame, dst: DataFrame, plan: DataFrame) -> DataFrame:
    """The new destination: created and updated rows from the source, deleted ones gone, all others as they were.

    For a plan that came from elsewhere (a table, a plan with some paths taken out). Each side and the plan are moved once:
    rows of all three are united and grouped by path. synchronise() plans and applies in one join.
    """
    columns = [c for c in dst.columns if c in src.columns]
    picked = F.struct(*columns)
    none = F.lit(None)
    row = lambda df, side: df.select("path", F.lit(side).alias("side"), picked.alias("row"), none.cast("string").alias("action"))
    kind = dst.select(picked.alias("row")).schema["row"].dataType
    todo = plan.select("path", F.lit("plan").alias("side"), none.cast(kind).alias("row"), "action")
    rows = row(src, "src").withColumn("row", F.col("row").cast(kind)).unionByName(row(dst, "dst")).unionByName(todo)
    of = lambda side: F.max_by("row", F.when(F.col("side") == side, 1))
    met = rows.groupBy("path").agg(of("src").alias("s"), of("dst").alias("d"), F.max("action").alias("action"))
    new = F.when(F.col("action").isin("create", "update"), F.col("s")).when(F.col("action") == "delete", none).otherwise(F.col("d"))
    return met.select(new.alias("row")).where("row is not null").select("row.*")


def synchronise(src: DataFrame, dst: DataFrame, mode: str = "mtime", delete: bool = True) -> DataFrame:
    """The new destination after plan_sync(): the plan is decided and each row picked in one full outer join."""
    columns = [c for c in dst.columns if c in src.columns]
    more = list(dict.fromkeys([*columns, "size", "mtime", "is_dir", *(["checksum"] if mode == "checksum" else [])]))
    j = _whole(src, "src", more).join(_whole(dst, "dst", more), "path", "full_outer").withColumn("action", _action(mode))
    new = F.col("action").isin("create", "update")
    kept = j if not delete else j.where("action <> 'delete'")
    return kept.select(*[F.col("path") if c == "path" else F.when(new, F.col(f"src_{c}")).otherwise(F.col(f"dst_{c}")).alias(c) for c in columns])


def resume_plan(plan: DataFrame, completed: DataFrame, flags: dict, completed_flags: dict) -> DataFrame:
    """What is left of a plan after the completed paths of a run with the same flags; the whole plan after another run."""
    return plan.join(completed.select("path"), "path", "left_anti") if flags == completed_flags else plan


def verify(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Rows (path, status) of all files: matched, mismatched, only_source or only_dest, by checksum."""
    files = lambda df, side: df.where(~F.col("is_dir")).select("path", F.col("checksum").alias(side), F.lit(True).alias(f"in_{side}"))
    j = files(src, "s").join(files(dst, "d"), "path", "full_outer")
    status = F.when(F.col("in_d").isNull(), "only_source").when(F.col("in_s").isNull(), "only_dest").when(F.col("s") == F.col("d"), "matched").otherwise("mismatched")
    return j.select("path", status.alias("status"))


def verify_summary(detail: DataFrame, errors: int = 0) -> DataFrame:
    """One row of counts, with exit_status 2 after errors, 1 with differences and 0 otherwise."""
    n = {s: F.count_if(F.col("status") == s).alias(s) for s in ("matched", "mismatched", "only_source", "only_dest")}
    out = detail.agg(*n.values())
    return out.withColumn("exit_status", F.lit(2) if errors else F.when(F.col("mismatched") + F.col("only_source") + F.col("only_dest") > 0, 1).otherwise(0))


def verify_apply(src: DataFrame, new_dst: DataFrame, plan: DataFrame) -> DataFrame:
    """One row (verified, failures) over the created and updated files of an applied plan. The paths and checksums of all
    three are united and grouped by path, so that each is moved once."""
    none = F.lit(None)
    one = lambda df, side: df.select("path", *[(F.col("checksum") if c == side else none.cast("string")).alias(c) for c in ("s", "d")], F.lit(False).alias("done"))
    done = plan.where("action in ('create', 'update') and not is_dir").select("path", none.cast("string").alias("s"), none.cast("string").alias("d"), F.lit(True).alias("done"))
    met = one(src, "s").unionByName(one(new_dst, "d")).unionByName(done).groupBy("path").agg(F.max("s").alias("s"), F.max("d").alias("d"), F.max("done").alias("done")).where("done")
    same = F.coalesce(F.col("s") == F.col("d"), F.lit(False))
    return met.agg(F.count_if(same).alias("verified"), F.count_if(~same).alias("failures"))


def hardlink_plan(df: DataFrame) -> DataFrame:
    """Rows (path, inode, kind, link_to, bytes): of files that share an inode the first by path is copied, and the others
    become links to it without bytes."""
    first = df.where("nlink > 1").groupBy("inode").agg(F.min("path").alias("first"))
    j = df.join(first, "inode", "left")
    link = (F.col("nlink") > 1) & (F.col("path") != F.col("first"))
    return j.select("path", "inode", F.when(link, "link").otherwise("copy").alias("kind"), F.when(link, F.col("first")).alias("link_to"), F.when(link, 0).otherwise(F.col("size")).cast("long").alias("bytes"))


def symlink_plan(df: DataFrame, mode: str) -> DataFrame:
    """Rows (path, kind, source): links are kept (preserve), replaced by their target's content (follow; dropped where
    that is missing or a directory) or dropped (skip); plain rows are copied."""
    if mode not in ("preserve", "follow", "skip"):
        raise ValueError(f"unknown mode {mode}")
    plain = df.where("not is_symlink").select("path", F.lit("copy").alias("kind"), F.col("path").alias("source"))
    links = df.where("is_symlink")
    if mode == "skip":
        return plain
    if mode == "preserve":
        return plain.unionByName(links.select("path", F.lit("link").alias("kind"), F.col("symlink_target").alias("source")))
    files = df.where("not is_dir").select(F.col("path").alias("symlink_target"))
    return plain.unionByName(links.join(files, "symlink_target").select("path", F.lit("copy").alias("kind"), F.col("symlink_target").alias("source")))


#: Paths longer than this no system resolves.
LONGEST_PATH = 4096


def resolve_links(df: DataFrame) -> DataFrame:
    """Rows (path, target) of the links (path, symlink_target; targets are paths of the same tree): where each leads once
    no part of the target is a link any more; null for a chain of links that never ends.

    Each step replaces the longest beginning of a target that is a link by what that link leads to by then, so that the
    distance followed doubles. A link that goes in circles alone stays; as soon as as many steps as a target has names settle
    none, what is left goes in circles. Repeated rows of a path count once, with the smallest target.
    """
    links = df.where("is_symlink and path is not null").groupBy("path").agg(F.min("symlink_target").alias("target")).where("target is not null")
    at = stored(links.select("path", "target", F.lit(False).alias("done")))
    names = links.agg(F.coalesce(F.max(F.size(F.split("target", "/"))), F.lit(0))).first()[0]
    still, idle = None, 0
    while True:
        left = at.where("not done").count()
        idle = idle + 1 if left == still else 0
        still = left
        if not left or idle > names:
            break
        known = at.select(F.col("path").alias("begin"), F.col("target").alias("to"))
        open_ = at.where("not done")
        begins = open_.select("path", "target", F.explode(F.concat(ancestors(F.col("target")), F.array("target"))).alias("begin"))
        hop = begins.join(known, "begin").groupBy("path", "target").agg(F.max_by(F.struct("begin", "to"), F.length("begin")).alias("h"))
        rest = F.substring("target", F.length("h.begin") + F.lit(1), F.length("target"))
        joined = F.when(F.col("h.to") == "", F.regexp_replace(rest, "^/", "")).otherwise(F.concat("h.to", rest))
        moved = hop.select("path", joined.alias("next"), F.lit(True).alias("hit"))
        # what leads into a target without end, or grows without one, has none
        nxt = F.when(F.length("next") <= LONGEST_PATH, F.col("next"))
        step = open_.join(moved, "path", "left").select("path", F.when(F.col("hit"), nxt).otherwise(F.col("target")).alias("target"), (F.col("hit").isNull() | nxt.isNull()).alias("done"))
        at = stored(at.where("done").unionByName(step))
    settled = at.where("done").select("path", "target")
    return links.select("path").join(settled, "path", "left")


def symlink_loops(df: DataFrame) -> DataFrame:
    """Paths of links that a walk which follows links never comes to the end of: chains of links in circles, links to a
    directory above them, directories that lead into one another, and links that lead to any of these.

    A link is endless if its target, as resolved, is or holds an endless link. Each step keeps the links whose target is
    a directory above a link that is left, until none goes: links meet the directories above the links, never one another.
    """
    to = stored(resolve_links(df))
    circles = to.where("target is null").select("path")
    left = to.where("target is not null")
    n = left.count()
    while n:
        ends = left.select("path").unionByName(circles)
        holds = ends.select(F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("path")), F.array("path"))).alias("target")).distinct()
        left = stored(left.join(holds, "target", "left_semi").select("path", "target"))
        before, n = n, left.count()
        if n == before:
            break
    return circles.unionByName(left.select("path"))


def incremental_scan(fresh: DataFrame, dirs: DataFrame, dir_cache: DataFrame, file_cache: DataFrame) -> DataFrame:
    """Rows (path, size, mtime, dir): of directories (dir, mtime) that the cache holds with the same time, the cached
    children; of all others the fresh ones."""
    hit = dirs.join(dir_cache.select("dir", F.col("mtime").alias("cached")), "dir").where(same_time(F.col("mtime"), F.col("cached"))).select("dir")
    columns = ["path", "size", "mtime", "dir"]
    return file_cache.join(hit, "dir", "left_semi").select(*columns).unionByName(fresh.join(hit, "dir", "left_anti").select(*columns))
