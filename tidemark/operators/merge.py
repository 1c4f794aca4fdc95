"""Bidirectional merges: a three-way comparison with remembered state, conflict strategies and the new state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.paths import extension, parent, stem
from .state import pivot_state
from .tables import stored

STRATEGIES = ("newer", "larger", "smaller", "source", "dest", "rename")
CONFLICTS = ("CreateCreateConflict", "ModifiedBoth", "ModifyDeleteConflict")


def strategy_name(text: str) -> str:
    """A strategy by its name in any case."""
    if text.lower() not in STRATEGIES:
        raise ValueError(f"unknown strategy {text}")
    return text.lower()


def classify(src: DataFrame, dst: DataFrame, state: DataFrame) -> DataFrame:
    """Rows (path, change_type, s_size, s_mtime, d_size, d_mtime, ps_size, ...) of what changed since the state was kept.

    A side is modified if its size differs from the one remembered or its time is later. Two present sides are equal if
    their sizes are. A path that is a directory on either side gives no row. A row is there whatever its size: one of unknown
    size equals another of unknown size, and differs from any known one. s_there and d_there tell which sides have the path.
    """
    one = lambda df, p: df.select("path", F.col("size").alias(f"{p}_size"), F.col("mtime").alias(f"{p}_mtime"), F.col("is_dir").alias(f"{p}_dir"), F.lit(True).alias(f"in_{p}"))
    j = one(src, "s").join(one(dst, "d"), "path", "full_outer").join(pivot_state(state), "path", "left")
    j = j.where(~F.coalesce("s_dir", F.lit(False)) & ~F.coalesce("d_dir", F.lit(False)))
    s, d, ps, pd = (F.coalesce(f"in_{x}", F.lit(False)) for x in ("s", "d", "ps", "pd"))
    changed = lambda x: ~F.col(f"{x}_size").eqNullSafe(F.col(f"p{x}_size")) | F.coalesce(F.col(f"{x}_mtime") > F.col(f"p{x}_mtime"), F.lit(False))
    eq, ms, md = F.col("s_size").eqNullSafe(F.col("d_size")), changed("s"), changed("d")
    both = (
        F.when(~ps & ~pd, F.when(~eq, "CreateCreateConflict"))
        .when(ps & pd, F.when(ms & md, F.when(~eq, "ModifiedBoth")).when(ms, "ModifiedInSource").when(md, "ModifiedInDest"))
        .when(ps, F.when(eq, None).when(ms, "CreateCreateConflict").otherwise("NewInDest"))
        .otherwise(F.when(eq, None).when(md, "CreateCreateConflict").otherwise("NewInSource"))
    )
    only_s = F.when(ps & pd, F.when(ms, "ModifyDeleteConflict").otherwise("DeletedFromDest")).when(pd, "DeletedFromDest").otherwise("NewInSource")
    only_d = F.when(ps & pd, F.when(md, "ModifyDeleteConflict").otherwise("DeletedFromSource")).when(ps, "DeletedFromSource").otherwise("NewInDest")
    kind = F.when(s & d, both).when(s, only_s).when(d, only_d)
    return j.withColumn("change_type", kind).where("change_type is not null").select("path", "change_type", *[f"{x}_{c}" for x in ("s", "d", "ps", "pd") for c in ("size", "mtime")], s.alias("s_there"), d.alias("d_there"))


def conflict_name(path, side: str, stamp: int):
    """`stem.conflict-<stamp>-<side>.extension` in the same directory."""
    up = parent(path)
    name = F.concat(stem(path), F.lit(f".conflict-{stamp}-{side}"), F.when(extension(path).isNotNull(), F.concat(F.lit("."), extension(path))).otherwise(""))
    return F.when(up != "", F.concat(up, F.lit("/"), name)).otherwise(name)


def resolve(changes: DataFrame, strategy: str, stamp: int = 0) -> DataFrame:
    """Rows (path, action, winner_size, winner_mtime, conflict_source_path, conflict_dest_path).

    newer, larger and smaller fall back to rename on a tie; where one side is missing, the other wins. source and dest
    delete the other side where theirs is missing. rename keeps both under new names, and copies where one is missing.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    s, d = F.col("s_there"), F.col("d_there")
    to_dest, to_source, rename = F.lit("CopyToDest"), F.lit("CopyToSource"), F.lit("RenameConflict")
    one_sided = F.when(~d, to_dest).when(~s, to_source)
    a, b = {"newer": ("s_mtime", "d_mtime"), "larger": ("s_size", "d_size"), "smaller": ("d_size", "s_size")}.get(strategy, ("s_size", "d_size"))
    won = {
        "source": F.when(s, to_dest).otherwise("DeleteFromDest"),
        "dest": F.when(d, to_source).otherwise("DeleteFromSource"),
        "rename": one_sided.otherwise(rename),
    }.get(strategy, one_sided.when(F.col(a) > F.col(b), to_dest).when(F.col(a) < F.col(b), to_source).otherwise(rename))
    kind = F.col("change_type")
    action = (
        F.when(kind.isin("NewInSource", "ModifiedInSource"), to_dest).when(kind.isin("NewInDest", "ModifiedInDest"), to_source)
        .when(kind == "DeletedFromSource", "DeleteFromDest").when(kind == "DeletedFromDest", "DeleteFromSource").otherwise(won)
    )
    out = changes.withColumn("action", action)
    win = lambda c: F.when(F.col("action") == "CopyToDest", F.col(f"s_{c}")).when(F.col("action") == "CopyToSource", F.col(f"d_{c}"))
    names = [F.when(F.col("action") == "RenameConflict", conflict_name(F.col("path"), side, stamp)).alias(f"conflict_{side}_path") for side in ("source", "dest")]
    return out.select("path", "change_type", "action", win("size").alias("winner_size"), win("mtime").alias("winner_mtime"), *names, "s_size", "s_mtime", "d_size", "d_mtime")


def merged_sides(src: DataFrame, dst: DataFrame, actions: DataFrame) -> DataFrame:
    """Both new snapshots in one table, as rows (side, ...) with side 'source' or 'dest'. A renamed conflict moves each
    side's own row; the copies are not exchanged.

    Both sides and the actions are united and grouped by path, so that each is moved once; every path then gives the rows
    that it leaves on either side.
    """
    columns = [c for c in src.columns if c in dst.columns and c != "path"]
    none = F.lit(None)
    kind = src.select(F.struct(*columns).alias("r")).schema["r"].dataType
    row = lambda df, side: df.select("path", F.lit(side).alias("side"), F.struct(*columns).cast(kind).alias("r"), none.cast("string").alias("action"), none.cast("string").alias("to_s"), none.cast("string").alias("to_d"))
    todo = actions.select("path", F.lit("action").alias("side"), none.cast(kind).alias("r"), "action", F.col("conflict_source_path").alias("to_s"), F.col("conflict_dest_path").alias("to_d"))
    rows = row(src, "source").unionByName(row(dst, "dest")).unionByName(todo)
    of = lambda side: F.max_by("r", F.when(F.col("side") == side, 1))
    met = rows.groupBy("path").agg(of("source").alias("s"), of("dest").alias("d"), *[F.max(c).alias(c) for c in ("action", "to_s", "to_d")])
    a = F.coalesce("action", F.lit(""))

    def left(side, own, other, copy, delete, name):
        new = F.when(a == copy, F.col(other)).when(a != delete, F.col(own))
        path = F.when(a == "RenameConflict", F.col(name)).otherwise(F.col("path"))
        return F.when(new.isNotNull(), F.struct(F.lit(side).alias("side"), path.alias("path"), new.alias("r")))

    both = F.array(left("source", "s", "d", "CopyToSource", "DeleteFromSource", "to_s"), left("dest", "d", "s", "CopyToDest", "DeleteFromDest", "to_d"))
    return met.select(F.explode(both).alias("x")).where("x is not null").select("x.side", "x.path", "x.r.*")


def apply_merge(src: DataFrame, dst: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both new snapshots, in the columns that the sides have in common. They are made in one pass and stored; each is then
    a filter over what is stored."""
    both, columns = stored(merged_sides(src, dst, actions)), [c for c in src.columns if c in dst.columns]
    return tuple(both.where(F.col("side") == side).select(*columns) for side in ("source", "dest"))


def update_state(state: DataFrame, actions: DataFrame, now, sides: str = "both") -> DataFrame:
    """The state after the actions: a copy leaves the winner's size and time on both sides, or only on the receiving one
    (sides='receiver'); a deletion drops the path; a rename leaves both sides' values under the old path."""
    if sides not in ("both", "receiver"):
        raise ValueError(f"unknown sides {sides}")

    action, renamed = F.col("action"), F.col("action") == "RenameConflict"
    copies = ["CopyToDest", "CopyToSource"]
    writes = {"dest": action.isin(*(copies if sides == "both" else copies[:1])) | renamed, "source": action.isin(*(copies if sides == "both" else copies[1:])) | renamed}
    kept = state.join(actions.select("path", "action"), "path", "left")
    gone = action.isin("DeleteFromSource", "DeleteFromDest") | F.when(F.col("side") == "dest", writes["dest"]).otherwise(writes["source"])
    kept = kept.where(~F.coalesce(gone, F.lit(False))).select(*state.columns)

    def row(side, p):
        of = lambda c: F.when(renamed, F.col(f"{p}_{c}")).otherwise(F.col(f"winner_{c}")).alias(c)
        return F.when(writes[side], F.struct(F.lit(side).alias("side"), of("mtime"), of("size")))

    new = actions.select("path", F.explode(F.array(row("source", "s"), row("dest", "d"))).alias("r")).where("r is not null")
    new = new.select("path", "r.side", "r.mtime", "r.size", F.lit(None).cast("string").alias("checksum"), now.alias("last_sync"))
    return kept.unionByName(new.select(*state.columns))


def _stats(a, dry_run: bool) -> list:
    renamed = F.when(a == "RenameConflict", F.col("s_size") + F.col("d_size")).otherwise(0) if dry_run else F.lit(0)
    return [
        F.count_if(a.isin("CopyToDest", "RenameConflict")).alias("to_dest"), F.count_if(a.isin("CopyToSource", "RenameConflict")).alias("to_source"),
        F.count_if(a == "DeleteFromSource").alias("deleted_from_source"), F.count_if(a == "DeleteFromDest").alias("deleted_from_dest"),
        F.count_if(a == "RenameConflict").alias("renamed"),
        F.coalesce(F.sum(F.coalesce("winner_size", F.lit(0)) + renamed), F.lit(0)).cast("long").alias("bytes"),
    ]


def merge_stats(actions: DataFrame, dry_run: bool = True) -> DataFrame:
    """One row of counts and bytes; a rename counts once for each side, and its bytes only in a dry run."""
    return actions.agg(*_stats(F.col("action"), dry_run))


def conflict_report(changes: DataFrame, strategy: str) -> DataFrame:
    kind = F.col("change_type")
    text = F.when(kind == "ModifiedBoth", "both modified").when(kind == "CreateCreateConflict", "created on both sides").otherwise("modified vs deleted")
    return changes.where(kind.isin(*CONFLICTS)).select("path", "s_size", "s_mtime", "d_size", "d_mtime", F.lit(strategy).alias("strategy"), text.alias("conflict"))


def merge_deletion_guard(changes: DataFrame, percent: int) -> DataFrame:
    """One row (deletions, changes, ok): deletions may be that share of all changes; 0 sets no limit."""
    out = changes.agg(F.count_if(F.col("change_type").isin("DeletedFromSource", "DeletedFromDest")).alias("deletions"), F.count("*").alias("changes"))
    over = (F.col("changes") > 0) & (F.col("deletions") * 100 > F.col("changes") * percent)
    return out.withColumn("ok", F.lit(True) if percent == 0 else ~over)


def observed(actions: DataFrame) -> tuple[DataFrame, Observation]:
    """Actions, and their counts as whatever writes them sees them go by: deletions, changes, and the columns of merge_stats()."""
    watch = Observation("merge")
    a = F.col("action")
    counts = [F.count_if(F.col("change_type").isin("DeletedFromSource", "DeletedFromDest")).alias("deletions"), F.count(F.lit(1)).alias("changes")]
    return actions.observe(watch, *counts, *_stats(a, dry_run=False)), watch


def bisync(src: DataFrame, dst: DataFrame, state: DataFrame, now, strategy: str = "newer", percent: int = 50, stamp: int = 0, sides: str = "both", force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new source, new destination, new state); raises where the deletions exceed the guard. Changes are found once: their
    actions, narrow rows, go to the checkpoint folder, the guard reads the counts taken as they are written, and all three
    results read them there."""
    actions, watch = observed(resolve(classify(src, dst, state), strategy_name(strategy), stamp))
    actions = stored(actions)
    found = watch.get
    if not force and percent and found["deletions"] * 100 > found["changes"] * percent:
        raise ValueError(f"{found['deletions']} of {found['changes']} changes are deletions, more than {percent} %")
    return *apply_merge(src, dst, actions), update_state(state, actions, now, sides)
