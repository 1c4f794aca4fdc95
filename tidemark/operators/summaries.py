"""Counts, guards, reports and texts of plans and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.paths import parent
from ..functions.text import format_bytes
from .tables import stored


def _counts() -> list[Column]:
    moved = F.when(F.col("action").isin("create", "update") & ~F.col("is_dir"), F.col("src_size")).otherwise(0)
    return [*[F.count_if(F.col("action") == a).alias(n) for a, n in (("create", "created"), ("update", "updated"), ("skip", "skipped"), ("delete", "deleted"))], F.coalesce(F.sum(moved), F.lit(0)).alias("bytes_to_transfer")]


def summarize(plan: DataFrame) -> DataFrame:
    """One row: rows by action, and bytes to transfer for created and updated files."""
    return plan.agg(*_counts())


def guarded_plan(plan: DataFrame, percent: int = 50, confirm: int = 1000, confirmed: bool = False, force: bool = False, available: int | None = None) -> tuple[DataFrame, dict]:
    """(the plan, stored; its summary) of a plan with deletions, as plan_sync() makes it; raises where deletion_guard() or, with
    `available` bytes, capacity_check() refuses.

    The counts are taken as the plan is written, and so are the destination's rows, which are all that aren't created: neither
    side is read again, and no guard or summary is a job of its own.
    """
    watch = Observation("plan")
    kept = stored(plan.observe(watch, *_counts(), F.count_if(F.col("action") != "create").alias("dest_rows")))
    found = dict(watch.get)
    if not force and found["deleted"] * 100 > found["dest_rows"] * percent:
        raise ValueError(f"{found['deleted']} of {found['dest_rows']} rows would be deleted, more than {percent} %")
    if not force and not confirmed and found["deleted"] > confirm:
        raise ValueError(f"{found['deleted']} deletions need a confirmation")
    need = int(found["bytes_to_transfer"])
    if available is not None and need + need // 10 > available:
        raise ValueError(f"{need + need // 10} bytes are needed, {available} available")
    return kept, found


def dry_run(plan: DataFrame) -> DataFrame:
    """One row: bytes that a run would add, change and delete."""
    size = lambda a, c: F.coalesce(F.sum(F.when((F.col("action") == a) & ~F.col("is_dir"), F.col(c))), F.lit(0))
    return plan.agg(size("create", "src_size").alias("bytes_would_add"), size("update", "src_size").alias("bytes_would_change"), size("delete", "dst_size").alias("bytes_would_delete"))


def savings(results: DataFrame) -> DataFrame:
    """One row: bytes that deltas (written - literal) and compression (written - transferred) saved, none below 0."""
    saved = lambda c: F.coalesce(F.sum(F.greatest(F.col("bytes_written") - F.col(c), F.lit(0))), F.lit(0))
    return results.agg(saved("literal_bytes").alias("delta_saved"), saved("transferred_bytes").alias("compression_saved"))


def deletion_guard(plan: DataFrame, dst: DataFrame, percent: int = 50, confirm: int = 1000) -> DataFrame:
    """One row (deletes, dest_rows, refused, needs_confirmation)."""
    one = lambda df, a, b: df.select(a.alias("deletes"), b.alias("dest_rows"))
    rows = one(plan, (F.col("action") == "delete").cast("long"), F.lit(0).cast("long")).unionByName(one(dst, F.lit(0).cast("long"), F.lit(1).cast("long")))
    n = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("deletes", "dest_rows")])
    return n.withColumns({"refused": F.col("deletes") * 100 > F.col("dest_rows") * percent, "needs_confirmation": F.col("deletes") > confirm})


def check_deletions(plan: DataFrame, dst: DataFrame, percent: int = 50, confirm: int = 1000, confirmed: bool = False, force: bool = False) -> None:
    """Raises where the guard refuses; force skips it."""
    if force:
        return
    found = deletion_guard(plan, dst, percent, confirm).first()
    if found["refused"]:
        raise ValueError(f"{found['deletes']} of {found['dest_rows']} rows would be deleted, more than {percent} %")
    if found["needs_confirmation"] and not confirmed:
        raise ValueError(f"{found['deletes']} deletions need a confirmation")


def capacity_check(plan: DataFrame, available: int) -> DataFrame:
    """One row (need, required, comfortable, status): a tenth more than the need is required, a fifth more comfortable."""
    need = summarize(plan).select(F.col("bytes_to_transfer").cast("long").alias("need"))
    out = need.withColumns({"required": F.col("need") + F.expr("need div 10"), "comfortable": F.col("need") + F.expr("need div 5")})
    return out.withColumn("status", F.when(F.col("required") > available, "error").when(F.col("comfortable") > available, "warn").otherwise("ok"))


def children_by_dir(df: DataFrame, chunk: int = 1000) -> DataFrame:
    """Rows (dir, chunk, n, children): each directory's entries (path, size), dealt into chunks of about that many by a hash
    of the path and sorted within each; n counts a chunk's entries. So no row holds a directory whole, however many
    entries it has."""
    of = df.select(parent(F.col("path")).alias("dir"), "path", "size")
    parts = of.groupBy("dir").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"))
    dealt = of.join(parts, "dir").withColumn("chunk", (F.conv(F.substring(F.md5("path"), 1, 8), 16, 10).cast("long") % F.col("parts")).cast("int"))
    return dealt.groupBy("dir", "chunk").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("path", "size"))).alias("children"))


def perf_metrics(log: DataFrame, limit: float | None = None) -> DataFrame:
    """One row (avg_speed, files_per_second, utilisation) of a log (files, bytes, transfer_seconds, total_seconds)."""
    s = log.agg(*[F.sum(c).alias(c) for c in ("files", "bytes", "transfer_seconds", "total_seconds")])
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = s.select(rate("bytes", "transfer_seconds").alias("avg_speed"), rate("files", "total_seconds").alias("files_per_second"))
    return out.withColumn("utilisation", F.col("avg_speed") / limit * 100 if limit else F.lit(None).cast("double"))


def error_rows(results: DataFrame) -> DataFrame:
    """Rows (path, error, action) of the results that failed."""
    return results.where("error is not null").select("path", "error", "action")


def error_threshold(results: DataFrame, max_errors: int) -> DataFrame:
    """One row (errors, abort) of results with `error`; 0 collects all."""
    return results.agg(F.count("error").alias("errors")).withColumn("abort", F.lit(max_errors > 0) & (F.col("errors") >= max_errors))


def check_errors(results: DataFrame, max_errors: int) -> None:
    """Raises where the threshold is reached."""
    if (found := error_threshold(results, max_errors).first())["abort"]:
        raise ValueError(f"{found['errors']} errors, {max_errors} are the limit")


def plan_text(plan: DataFrame) -> DataFrame:
    """Rows (path, text) that tell what a run would do; skipped rows have none."""
    size = F.concat(F.lit(" ("), format_bytes(F.col("src_size")), F.lit(")"))
    text = (
        F.when(F.col("action") == "create", F.concat(F.lit("Would create: "), "path", size)).when(F.col("action") == "update", F.concat(F.lit("Would update: "), "path", size))
        .when(F.col("action") == "delete", F.concat(F.lit("Would delete: "), "path"))
    )
    return plan.select("path", text.alias("text")).where("text is not null")


def events_json(plan: DataFrame, results: DataFrame | None = None, source: str | None = None, destination: str | None = None, verified: DataFrame | None = None, performance: DataFrame | None = None) -> DataFrame:
    """Rows (value): JSON events, ready for write.text(): with source and destination a start; one for each row of the plan; one for
    each failed row (path, error, action) of results; the summary; with verified, the rows (path, status) of verify(), a
    verification_result for each path that isn't matched, and one with the counts; with performance, the row of perf_metrics()."""
    event = lambda kind, *columns: F.to_json(F.struct(F.lit(kind).alias("type"), *columns)).alias("value")
    out = plan.select(F.to_json(F.struct(F.col("action").alias("type"), "path", F.col("src_size").alias("size"))).alias("value"))
    out = out.unionByName(summarize(plan).select(event("summary", "created", "updated", "skipped", "deleted", "bytes_to_transfer")))
    if source is not None:
        out = out.unionByName(plan.agg(F.count("*").alias("total_files")).select(event("start", F.lit(source).alias("source"), F.lit(destination).alias("destination"), "total_files")))
    if results is not None:
        out = out.unionByName(error_rows(results).select(event("error", "path", "error", "action")))
    if verified is not None:
        out = out.unionByName(verified.where("status <> 'matched'").select(event("verification_result", "path", "status")))
        counts = [F.count_if(F.col("status") == s).alias(s) for s in ("matched", "mismatched", "only_source", "only_dest")]
        out = out.unionByName(verified.agg(*counts).select(event("verification_result", "matched", "mismatched", "only_source", "only_dest")))
    return out if performance is None else out.unionByName(performance.select(event("performance", *performance.columns)))


def explode_acls(df: DataFrame) -> DataFrame:
    """Rows (path, kind, name, permissions) of ACL entries `kind:name:permissions`, one a line."""
    line = df.select("path", F.explode(F.split("acls", "\n")).alias("line")).where("line <> ''")
    part = F.split("line", ":")
    return line.select("path", part[0].alias("kind"), part[1].alias("name"), part[2].alias("permissions"))


def encode_xattrs(xattrs: Column) -> Column:
    """A map of binary values as base64 text, without line breaks."""
    return F.transform_values(xattrs, lambda k, v: F.regexp_replace(F.base64(v), "[\r\n]+", ""))


def decode_xattrs(xattrs: Column) -> Column:
    """The inverse; entries that aren't base64 are dropped."""
    read = F.transform_values(xattrs, lambda k, v: F.try_to_binary(v, F.lit("base64")))
    return F.map_filter(read, lambda k, v: v.isNotNull())


def keep_attributes(df: DataFrame, keep: set[str] = frozenset(), all_of: tuple[str, ...] = ("xattrs", "acls", "flags")) -> DataFrame:
    """df with the attributes that aren't asked for as null."""
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in all_of if c in df.columns and c not in keep})
