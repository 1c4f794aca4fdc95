"""Sizes, speeds, durations and locations as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiples of 1024 by unit.
UNITS = {"": 1, "B": 1, "K": 1 << 10, "KB": 1 << 10, "M": 1 << 20, "MB": 1 << 20, "G": 1 << 30, "GB": 1 << 30, "T": 1 << 40, "TB": 1 << 40}


def parse_size(text: Column) -> Column:
    """Bytes of a size such as `10`, `1.5 KB` or `2g`; a fraction needs a unit and is cut off; null if it is no size."""
    pattern = r"^([0-9]+(?:\.[0-9]+)?)\s*([A-Z]*)$"
    clean = F.upper(F.trim(text))
    number, unit = F.regexp_extract(clean, pattern, 1), F.regexp_extract(clean, pattern, 2)
    factor = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])[unit]
    whole = number.rlike("^[0-9]+$")
    with_unit = F.floor(number.cast("double") * factor).cast("long")
    return F.when(clean.rlike(pattern) & factor.isNotNull() & (whole | (unit != "")), F.when(unit == "", number.try_cast("long")).otherwise(with_unit))


def format_bytes(n: Column) -> Column:
    """A size in its largest unit, to hundredths; a half goes to the even one."""
    out = F.format_string("%d B", n.cast("long"))
    for unit in ("KB", "MB", "GB", "TB"):
        out = F.when(n >= UNITS[unit], F.format_string(f"%.2f {unit}", F.bround(n / UNITS[unit], 2))).otherwise(out)
    return out


def format_speed(bytes_per_second: Column) -> Column:
    out = F.format_string("%.0f B/s", bytes_per_second.cast("double"))
    for size, unit in ((1e3, "KB/s"), (1e6, "MB/s"), (1e9, "GB/s")):
        out = F.when(bytes_per_second >= size, F.format_string(f"%.2f {unit}", bytes_per_second / size)).otherwise(out)
    return out


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    short = F.format_string("%.2fs", seconds.cast("double"))
    minutes = F.format_string("%dm %ds", F.floor(s / 60), s % 60)
    hours = F.format_string("%dh %dm %ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.when(seconds >= 3600, hours).when(seconds >= 60, minutes).otherwise(short)


def parse_location(text: Column) -> Column:
    """A struct (kind, user, host, bucket, path, region, endpoint) of `s3://bucket/key?region=&endpoint=`,
    `user@host:/path`, `host:/path` or a local path. A single letter before the colon is a drive, and a colon behind a
    slash belongs to a local path. The query of an object location counts only behind a slash after the bucket."""
    s3 = text.startswith("s3://")
    rest = F.regexp_extract(text, r"^s3://(.*)$", 1)
    slash = F.instr(rest, "/") > 0
    bucket = F.when(slash, F.regexp_extract(rest, r"^([^/]*)/", 1)).otherwise(rest)
    tail = F.when(slash, F.regexp_extract(rest, r"^[^/]*/(.*)$", 1)).otherwise("")
    key, query = F.regexp_extract(tail, r"^([^?]*)", 1), F.regexp_extract(tail, r"^[^?]*\?(.*)$", 1)
    of = lambda name: F.nullif(F.regexp_extract(query, rf"(?:^|&){name}=([^&]*)", 1), F.lit(""))
    before = F.regexp_extract(text, r"^([^:]*):", 1)
    remote = ~s3 & (F.instr(text, ":") > 0) & ~before.contains("/") & (F.length(before) != 1) & (before != "")
    none = F.lit(None).cast("string")
    return F.struct(
        F.when(s3, "s3").when(remote, "remote").otherwise("local").alias("kind"),
        F.when(remote & before.contains("@"), F.regexp_extract(before, r"^([^@]*)@", 1)).alias("user"),
        F.when(remote, F.regexp_replace(before, "^[^@]*@", "")).alias("host"),
        F.when(s3, bucket).alias("bucket"),
        F.when(s3, key).when(remote, F.regexp_extract(text, r"^[^:]*:(.*)$", 1)).otherwise(text).alias("path"),
        F.when(s3, of("region")).otherwise(none).alias("region"),
        F.when(s3, of("endpoint")).otherwise(none).alias("endpoint"),
    )


def format_location(at: Column) -> Column:
    """The inverse of parse_location()."""
    query = F.concat_ws("&", F.concat(F.lit("region="), at["region"]), F.concat(F.lit("endpoint="), at["endpoint"]))
    s3 = F.concat(F.lit("s3://"), at["bucket"], F.when((at["path"] != "") | (query != ""), F.concat(F.lit("/"), at["path"])).otherwise(""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    remote = F.concat(F.when(at["user"].isNotNull(), F.concat(at["user"], F.lit("@"))).otherwise(""), at["host"], F.lit(":"), at["path"])
    return F.when(at["kind"] == "s3", s3).when(at["kind"] == "remote", remote).otherwise(at["path"])
