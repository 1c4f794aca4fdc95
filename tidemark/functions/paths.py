"""Paths as columns, and globs as regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Everything before the last slash; empty at the top level."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """The base name without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(basename(path), r"(?s)^(.+)\.[^.]*$", "$1")


def extension(path: Column) -> Column:
    """The text after the last dot of the base name; null without one."""
    found = F.regexp_extract(basename(path), r"(?s)^.+\.([^.]*)$", 1)
    return F.when(basename(path).rlike(r"(?s)^.+\.[^.]*$"), found)


def path_parts(path: Column) -> Column:
    return F.struct(parent(path).alias("parent"), basename(path).alias("name"), stem(path).alias("stem"), extension(path).alias("extension"))


def ancestors(path: Column) -> Column:
    """All paths above it, shortest first; none at the top level."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def relative_to(path: Column, root: str) -> Column:
    """The path without the root and the slash behind it."""
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def key_to_path(key: Column, prefix: str) -> Column:
    """An object's path below the prefix, without slashes at its beginning."""
    cut = F.when(key.startswith(prefix), F.substring(key, len(prefix) + 1, 1 << 30)).otherwise(key) if prefix else key
    return F.regexp_replace(cut, "^/+", "")


def path_to_key(path: Column, prefix: str) -> Column:
    """The object's key for a path below the prefix; slashes at the path's beginning don't count."""
    path = F.regexp_replace(path, "^/+", "")
    return F.concat(F.lit(prefix.rstrip("/") + "/"), path) if prefix else path


def glob_to_regex(glob: str) -> str:
    """A regular expression for the whole text. `*` and `?` match slashes too; `**` between slashes matches any number of
    directories, none included; `[...]` and `[!...]` are classes."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif glob[i] == "*":
            while i < len(glob) and glob[i] == "*":
                i += 1
            out.append(".*")
        elif glob[i] == "?":
            out.append(".")
            i += 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2 + glob.startswith("[!", i))) > 0:
            body = glob[i + 1 : end].replace("\\", r"\\").replace("[", r"\[").replace("^", r"\^").replace("&", r"\&")
            out.append(f"[{'^' + body[1:] if body[:1] == '!' else body}]")
            i = end + 1
        else:
            out.append(re.sub(r"([^\w/])", r"\\\1", glob[i]))
            i += 1
    return "(?s)^" + "".join(out) + "$"
