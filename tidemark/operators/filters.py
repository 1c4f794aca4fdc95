"""Ordered include and exclude rules, size ranges and ignore files."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ancestors, basename, glob_to_regex, parent
from .tables import stored


@dataclass(frozen=True)
class Rule:
    """One include or exclude rule. A trailing slash makes it a rule for directories and what is in them; another slash
    lets it match the whole path, and otherwise it matches the base name."""

    include: bool
    pattern: str

    @property
    def for_dirs(self) -> bool:
        return self.pattern.endswith("/")

    def matches(self, path: Column, is_dir: Column) -> Column:
        glob = self.pattern.rstrip("/") if self.for_dirs else self.pattern
        regex, whole = glob_to_regex(glob), "/" in glob
        name = path if whole else basename(path)
        if not self.for_dirs:
            return name.rlike(regex)
        if glob == "*":
            return is_dir & name.rlike(regex)
        above = ancestors(path)
        if not whole:
            above = F.transform(above, basename)
        return (is_dir & name.rlike(regex)) | F.exists(above, lambda a: a.rlike(regex))


def parse_rules(lines: list[str]) -> list[Rule]:
    """Rules of the lines `+ p`, `+p`, `- p`, `-p` and `p` (an exclusion); blank lines and comments are none."""
    out = []
    for line in map(str.strip, lines):
        if not line or line.startswith("#"):
            continue
        pattern = (line[1:] if line[0] in "+-" else line).strip()
        if not pattern:
            raise ValueError("empty filter pattern")
        out.append(Rule(line[0] == "+", pattern))
    return out


def load_rules(spark: SparkSession, *, filter: list[str] = (), include: list[str] = (), exclude: list[str] = (), include_from: list[str] = (), exclude_from: list[str] = (), templates: list[str] = (), ignore_file: str | None = None, template_dir: str | None = None) -> list[Rule]:
    """Rules from all places, in their order of precedence: filter lines, include and exclude patterns, files of plain
    include and exclude patterns, templates and an ignore file, both of rule lines. A template is a path, or, with
    template_dir, the name of a file `<name>.rules` there."""

    def lines(path):
        read = spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias("at")).orderBy("at")
        return [r[0] for r in read.collect()]

    plain = lambda patterns, yes: [Rule(yes, p.strip()) for p in patterns if p.strip() and not p.strip().startswith("#")]
    out = parse_rules(list(filter)) + plain(include, True) + plain(exclude, False)
    for path in include_from:
        out += plain(lines(path), True)
    for path in exclude_from:
        out += plain(lines(path), False)
    if template_dir:
        templates = [t if "/" in t else f"{template_dir.rstrip('/')}/{t}.rules" for t in templates]
    for path in [*templates, *([ignore_file] if ignore_file else [])]:
        out += parse_rules(lines(path))
    return out


def included(rules: list[Rule], path: Column, is_dir: Column) -> Column:
    """What the first rule that matches says; true if none does."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(rule.matches(path, is_dir), F.lit(rule.include)).otherwise(out)
    return out


def apply_filter(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return df.where(included(rules, F.col("path"), F.col("is_dir")))


def rule_hits(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows (rule, hits): how many rows each rule decided; -1 stands for none."""
    at = F.lit(-1)
    for i, rule in reversed(list(enumerate(rules))):
        at = F.when(rule.matches(F.col("path"), F.col("is_dir")), F.lit(i)).otherwise(at)
    return df.select(at.alias("rule")).groupBy("rule").agg(F.count("*").alias("hits"))


def prune_excluded_dirs(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Included rows that don't lie below an excluded directory row, whatever later rules say of them."""
    yes = included(rules, F.col("path"), F.col("is_dir"))
    gone = df.where(F.col("is_dir") & ~yes).select(F.col("path").alias("gone")).distinct()
    below = df.select("path", F.explode(ancestors(F.col("path"))).alias("gone")).join(gone, "gone").select("path").distinct()
    return df.where(yes).join(below, "path", "left_anti")


def filter_size(df: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Directories, and files of lo to hi bytes."""
    if lo is not None and hi is not None and lo > hi:
        raise ValueError("the smallest size is larger than the largest")
    fits = F.lit(True)
    if lo is not None:
        fits &= F.col("size") >= lo
    if hi is not None:
        fits &= F.col("size") <= hi
    return df.where(F.col("is_dir") | fits)


def ignore_regex(line: str) -> tuple[str, bool, bool] | None:
    """(regular expression for a path below the file's folder, whether the line takes back in, whether it is for directories
    only) of a line of an ignore file; None for blank lines and comments. `*`, `?` and classes don't match slashes, `**`
    stands for any number of directories; a pattern with a slash that isn't the last character counts from the folder."""
    line = line.rstrip("\r\n")
    bare = line.rstrip(" ")
    line = bare + " " if bare.endswith("\\") and len(bare) < len(line) else bare
    if not line or line.startswith("#"):
        return None
    keep, line = line.startswith("!"), line.removeprefix("!")
    dirs_only, line = line.endswith("/"), line.rstrip("/")
    if not line:
        return None
    anchored, line = "/" in line, line.lstrip("/")
    out, i = [], 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if line[i:] == "**" and line[i - 1 : i] == "/":
            out.append(".+")
            break
        if c == "*":
            while line[i + 1 : i + 2] == "*":
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := line.find("]", i + 2 + (line[i + 1 : i + 2] in ("!", "^")))) > 0:
            body = line[i + 1 : end].replace("\\", r"\\").replace("[", r"\[").replace("&", r"\&")
            out.append(f"(?!/)[^{body[1:]}]" if body[0] in "!^" else f"(?!/)[{body}]")
            i = end
        else:
            if c == "\\" and i + 1 < len(line):
                i, c = i + 1, line[i + 1]
            out.append(re.sub(r"([^\w/ ])", r"\\\1", c))
        i += 1
    return f"(?s)^{'' if anchored else '(?:.*/)?'}{''.join(out)}$", keep, dirs_only


def read_ignore_rules(tree: DataFrame, name: str = ".gitignore") -> DataFrame:
    """Rows (folder, idx, line): the lines of the ignore files of that name in a scan with contents."""
    of = tree.where(~F.col("is_dir") & (basename(F.col("path")) == name) & F.col("content").isNotNull())
    return of.select(parent(F.col("path")).alias("folder"), F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("idx", "line"))


def literal_of(regex: str) -> tuple[bool, str] | None:
    """(whether it counts from the folder, the text) of a regular expression of ignore_regex() that fits one text alone."""
    body = regex.removeprefix("(?s)^").removesuffix("$")
    anchored, body = not body.startswith("(?:.*/)?"), body.removeprefix("(?:.*/)?")
    if not re.fullmatch(r"(?s)(?:\\.|[\w/ ])+", body) or (not anchored and "/" in body):
        return None
    return anchored, re.sub(r"(?s)\\(.)", r"\1", body)


def _ignore_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (folder, lines): each folder's rules with wildcards, the last line first; and rows (scope, name, any, dir) for
    the rules that name one text: what the last of them says of anything, or of directories, of that name below the scope. One
    that counts from its folder has the whole path for a scope and no name."""

    @F.pandas_udf("regex string, keep boolean, dirs_only boolean, anchored boolean, literal string")
    def parsed(lines: pd.Series) -> pd.DataFrame:
        found = [ignore_regex(x or "") or (None, None, None) for x in lines]
        return pd.DataFrame([(*x, *((x[0] and literal_of(x[0])) or (None, None))) for x in found], columns=["regex", "keep", "dirs_only", "anchored", "literal"], dtype=object)

    of = rules.select(F.regexp_replace("folder", "^/+|/+$", "").alias("folder"), "idx", parsed(F.col("line")).alias("r")).where("r.regex is not null")
    one = F.struct((-F.col("idx")).alias("nth"), "r.regex", "r.keep", "r.dirs_only")
    globs = of.where("r.literal is null").groupBy("folder").agg(F.sort_array(F.collect_list(one)).alias("lines"))
    whole = F.when(F.col("folder") == "", F.col("r.literal")).otherwise(F.concat("folder", F.lit("/"), "r.literal"))
    rank = F.struct((-F.length("folder")).alias("depth"), (-F.col("idx")).alias("nth"), "r.regex", "r.keep")
    named = of.where("r.literal is not null").groupBy(F.when(F.col("r.anchored"), whole).otherwise(F.col("folder")).alias("scope"), F.when(F.col("r.anchored"), "").otherwise(F.col("r.literal")).alias("name"))
    return globs, named.agg(F.min(F.when(~F.col("r.dirs_only"), rank)).alias("any"), F.min(rank).alias("dir"))


def _named(df: DataFrame, named: DataFrame) -> DataFrame:
    """Rows (path, is_dir, said) of those of df (path, is_dir) that a rule names: what the deepest, there the last, of these says."""
    path = F.col("path")
    scopes = F.concat(F.array(F.struct(F.lit("").alias("scope"), basename(path).alias("name"))), F.transform(ancestors(path), lambda a: F.struct(a.alias("scope"), basename(path).alias("name"))), F.array(F.struct(path.alias("scope"), F.lit("").alias("name"))))
    keys = df.select("path", "is_dir", F.explode(scopes).alias("k")).select("path", "is_dir", "k.scope", "k.name")
    met = keys.join(named, ["scope", "name"])
    return met.groupBy("path", "is_dir").agg(F.min(F.when(F.col("is_dir"), F.col("dir")).otherwise(F.col("any"))).alias("said"))


def _ignored(path: Column, is_dir: Column, chain: Column, said: Column) -> Column:
    """What the rules of the folders above say of a path: those of the deepest folder that has one for it, there the last.
    chain are those with wildcards, said is what the others come to."""

    def of_folder(c):
        rest = F.when(c["folder"] == "", path).otherwise(F.substring(path, F.length(c["folder"]) + F.lit(2), F.length(path)))
        fits = F.filter(c["lines"], lambda x: (is_dir | ~x["dirs_only"]) & F.call_function("rlike", rest, x["regex"]))
        first = F.get(fits, F.lit(0))
        return F.when(first.isNotNull(), F.struct(c["nth"].alias("depth"), first["nth"].alias("nth"), first["regex"].alias("regex"), first["keep"].alias("keep")))

    globbed = F.get(F.filter(F.transform(chain, of_folder), lambda k: k.isNotNull()), F.lit(0))
    return ~F.coalesce(F.least(globbed, said)["keep"], F.lit(True))


def apply_ignore(df: DataFrame, rules: DataFrame | list[tuple[str, str]]) -> DataFrame:
    """What a walk that honours ignore files sees of df: rules are rows (folder, idx, line), or a list (folder, line), of the
    lines of the files in each folder.

    Rules hold below their folder. Of the folders above a path the deepest with a matching line decides, and there its last
    matching one; `!` takes back in. A directory that is ignored is not entered, so that nothing below it comes back, whatever
    other lines say; `.git` is never entered. Without a column is_dir all rows are files.

    Directories, the rows' own and all above them, are decided first: each folder's rules with wildcards are one row, met by a
    join with the directories below. Rows then meet their parent directory once, with the rules that hold in it. A rule that
    names one text is met by a join on that, however many a folder has; only wildcards are tried one by one. So the number
    of rules adds rows to joins and nothing to the plan.
    """
    spark = df.sparkSession
    if isinstance(rules, list):
        rules = spark.createDataFrame([(f, i, x) for i, (f, x) in enumerate(rules)], "folder string, idx int, line string")
    of_folder, named = _ignore_rules(rules)
    is_dir = F.coalesce(F.col("is_dir"), F.lit(False)) if "is_dir" in df.columns else F.lit(False)
    above = ancestors(F.col("path"))
    found = df.select(F.explode(F.concat(F.array(F.lit("")), above, F.when(is_dir, F.array("path")).otherwise(F.array().cast("array<string>")))).alias("dir")).distinct()
    # the folders whose rules may speak of what lies in a directory, the deepest first
    scopes = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), ancestors(F.col("dir")), F.array("dir")))
    met = found.select("dir", F.explode(scopes).alias("folder")).join(of_folder, "folder", "left")
    held = F.collect_list(F.when(F.col("lines").isNotNull(), F.struct((-F.length("folder")).alias("nth"), "folder", "lines")))
    dirs = stored(met.groupBy("dir").agg(F.sort_array(held).alias("chain")))
    own = F.filter("chain", lambda c: c["folder"] != F.col("dir"))
    told = _named(dirs.where("dir <> ''").select(F.col("dir").alias("path"), F.lit(True).alias("is_dir")), named).select(F.col("path").alias("dir"), "said")
    shut = dirs.join(told, "dir", "left").where((F.col("dir") != "") & ((basename(F.col("dir")) == ".git") | _ignored(F.col("dir"), F.lit(True), own, F.col("said")))).select(F.col("dir").alias("shut"))
    below = dirs.select("dir", F.explode(F.concat(ancestors(F.col("dir")), F.array("dir"))).alias("shut")).join(shut, "shut", "left_semi").select("dir").distinct()
    open_dirs = dirs.join(below, "dir", "left_anti").select(F.col("dir").alias("__dir"), F.col("chain").alias("__chain"))
    told = _named(df.select("path", is_dir.alias("is_dir")), named).select(F.col("path").alias("__path"), F.col("is_dir").alias("__is_dir"), F.col("said").alias("__said"))
    j = df.join(open_dirs, parent(F.col("path")) == F.col("__dir")).join(told, (F.col("path") == F.col("__path")) & (is_dir == F.col("__is_dir")), "left")
    seen = ~_ignored(F.col("path"), is_dir, F.col("__chain"), F.col("__said")) & (basename(F.col("path")) != ".git")
    return j.where(seen).select(*df.columns)
