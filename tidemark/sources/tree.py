"""Directory trees as a data source: batch scans with empty directories and links, and a stream of changes between listings.

Paths are those of a file system that driver and executors mount alike. No process lists the tree alone: each of `parts`
tasks lists the upper `deal` levels and walks on only in those directories that a hash deals to it.
"""

from __future__ import annotations

import os
import shutil
import stat
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

ENTRY = "path string, size long, mtime timestamp, is_dir boolean, is_symlink boolean, symlink_target string, inode long, nlink long, blocks long, error string"
CHANGE = "path string, ts timestamp, kind string, is_dir boolean"
_ENTRY_TYPES = (pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
_ENTRY_NAMES = [c.split()[0] for c in ENTRY.split(", ")]
_CHANGE_TYPES = (pa.string(), pa.timestamp("us", tz="UTC"), pa.string(), pa.bool_())
_CHANGE_NAMES = [c.split()[0] for c in CHANGE.split(", ")]
#: Rows and bytes of contents in a batch.
ROWS, BYTES = 4096, 32 << 20


@dataclass
class Part(InputPartition):
    """One of `of` shares of a tree; of a stream, between two listings."""

    number: int
    of: int
    start: int = 0
    end: int = 0


def dealt_to(path: str, parts: int) -> int:
    return zlib.crc32(os.fsencode(path)) % parts


def _micros(ns: int) -> int:
    return ns // 1000


def walk(root: str, number: int = 0, parts: int = 1, deal: int = 2, follow: bool = False) -> Iterator[tuple]:
    """Rows of ENTRY below root, the root itself left out, that are dealt to this part.

    Entries of the upper `deal` levels are dealt by a hash of their path, and all others go with the last directory above
    that was. Links are rows of their own and not entered; with `follow` a link is what it leads to, and one that leads to a
    directory above it on the way there is a row with an error, as is one that leads nowhere. A directory that can't be read has
    an error in its row; what vanishes during the walk is left out. Memory follows the depth and one directory's names.
    """

    def identity(path):
        s = os.stat(path)
        return s.st_dev, s.st_ino

    def visit(folder: str, below: str, depth: int, mine: bool, above: tuple) -> Iterator[tuple]:
        with os.scandir(folder) as entries:
            names = sorted(e.name for e in entries)
        for name in names:
            full, path = os.path.join(folder, name), f"{below}{name}"
            own = dealt_to(path, parts) == number if depth < deal else mine
            try:
                s = os.lstat(full)
            except FileNotFoundError:
                continue
            link, error, target = stat.S_ISLNK(s.st_mode), None, None
            if link:
                try:
                    target = os.readlink(full)
                except OSError:
                    pass
            if link and follow:
                try:
                    s, link = os.stat(full), False
                except OSError as e:
                    error = e.strerror
            is_dir = stat.S_ISDIR(s.st_mode)
            inside = None
            if is_dir:
                key = (s.st_dev, s.st_ino)
                if follow and key in above:
                    error = "symlink loop"
                elif own or depth < deal - 1:
                    inside = visit(full, path + "/", depth + 1, own, (*above, key) if follow else above)
                    try:
                        first = next(inside, None)
                    except PermissionError as e:
                        inside, error = None, e.strerror
                    except (FileNotFoundError, NotADirectoryError):
                        continue
            if own:
                yield path, 0 if is_dir else s.st_size, _micros(s.st_mtime_ns), is_dir, link, target, s.st_ino, s.st_nlink, s.st_blocks, error
            if inside and first:
                yield first
                yield from inside

    yield from visit(root, "", 0, number == 0, (identity(root),) if follow else ())


def _batch(rows: list[tuple], types: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def local_path(path: str) -> str:
    """The path without `file:`; other schemes are refused, as only Spark's own readers know them."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    elif "://" in path:
        raise ValueError(f"{path}: a tree is read through a mounted file system")
    return path.rstrip("/") or "/"


class TreeReader(DataSourceReader):
    def __init__(self, root: str, parts: int, deal: int, follow: bool, content: bool):
        self.root, self.parts, self.deal, self.follow, self.content = root, parts, deal, follow, content

    def partitions(self):
        return [Part(i, self.parts) for i in range(self.parts)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        types, names = (*_ENTRY_TYPES, pa.binary()) if self.content else _ENTRY_TYPES, [*_ENTRY_NAMES, "content"] if self.content else _ENTRY_NAMES
        rows, size = [], 0
        for row in walk(self.root, part.number, part.of, self.deal, self.follow):
            if self.content:
                data = None
                if not row[3] and not row[4] and row[9] is None:
                    try:
                        with open(os.path.join(self.root, row[0]), "rb") as f:
                            data = f.read()
                    except OSError as e:
                        row = (*row[:9], e.strerror)
                row, size = (*row, data), size + len(data or b"")
            rows.append(row)
            if len(rows) >= ROWS or size >= BYTES:
                yield _batch(rows, types, names)
                rows, size = [], 0
        if rows:
            yield _batch(rows, types, names)


def changes(before: dict[str, tuple], after: dict[str, tuple], now: int) -> Iterator[tuple]:
    """Rows of CHANGE between two listings (path: size, mtime, is_dir, inode); what has gone has the time it was missed at.
    A directory counts as modified only if it is another one now: its time changes with every entry."""
    for path, (size, mtime, is_dir, inode) in after.items():
        old = before.get(path)
        if old is None:
            yield path, mtime, "create", is_dir
        elif (old[2], old[3]) != (is_dir, inode) or (not is_dir and old[:2] != (size, mtime)):
            yield path, mtime if not is_dir else now, "modify", is_dir
    for path, old in before.items():
        if path not in after:
            yield path, now, "remove", old[2]


class TreeStreamReader(DataSourceStreamReader):
    """Changes between listings. An offset is the time of a listing in milliseconds; each part keeps its listings in the
    state folder, one file an offset. A batch that is run again finds the listing of its end and gives the same rows."""

    def __init__(self, root: str, state: str, parts: int, deal: int, initial: bool):
        self.root, self.state, self.parts, self.deal, self.initial = root, state, parts, deal, initial
        self.last = 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self, *_) -> dict:
        self.last = max(self.last + 1, time.time_ns() // 1_000_000)
        return {"at": self.last}

    def partitions(self, start: dict, end: dict):
        return [Part(i, self.parts, start["at"], end["at"]) for i in range(self.parts)]

    def folder(self, at: int) -> str:
        return os.path.join(self.state, f"listing-{at}-of-{self.parts}")

    def listing(self, at: int, number: int) -> tuple[dict[str, tuple], int] | None:
        """A part's listing and its time in microseconds; None where there is none."""
        try:
            t = pq.read_table(os.path.join(self.folder(at), f"{number}.parquet"))
        except FileNotFoundError:
            return None
        return dict(zip(t["path"].to_pylist(), zip(*(t[c].to_pylist() for c in ("size", "mtime", "is_dir", "inode"))))), int(t.schema.metadata[b"now"])

    def list_now(self, at: int, number: int) -> None:
        """Write a part's listing once: what another attempt has written stays."""
        rows = [(r[0], r[1], r[2], r[3], r[6]) for r in walk(self.root, number, self.parts, self.deal)]
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
        t = pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "size", "mtime", "is_dir", "inode"])
        folder = self.folder(at)
        os.makedirs(folder, exist_ok=True)
        own = os.path.join(folder, f".{number}-{os.getpid()}-{time.time_ns()}")
        pq.write_table(t.replace_schema_metadata({"now": str(time.time_ns() // 1000)}), own, compression="zstd")
        try:
            os.link(own, os.path.join(folder, f"{number}.parquet"))
        except FileExistsError:
            pass
        os.unlink(own)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        before: dict[str, tuple] = {}
        if part.start:
            if (found := self.listing(part.start, part.number)) is None:
                raise ValueError(f"{self.folder(part.start)}: the listing that the stream goes on from is gone")
            before = found[0]
        if (after := self.listing(part.end, part.number)) is None:
            self.list_now(part.end, part.number)
            after = self.listing(part.end, part.number)
        rows = []
        for row in changes(before, *after) if part.start or self.initial else ():
            rows.append(row)
            if len(rows) >= ROWS:
                yield _batch(rows, _CHANGE_TYPES, _CHANGE_NAMES)
                rows = []
        if rows:
            yield _batch(rows, _CHANGE_TYPES, _CHANGE_NAMES)

    def commit(self, end: dict) -> None:
        """Listings before the committed one are needed no more."""
        for name in os.listdir(self.state) if os.path.isdir(self.state) else ():
            if name.startswith("listing-") and int(name.split("-")[1]) < end["at"]:
                shutil.rmtree(os.path.join(self.state, name), ignore_errors=True)


class TreeSource(DataSource):
    """Format `tidemark_tree`. Options: path; parts (tasks, 16); deal (levels that are dealt out, 2); follow (links, false); content
    (read files, false). As a stream also state (a folder of its own, shared by all executors) and initial (whether what is
    there at first is created in the first batch, true)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_tree"

    def _yes(self, option: str, default: str) -> bool:
        return str(self.options.get(option, default)).lower() == "true"

    def schema(self) -> str:
        if "state" in self.options:
            return CHANGE
        return f"{ENTRY}, content binary" if self._yes("content", "false") else ENTRY

    def _shares(self) -> tuple[int, int]:
        return max(1, int(self.options.get("parts", 16))), max(1, int(self.options.get("deal", 2)))

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(local_path(self.options["path"]), *self._shares(), self._yes("follow", "false"), self._yes("content", "false"))

    def streamReader(self, schema: StructType) -> TreeStreamReader:
        return TreeStreamReader(local_path(self.options["path"]), local_path(self.options["state"]), *self._shares(), self._yes("initial", "true"))
