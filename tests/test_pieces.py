"""Deltas and regions over pieces against the plain delta of whole contents."""

import hashlib
import random

import pytest

from tidemark.operators import blocks, pieces
from tidemark.plans.queries import QUERIES
from tidemark.sources import snapshots


def contents(seed):
    """(source, base) by path: edits, moves, runs of one byte, repeated blocks, rests, and what only one side has."""
    r = random.Random(seed)
    b = lambda n: r.randbytes(n)
    big = b(900)
    return {
        "same": (big, big),
        "insert": (big[:300] + b"!" + big[300:], big),
        "cut": (big[:123] + big[200:], big),
        "moved": (big[400:] + b(37) + big[:400], big),
        "zeros": (bytes(700), bytes(400)),
        "zeros_in": (b(50) + bytes(300) + b(70), bytes(64) + b(90)),
        "period": (b"ab" * 300 + b"c", b"ab" * 200),
        "repeat": (big[:64] * 6 + b(9), big[:64] * 2 + b(20)),
        "rest": (b(100) + big[-20:], big[:100] + big[-20:]),
        "short": (big[:9], big[:9]),
        "tail_only": (b(70) + b"xyz", b(32) + b"xyz"),
        "grown": (big + b(333), big),
        "other": (b(500), b(500)),
        "new": (b(200), None),
        "empty": (b"", big),
        "emptied": (b(65), b""),
        "unread": (None, big),
    }


def joined(ops):
    """Operations of one path in order, literals that touch as one."""
    out = []
    for op, off, size, data in ops:
        if op == "data" and out and out[-1][0] == "data" and out[-1][1] + out[-1][2] == off:
            out[-1] = ("data", out[-1][1], out[-1][2] + size, out[-1][3] + data)
        else:
            out.append((op, off, size, data))
    return out


@pytest.mark.parametrize(("seed", "width", "piece"), [(1, 32, 32), (2, 32, 96), (3, 16, 4096), (4, 33, 66)])
def test_delta_over_pieces(spark, seed, width, piece):
    of = contents(seed)
    kind = "path string, content binary"
    src = spark.createDataFrame([(p, s) for p, (s, _) in of.items() if s is not None], kind)
    base = spark.createDataFrame([(p, d) for p, (_, d) in of.items() if d is not None], kind)
    base_pieces = pieces.pieces(base, piece)
    ops = pieces.rolling_delta(pieces.pieces(src, piece, width - 1), base_pieces, width).cache()
    got = {}
    for r in sorted(ops.collect(), key=lambda r: (r.path, r.at)):
        got.setdefault(r.path, []).append((r.op, r.off, r.size, bytes(r.data) if r.data is not None else None))
        assert r.size <= max(piece, width)
    want = {p: list(blocks.delta(s, d or b"", width)) for p, (s, d) in of.items() if s}
    assert {p: joined(o) for p, o in got.items()} == want
    made = pieces.apply_delta(base_pieces, ops, piece).cache()
    rows = {}
    for r in sorted(made.collect(), key=lambda r: (r.path, r.off)):
        rows.setdefault(r.path, []).append(r)
        assert r.size == len(r.data) <= piece and r.off == r.no * piece
    assert {p: b"".join(bytes(x.data) for x in rs) for p, rs in rows.items()} == {p: s for p, (s, _) in of.items() if s}
    assert {(r.path, r.checksum, r.size) for r in pieces.digests(made).collect()} == {(p, hashlib.md5(s).hexdigest(), len(s)) for p, (s, _) in of.items() if s}
    ops.unpersist()
    made.unpersist()


def test_a_copy_without_a_base(spark):
    ops = spark.createDataFrame([("a", 0, "copy", 0, 10, None)], pieces.OPS)
    for base in (b"123456789", b""):
        of = pieces.pieces(spark.createDataFrame([("a", base)], "path string, content binary"), 16)
        with pytest.raises(Exception, match="copy without a base"):
            pieces.apply_delta(of, ops, 16).collect()


@pytest.mark.parametrize("piece", [8, 1000])
def test_regions(spark, piece):
    r = random.Random(5)
    regions, sizes, want = [], [], {}
    for p in range(12):
        n = r.choice([0, 1, 7, 64, 100])
        content, at = bytearray(n), 0
        while at < n and r.random() < 0.8:
            at += r.randrange(10)
            data = r.randbytes(min(r.randrange(1, 30), max(0, n - at)))
            if data:
                content[at : at + len(data)] = data
                regions.append((str(p), at, data))
            at += len(data)
        sizes.append((str(p), n))
        want[str(p)] = bytes(content)
    got = pieces.rebuild_sparse(spark.createDataFrame(regions, "path string, off long, data binary"), spark.createDataFrame(sizes, "path string, size long"), piece)
    made = {}
    for x in sorted(got.collect(), key=lambda x: (x.path, x.off)):
        made[x.path] = made.get(x.path, b"") + bytes(x.data)
    assert made == {p: c for p, c in want.items() if c}
    beyond = spark.createDataFrame([("0", 95, b"123456789")], "path string, off long, data binary")
    with pytest.raises(Exception, match="beyond"):
        pieces.rebuild_sparse(beyond, spark.createDataFrame([("0", 100)], "path string, size long"), piece).collect()


def test_a_large_file_is_many_tasks_work(spark, tmp_path):
    """Pieces of one file are read, matched and written by many tasks; what a task holds is a piece."""
    r = random.Random(6)
    base = r.randbytes(3 << 20)
    source = base[: 1 << 20] + b"in between" + base[1 << 20 :]
    (tmp_path / "base").mkdir()
    (tmp_path / "src").mkdir()
    (tmp_path / "base/f").write_bytes(base)
    (tmp_path / "src/f").write_bytes(source)
    read = lambda side, halo: pieces.read_pieces(snapshots.scan_tree(spark, str(tmp_path / side)).where("not is_dir"), str(tmp_path / side), 1 << 18, halo, tasks=6)
    src, old = read("src", 4095), read("base", 0)
    from pyspark.sql import functions as F

    assert src.select(F.spark_partition_id()).distinct().count() > 2
    ops = pieces.rolling_delta(src, old, 4096)
    # the block that was cut in two is literal, nothing else
    assert ops.where("op = 'data'").agg(F.sum("size")).first()[0] in (10, 4106)
    assert [tuple(x) for x in pieces.digests(pieces.apply_delta(old, ops, 1 << 18)).collect()] == [("f", hashlib.md5(source).hexdigest(), len(source))]


def test_a_run_by_strategy(spark):
    """Every strategy leaves the source's content; the results tell what was moved."""
    from pyspark.sql import functions as F

    from tidemark.operators import summaries, transfer

    r = random.Random(7)
    big = r.randbytes(20_000)
    of = {
        "new": (big[:9000], None, False), "small": (b"abc", b"xyz", False), "edit": (big[:7000] + b"!" + big[7000:], big, False), "other": (r.randbytes(20_000), big, False),
        "holes": (bytes(20_000) + b"x" + bytes(9000), bytes(10_000), True), "void": (bytes(10_000), r.randbytes(10_000), True), "none": (b"", big, False), "text": (b"words " * 400_000, None, False),
    }
    src = spark.createDataFrame([(p, s, x) for p, (s, _, x) in of.items()], "path string, content binary, is_sparse boolean")
    dst = spark.createDataFrame([(p, d) for p, (_, d, _) in of.items() if d is not None], "path string, content binary")
    plan = spark.createDataFrame([(p, "update" if d is not None else "create", False) for p, (_, d, _) in of.items()] + [("gone", "delete", False), ("dir", "create", True)], "path string, action string, is_dir boolean")
    made, results = transfer.transfer(src, dst, plan, piece=4096 * 2)
    got = {x.path: x for x in results.collect()}
    assert {p: x.strategy for p, x in got.items()} == {"new": "full", "small": "full", "edit": "delta", "other": "full", "holes": "sparse", "void": "sparse", "none": "full", "text": "full"}
    assert all(x.error is None and x.bytes_written == len(of[p][0]) for p, x in got.items())
    assert got["edit"].literal_bytes <= 513 and got["holes"].literal_bytes == 4096 and got["void"].literal_bytes == 0 and got["other"].literal_bytes == 20_000
    assert got["text"].transferred_bytes < 100_000 and got["new"].transferred_bytes == 9000
    parts = {}
    for x in sorted(made.collect(), key=lambda x: (x.path, x.off)):
        parts[x.path] = parts.get(x.path, b"") + bytes(x.data)
    assert parts == {p: s for p, (s, _, _) in of.items() if s}
    saved = summaries.savings(results).first()
    assert saved.delta_saved == sum(x.bytes_written - x.literal_bytes for x in got.values()) > 45_000 and saved.compression_saved > saved.delta_saved
    assert summaries.error_rows(results).isEmpty() and summaries.error_threshold(results.withColumn("error", F.lit("x")), 3).first()["abort"]


def test_matches_come_in_one_row_a_piece(spark, monkeypatch):
    """Also where the pieces of a source are more than share a row of the base's blocks."""
    monkeypatch.setattr(pieces, "GROUP", 2)
    of = contents(5)
    kind = "path string, content binary"
    src = pieces.pieces(spark.createDataFrame([(p, s) for p, (s, _) in of.items() if s is not None], kind), 96, 31)
    base = pieces.pieces(spark.createDataFrame([(p, d) for p, (_, d) in of.items() if d is not None], kind), 96)
    assert sorted(pieces.matches(src, base, 32).select("path", "no").collect()) == sorted(src.select("path", "no").collect())
    got = {}
    for r in sorted(pieces.rolling_delta(src, base, 32).collect(), key=lambda r: (r.path, r.at)):
        got.setdefault(r.path, []).append((r.op, r.off, r.size, bytes(r.data) if r.data is not None else None))
    assert {p: joined(o) for p, o in got.items()} == {p: list(blocks.delta(s, d or b"", 32)) for p, (s, d) in of.items() if s}


def test_operations_are_made_once(spark, sf_dir):
    """The round trip reads what the operations are from one stored table; they were made three times before."""
    plan = QUERIES["delta_roundtrip"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 3


def test_copies_that_follow_one_another_are_one(spark):
    rows = [("a", 0, "copy", 32, 32, None), ("a", 32, "copy", 64, 32, None), ("a", 64, "copy", 0, 32, None), ("a", 96, "data", 96, 1, b"x"), ("a", 97, "copy", 32, 32, None), ("b", 129, "copy", 64, 32, None)]
    got = pieces.joined_copies(spark.createDataFrame(rows, pieces.OPS).coalesce(1)).collect()
    assert sorted(map(tuple, got)) == [("a", 0, 32, 64), ("a", 64, 0, 32), ("a", 97, 32, 32), ("b", 129, 64, 32)]
    assert pieces.joined_copies(spark.createDataFrame(rows[3:4], pieces.OPS)).count() == 0


def test_groups_that_a_caller_knows(spark):
    kind = "path string, content binary"
    src = pieces.pieces(spark.createDataFrame([("a", b"x" * 40 + b"y" * 64), ("b", b"z" * 10)], kind), 64, 31)
    base = pieces.pieces(spark.createDataFrame([("a", b"y" * 64)], kind), 64)
    groups = spark.createDataFrame([("a", 0), ("b", 0)], "path string, group long")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(pieces.matches(src, base, 32, groups)) == rows(pieces.matches(src, base, 32))
