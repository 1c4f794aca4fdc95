"""Operators against plain versions of themselves, and what must hold for any input."""

import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions.paths import glob_to_regex
from tidemark.operators import blocks, compare, filters, merge, state, summaries
from tidemark.plans.fixtures import T0, Tables
from tidemark.sources import snapshots
from tidemark.streaming import watch


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return Tables(spark, sf_dir)


def included(spark, rules, path, is_dir=False):
    df = spark.createDataFrame([(path, is_dir)], "path string, is_dir boolean")
    return df.select(filters.included(filters.parse_rules(rules), F.col("path"), F.col("is_dir"))).first()[0]


@pytest.mark.parametrize("rules, path, is_dir, want", [
    ([], "a.txt", False, True),
    (["*.log"], "d/a.log", False, False),
    (["+ keep.log", "- *.log"], "d/keep.log", False, True),
    (["- *.log", "+ keep.log"], "d/keep.log", False, False),
    (["build/"], "x/build/y/z.o", False, False),
    (["build/"], "build", False, True),
    (["build/"], "build", True, False),
    (["- */"], "d", True, False),
    (["- */"], "d/f", False, True),
    (["a/b/"], "a/b/c", False, False),
    (["a/b/"], "x/a/b/c", False, True),
    (["# no", "", "-tmp*"], "tmp1", False, False),
    (["d/*.c"], "d/e/f.c", False, False),
    (["[!a]x"], "bx", False, False),
])
def test_rules(spark, rules, path, is_dir, want):
    assert included(spark, rules, path, is_dir) == want


def test_rule_errors():
    with pytest.raises(ValueError):
        filters.parse_rules(["+ "])
    assert glob_to_regex("**/a?[!x].c") == r"(?s)^(?:.*/)?a.[^x]\.c$"


def test_named_templates(spark, tmp_path):
    (tmp_path / "rust.rules").write_text("- target/\n")
    got = filters.load_rules(spark, templates=["rust", str(tmp_path / "rust.rules")], template_dir=str(tmp_path))
    assert [(r.include, r.pattern) for r in got] == [(False, "target/")] * 2


def test_ignored_directories(spark):
    df = spark.createDataFrame([("build", False), ("x/build", True), ("x/build/o", False), ("a/b", False), ("c/a/b", True), ("!odd", False)], "path string, is_dir boolean")
    left = lambda *rules: {r.path for r in filters.apply_ignore(df, [("", r) for r in rules]).collect()}
    assert left("build/") == {"build", "a/b", "c/a/b", "!odd"}
    assert left("build") == {"a/b", "c/a/b", "!odd"}
    assert left("c/a/b/", "a/b/") == {"build", "x/build", "x/build/o", "a/b", "!odd"}
    assert "!odd" in left("*", "!!odd") and left("*", "!!odd") == {"!odd"}


def test_rule_order(spark, tmp_path):
    (tmp_path / "inc").write_text("*.txt\n# note\n\n")
    (tmp_path / "ign").write_text("- *.o\n+ *.c\n")
    got = filters.load_rules(spark, filter=["- a"], include=["b"], exclude=["c"], include_from=[str(tmp_path / "inc")], ignore_file=str(tmp_path / "ign"))
    assert [(r.include, r.pattern) for r in got] == [(False, "a"), (True, "b"), (False, "c"), (True, "*.txt"), (False, "*.o"), (True, "*.c")]


def test_options():
    assert compare.pick_mode() == "mtime" and compare.pick_mode(checksum=True) == "checksum"
    with pytest.raises(ValueError):
        compare.pick_mode(True, True)
    assert compare.VERIFICATION["paranoid"] == ("cryptographic", True)
    assert merge.strategy_name("NEWER") == "newer"
    with pytest.raises(ValueError):
        merge.strategy_name("best")
    with pytest.raises(ValueError):
        filters.filter_size(None, 2, 1)


def test_a_plan_leads_to_no_plan(tables):
    src, dst = tables.src(), tables.dst()
    plan = compare.plan_oneway(src, dst).unionByName(compare.plan_deletes(src, dst))
    new = compare.apply_plan(src, dst, plan)
    after = compare.plan_oneway(src, new).unionByName(compare.plan_deletes(src, new))
    assert {r.action for r in after.select("action").distinct().collect()} == {"skip"}
    summed = lambda df: df.withColumn("checksum", F.md5("content"))
    exact = compare.apply_plan(src, dst, compare.plan_oneway(summed(src), summed(dst), "checksum").unionByName(compare.plan_deletes(src, dst)))
    assert compare.verify_summary(compare.verify(summed(src), summed(exact))).first()["exit_status"] == 0


@pytest.mark.parametrize("delete", [True, False])
def test_one_join_and_a_stored_plan_agree(tables, delete):
    src, dst = tables.src().select("path", "size", "mtime", "is_dir", "content"), tables.dst()
    plan = compare.plan_sync(src, dst, delete=delete)
    two = compare.plan_oneway(src, dst).unionByName(compare.plan_deletes(src, dst)) if delete else compare.plan_oneway(src, dst)
    assert sorted(plan.collect()) == sorted(two.select(*plan.columns).collect(), key=lambda r: r)
    one, other = compare.synchronise(src, dst, delete=delete), compare.apply_plan(src, dst, plan)
    assert one.count() == other.count() and one.exceptAll(other.select(*one.columns)).isEmpty()


def exchanges(df):
    """Shuffles and joins of the plan, without broadcasts and re-planning."""
    spark = df.sparkSession
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    text = df.select("*")._jdf.queryExecution().executedPlan().toString()
    for k, v in held.items():
        spark.conf.set(k, v)
    return len([x for x in text.splitlines() if " Exchange " in x]), text.count("Join ")


def test_plans_move_each_side_once(tables):
    src, dst = tables.src(), tables.dst()
    assert exchanges(compare.plan_sync(src, dst)) == exchanges(compare.synchronise(src, dst)) == (2, 1)
    assert exchanges(blocks.block_diff(src, dst, 512)) == exchanges(blocks.verify_blocks(src, dst, 512)) == exchanges(blocks.change_ratio(src, dst, 512, broadcast_paths=1)) == (2, 1)
    assert exchanges(blocks.change_ratio(src, dst, 512)) == (0, 1)
    assert blocks.change_ratio(src, dst, 512).exceptAll(blocks.change_ratio(src, dst, 512, broadcast_paths=1)).isEmpty()
    assert exchanges(state.flag_cache(tables.cache(), src)) == (2, 1)
    plan = src.select("path", F.lit("skip").alias("action"))
    assert exchanges(compare.apply_plan(src, dst, plan)) == (1, 0)


def test_unknown_sizes_are_there(spark):
    kind = "path string, size long, mtime timestamp, is_dir boolean"
    src = spark.createDataFrame([("a", None, None, False), ("b", None, None, False), ("c", 5, None, False)], kind)
    dst = spark.createDataFrame([("a", None, None, False), ("c", None, None, False), ("d", None, None, False)], kind)
    state = spark.createDataFrame([(p, s, None, None, None, None) for p in "abcd" for s in ("source", "dest")], "path string, side string, mtime timestamp, size long, checksum string, last_sync timestamp")
    assert {(r.path, r.change_type) for r in merge.classify(src, dst, state).collect()} == {("b", "DeletedFromDest"), ("c", "ModifiedInSource"), ("d", "DeletedFromSource")}
    assert {(r.path, r.change_type) for r in merge.classify(src, dst, state.limit(0)).collect()} == {("b", "NewInSource"), ("c", "CreateCreateConflict"), ("d", "NewInDest")}


def test_long_chains_of_links_are_no_loops(spark):
    rows = [(f"l{i}", f"l{i + 1}", True) for i in range(70)] + [("l70", None, False), ("x", "y", True), ("y", "z", True), ("z", "y", True), ("s", "s", True)]
    df = spark.createDataFrame(rows, "path string, symlink_target string, is_symlink boolean")
    assert {r.path for r in compare.symlink_loops(df).collect()} == {"x", "y", "z", "s"}
    assert compare.symlink_loops(df.limit(0)).count() == 0


def test_repeated_cache_rows(spark):
    df = spark.sql("select 'a' path, 1L size, timestamp'2024-01-01' mtime")
    cache = df.selectExpr("*", "'md5' checksum_type", "explode(array('y', 'x')) checksum")
    assert [(r.checksum, r.from_cache) for r in state.with_checksum(df, cache, "md5", F.lit("new")).collect()] == [("x", True)]


def test_upserts_are_repeatable(spark):
    kept = spark.createDataFrame([("a", "source", 1)], "path string, side string, size long")
    new = spark.createDataFrame([("a", "source", 2), ("a", "source", 3)], kept.schema)
    assert {tuple(r) for n in (1, 2, 3) for r in state.upsert(kept, new.repartition(n), ["path", "side"]).collect()} == {("a", "source", 3)}


@pytest.mark.parametrize("strategy", merge.STRATEGIES)
def test_a_second_merge_finds_nothing(tables, strategy):
    now = F.timestamp_micros(F.lit(T0))
    src, dst, kept = merge.bisync(tables.src(), tables.dst(), tables.state(), now, strategy, force=True, stamp=5)
    left = merge.classify(src, dst, kept)
    # both sides of a renamed conflict are new to the other side
    kinds = {r.change_type for r in left.select("change_type").distinct().collect()}
    assert kinds <= ({"NewInSource", "NewInDest"} if strategy in ("newer", "larger", "smaller", "rename") else set())
    assert left.where("path not like '%conflict-5%'").count() == 0


def test_merge_guard(tables):
    with pytest.raises(ValueError):
        merge.bisync(tables.src(), tables.dst(), tables.state(), F.timestamp_micros(F.lit(T0)), percent=1)


def test_state_of_pairs(spark):
    df = spark.range(1).select(state.pair_id("/a", "/b").alias("pair_id")).union(spark.range(1).select(state.pair_id("/b", "/a")))
    assert state.clear_state(df, "/a", "/b").count() == 1


def rebuilt(source, base, width):
    return b"".join(d if op == "data" else base[off : off + size] for op, off, size, d in blocks.delta(source, base, width))


def slow_delta(source, base, width):
    """From left to right, one byte at a time."""
    of = {}
    for off in range(0, len(base), width):
        of.setdefault(base[off : off + width], off)
    out, at, literal = [], 0, bytearray()
    while at < len(source):
        piece = source[at : at + width]
        if piece in of and (len(piece) == width or at + len(piece) == len(source)):
            if literal:
                out.append(("data", bytes(literal)))
                literal = bytearray()
            out.append(("copy", of[piece]))
            at += len(piece)
        else:
            literal.append(source[at])
            at += 1
    return out + ([("data", bytes(literal))] if literal else [])


def test_delta():
    r = random.Random(3)
    for _ in range(300):
        base = bytes(r.choice(b"ab") for _ in range(r.randrange(40)))
        source = bytearray(base)
        for _ in range(r.randrange(4)):
            at = r.randrange(len(source) + 1)
            source[at : at + r.randrange(3)] = bytes(r.choice(b"abc") for _ in range(r.randrange(4)))
        source, width = bytes(source), r.choice([1, 2, 4, 8])
        assert rebuilt(source, base, width) == source
        assert [(op, d if op == "data" else off) for op, off, size, d in blocks.delta(source, base, width)] == slow_delta(source, base, width)


def test_delta_in_pieces():
    r = random.Random(4)
    base = bytes(r.randrange(3) for _ in range(3000))
    source = base[100:900] + b"new" + base[1500:] + base[:77]
    whole = list(blocks.delta(source, base, 16))
    assert all(list(blocks.delta(source, base, 16, piece)) == whole for piece in (1, 7, 16, 100, 2000))


def test_stored_deltas(spark, tables, tmp_path):
    src, dst = tables.src().select("path", "content"), tables.dst().select("path", "content")
    ops = blocks.rolling_delta(src, dst)
    blocks.write_delta(ops, str(tmp_path / "d"))
    back = blocks.apply_delta(dst, blocks.read_delta(spark, str(tmp_path / "d"))).select("path", F.col("content").cast("string").alias("back"))
    assert src.join(back, "path").where("content = back").count() == src.where("content <> ''").count()
    with pytest.raises(Exception, match="copy without a base"):
        blocks.apply_delta(dst.limit(0), ops).count()


def test_delta_ratio(spark):
    ops = spark.createDataFrame([("a", "copy", 30), ("a", "data", 10), ("b", "copy", 0)], "path string, op string, size long")
    assert {r.path: (r.literal, r.copied, r.ratio, r.percent) for r in blocks.delta_ratio(ops).collect()} == {"a": (10, 30, 0.25, 25.0), "b": (0, 0, 1.0, None)}


def test_adler(tables):
    for r in tables.src().select("content", blocks.adler32(F.col("content").cast("binary")).alias("a")).limit(50).collect():
        assert r.a == zlib.adler32(r.content.encode())


def test_sparse_round_trip(tables):
    of = tables.base().select("path", F.concat(F.col("content"), F.lit("\0" * 2000), F.col("content")).cast("binary").alias("content"))
    table = blocks.block_table(of, 512)
    kept = table.join(blocks.zero_blocks(of, 512).where("not is_zero").select("path", "idx"), ["path", "idx"]).select("path", "off", "data")
    back = blocks.rebuild_sparse(kept, of.select("path", F.octet_length("content").alias("size"))).withColumnRenamed("content", "back")
    assert of.join(back, "path").where("content = back").count() == of.count()


def test_bloom(spark):
    inside, outside = spark.range(20000).select(F.col("id").cast("string").alias("k")), spark.range(50000, 70000).select(F.col("id").cast("string").alias("k"))
    bloom = blocks.bloom_build(inside, "k", 20000)
    assert blocks.bloom_filter(inside, "k", bloom, 20000).where("not maybe").count() == 0
    assert blocks.bloom_filter(outside, "k", bloom, 20000).where("maybe").count() < 400


def test_compressibility(spark):
    df = spark.createDataFrame([(bytearray(10000),), (bytearray(random.Random(1).randbytes(10000)),), (bytearray(),), (None,)], "c binary")
    a, b, c, d = (r[0] for r in df.select(blocks.compressibility(F.col("c"))).collect())
    assert a < 0.02 and 1 <= b < 1.02 and c == d == 1.0


def test_events_and_guards(tables, tmp_path):
    plan = compare.plan_oneway(tables.src(), tables.dst()).unionByName(compare.plan_deletes(tables.src(), tables.dst()))
    summaries.events_json(plan).write.text(str(tmp_path / "log"))
    events = [json.loads(line) for f in (tmp_path / "log").glob("part-*") for line in f.read_text().splitlines()]
    assert len(events) == plan.count() + 1 and {e["type"] for e in events} == {"create", "update", "skip", "delete", "summary"}
    results = plan.select("path", F.when(F.col("action") == "delete", "gone").alias("error"), "action")
    checked = compare.verify(*(df.withColumn("checksum", F.md5("content")) for df in (tables.src(), tables.dst())))
    log = summaries.perf_metrics(plan.select(*[F.lit(1).alias(c) for c in ("files", "bytes", "transfer_seconds", "total_seconds")]))
    kinds = [json.loads(r.value) for r in summaries.events_json(plan, results, "/a", "/b", checked, log).collect()]
    of = lambda kind: [e for e in kinds if e["type"] == kind]
    assert of("start")[0]["total_files"] == plan.count() and len(of("performance")) == 1
    assert len(of("error")) == plan.where("action = 'delete'").count() == summaries.error_rows(results).count()
    assert len(of("verification_result")) == 1 + checked.where("status <> 'matched'").count()
    with pytest.raises(ValueError):
        summaries.check_errors(results, 1)
    summaries.check_errors(results, 0)
    with pytest.raises(ValueError):
        summaries.check_deletions(plan, tables.dst(), 1)
    summaries.check_deletions(plan, tables.dst(), 1, force=True)
    with pytest.raises(ValueError):
        summaries.check_deletions(plan, tables.dst(), 90, confirm=3)


def test_counts_come_with_the_plan(spark, tables):
    """The guard and the summary are those of jobs of their own, and take none."""
    plan = compare.plan_sync(tables.src(), tables.dst())
    want = summaries.summarize(plan).first().asDict()
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("guard", "guard")
    kept, found = summaries.guarded_plan(plan, 90)
    ran = len(jobs.getJobIdsForGroup("guard"))
    spark.sparkContext.setJobGroup("plain", "plain")
    compare.stored(plan)
    assert ran <= len(jobs.getJobIdsForGroup("plain"))
    assert {k: found[k] for k in want} == want and found["dest_rows"] == tables.dst().count()
    assert kept.exceptAll(plan).isEmpty() and kept.count() == plan.count()
    for bad in ({"percent": 1}, {"percent": 90, "confirm": 3}, {"percent": 90, "available": 10}):
        with pytest.raises(ValueError):
            summaries.guarded_plan(plan, **bad)
    summaries.guarded_plan(plan, 1, force=True)
    summaries.guarded_plan(plan, 90, confirm=3, confirmed=True)


@pytest.mark.parametrize("codec", ["none", "lz4", "zstd"])
def test_write_and_scan(spark, tables, tmp_path, codec):
    snapshots.write_snapshot(tables.src(), str(tmp_path / "s"), codec)
    assert spark.read.parquet(str(tmp_path / "s")).count() == tables.src().count()
    (tmp_path / "t/d").mkdir(parents=True)
    (tmp_path / "t/d/x.bin").write_bytes(b"12345")
    (tmp_path / "t/d/e").mkdir()
    (tmp_path / "t/d/e/y").write_bytes(b"1")
    links = spark.createDataFrame([("d/e/y", "../x.bin")], "path string, target string")
    found = snapshots.scan_tree(spark, str(tmp_path / "t"), links=links).drop("inode", "nlink", "blocks", "error")
    assert sorted((r.path, r.size, r.is_dir, r.symlink_target) for r in found.collect()) == [("d", 0, True, None), ("d/e", 0, True, None), ("d/e/y", 1, False, "../x.bin"), ("d/x.bin", 5, False, None)]
    rows = snapshots.scan_tree(spark, str(tmp_path / "t"), content=True, dirs=False)
    assert sorted((r.path, bytes(r.content)) for r in rows.collect()) == [("d/e/y", b"1"), ("d/x.bin", b"12345")]
    plan = compare.symlink_plan(found, "preserve").where("kind = 'link'").collect()
    assert [(r.path, r.source) for r in plan] == [("d/e/y", "../x.bin")]
    kept = filters.prune_excluded_dirs(found, filters.parse_rules(["- e/"]))
    assert {r.path for r in kept.collect()} == {"d", "d/x.bin"}


def test_token_bucket(spark):
    r = random.Random(9)
    rows = [(k, i, float(i) * r.random(), float(r.randrange(300))) for k in "ab" for i in range(60)]
    got = {(x.key, x.seq): x.delay for x in watch.token_bucket(spark.createDataFrame(rows, "key string, seq long, seconds double, bytes double"), 100.0).collect()}
    for key in "ab":
        level = clock = None
        for _, i, at, size in sorted((x for x in rows if x[0] == key), key=lambda x: (x[2], x[1])):
            level, clock = (100.0, at) if level is None else (min(100.0, level + (at - clock) * 100), at)
            want = 0.0 if level >= size else (size - level) / 100
            level = level - size if level >= size else 0.0
            assert got[key, i] == pytest.approx(want)


def test_streams(spark, tables, tmp_path):
    events, inbox = tables.changes(), str(tmp_path / "in")
    events.repartition(3).write.parquet(inbox)
    stream = snapshots.change_stream(spark, inbox, events.schema.simpleString()[7:-1].replace(":", " "), max_files=1)
    seen = []
    full = []
    for _ in range(2):  # the second run finds nothing new
        watch.watch(stream, lambda df, n: seen.append((n, df.count())), str(tmp_path / "c"), None, lambda: full.append(len(seen))).awaitTermination(120)
    assert full == [0, 3]
    by_bytes = snapshots.change_stream(spark, inbox, events.schema.simpleString()[7:-1].replace(":", " "), max_bytes=1)
    watch.watch(by_bytes, lambda df, n: full.append(n), str(tmp_path / "b"), None).awaitTermination(120)
    assert len(full) == 5
    with pytest.raises(ValueError):
        snapshots.change_stream(spark, inbox, "path string", 1, 1)
    assert sum(n for _, n in seen) == snapshots.changes_only(events).count() and len({b for b, _ in seen}) == len(seen) == 3
    sessions = watch.coalesce_events(stream, "1 hour", "1 hour")
    q = sessions.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
    q.awaitTermination(120)
    assert spark.sql("select * from sessions").count() > 0


def test_token_bucket_stream(spark, tmp_path):
    schema = "key string, seq long, seconds double, bytes double"
    rows = [(k, i, float(i), 70.0 + i) for k in "abc" for i in range(30)]
    for lo in (0, 10, 20):  # three files, one to a batch, in this order
        spark.createDataFrame([r for r in rows if lo <= r[1] < lo + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = watch.token_bucket_stream(stream, 100.0).writeStream.format("memory").queryName("delays").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {(r.key, r.seq): r.delay for r in spark.sql("select * from delays").collect()}
    want = {(r.key, r.seq): r.delay for r in watch.token_bucket(spark.createDataFrame(rows, schema), 100.0).collect()}
    assert got == pytest.approx(want)
