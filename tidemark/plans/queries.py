"""The queries over derived snapshots, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import blocks, compare, filters, merge, pieces, state, summaries, transfer
from ..operators.tables import stored
from ..sources import snapshots
from ..streaming import watch
from .fixtures import CTES, T0, Tables, rules

QUERIES = {}
SQL = {}
def now():
    return F.timestamp_micros(F.lit(T0 + 10**12))


def query(sql: str | None = None):
    """Register a function of Tables under its name, with SQL over the given tables and CTES."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {CTES}, {sql.strip()[4:].strip()}" if sql.strip().startswith("AND ") else f"WITH RECURSIVE {CTES} {sql}"
        return f

    return add


def micros(*names: str) -> list:
    """Timestamps as microseconds, so that no time zone comes in."""
    return [F.unix_micros(n).alias(n) for n in names]


def tree(t: Tables) -> DataFrame:
    return t.src().select("path", "size", "is_dir").unionByName(t.dirs().select("path", "size", "is_dir"))


# --- sources


@query("SELECT 'bucket/a/' || path AS key, path FROM src")
def object_keys(t):
    of = t.src().select(F.concat(F.lit("/"), "path").alias("path"))
    keys = of.select(paths.path_to_key(F.col("path"), "bucket/a/").alias("key"))
    return keys.select("key", paths.key_to_path(F.col("key"), "bucket/a").alias("path"))


@query("SELECT substr(path, 6) AS path, size, is_dir FROM src WHERE path LIKE 'src0/%'")
def object_inventory(t):
    keys = t.src().select(F.col("path").alias("key"), "size", "mtime")
    return snapshots.scan_objects(keys, "src0/").select("path", "size", "is_dir")


@query("SELECT path, strlen(content) AS size, mt AS mtime FROM base")
def snapshot_documents(t):
    return snapshots.as_snapshot(t.base(), F.col("path"), F.timestamp_micros("mt"), F.col("content")).select("path", "size", *micros("mtime"))


@query("SELECT path, size, (k % 9) * 512 AS allocated_size, size > 4096 AND (k % 9) * 512 < greatest(size - 4096, 0) AS is_sparse FROM src")
def sparse_flag(t):
    return snapshots.with_sparse_flag(t.src().withColumn("blocks", F.col("k") % 9)).select("path", "size", "allocated_size", "is_sparse")


@query("SELECT path, mt AS ts, kind FROM chg WHERE kind IN ('create', 'modify', 'remove')")
def change_events(t):
    return snapshots.changes_only(t.changes()).select("path", *micros("ts"), "kind")


# --- filters and projections

# The rule list as SQL: its regular expressions are written out by hand.
_DECIDED = """CASE
  WHEN (is_dir AND regexp_matches(path, '(^|/)src1$')) OR regexp_matches(path, '(^|/)src1/') THEN 0
  WHEN regexp_matches(path, '(^|/)[^/]*7[.]txt$') THEN 1
  WHEN path LIKE '%/de/%' THEN 2
  WHEN regexp_matches(path, '^src2./') THEN 3
  WHEN regexp_matches(path, '[.]txt$') THEN 4
  ELSE 5 END"""


@query(f"SELECT path FROM tree WHERE ({_DECIDED}) IN (1, 4)")
def filter_rules(t):
    return filters.apply_filter(tree(t), rules()).select("path")


@query("SELECT path, regexp_matches(path, '^src[0-4]/.*$') AS whole, regexp_matches(path, '(^|/)[^/]*[0-4][.]txt$') AS base, regexp_matches(path, '^src./.*[.]txt$') AS short, NOT regexp_matches(path, '[0-4][.]txt$') AS other FROM src")
def filter_glob(t):
    path, file = F.col("path"), F.lit(False)
    hit = lambda p: filters.Rule(True, p).matches(path, file)
    return t.src().select("path", hit("src[0-4]/*").alias("whole"), hit("*[0-4].txt").alias("base"), hit("src?/*.txt").alias("short"), hit("*[!0-4].txt").alias("other"))


@query("SELECT path, is_dir AS any_dir, (is_dir AND regexp_matches(path, '(^|/)de$')) OR regexp_matches(path, '(^|/)de/') AS de, path = 'src3/en' OR path LIKE 'src3/en/%' AS src3_en FROM tree")
def filter_dir_rules(t):
    hit = lambda p: filters.Rule(True, p).matches(F.col("path"), F.col("is_dir"))
    return tree(t).select("path", hit("*/").alias("any_dir"), hit("de/").alias("de"), hit("src3/en/").alias("src3_en"))


@query("SELECT path FROM tree WHERE NOT (path = 'src1/de' OR path LIKE 'src1/de/%') AND NOT regexp_matches(path, '3[.]txt$')")
def filter_cascade(t):
    return filters.prune_excluded_dirs(tree(t), filters.parse_rules(["- src1/de", "- *3.txt"])).select("path")


@query("SELECT path FROM src WHERE NOT regexp_matches(path, '(^|/)fr/') AND (path NOT LIKE '%7.txt' OR path LIKE 'src2/%')")
def filter_ignore(t):
    return filters.apply_ignore(t.src(), [("", "fr/"), ("", "*7.txt"), ("src2", "!*7.txt")]).select("path")


# one file at the top, one in each folder of a source, one in each folder of a language, whose lines come from the table
@query("""AND said AS (SELECT t.path, max_by(r.keep, r.at) AS keep FROM tree t JOIN (
    SELECT '' AS folder, 'de' AS name, true AS dirs, false AS keep, 0 AS at UNION ALL SELECT 'src1', 'de', true, true, 100 UNION ALL SELECT 'src1', 'en', true, false, 101
    UNION ALL SELECT source || '/' || lang, doc_id || '.txt', false, doc_id % 3 = 0, 1000000 + doc_id FROM documents WHERE doc_id % 5 = 0) r
    ON (r.folder = '' OR t.path LIKE r.folder || '/%') AND regexp_replace(t.path, '^.*/', '') = r.name AND (t.is_dir OR NOT r.dirs) GROUP BY t.path),
  shut AS (SELECT path FROM said WHERE NOT keep)
SELECT path FROM tree t WHERE path NOT IN (SELECT path FROM shut) AND NOT EXISTS (SELECT 1 FROM shut s WHERE t.path LIKE s.path || '/%')""")
def filter_ignore_files(t):
    k = F.col("doc_id")
    fixed = t.spark.createDataFrame([("", 0, "de/"), ("src1", 0, "!de/"), ("src1", 1, "en/")], "folder string, idx long, line string")
    own = t.documents.where(k % 5 == 0).select(F.concat("source", F.lit("/"), "lang").alias("folder"), k.alias("idx"), F.concat(F.when(k % 3 == 0, "!").otherwise(""), k.cast("string"), F.lit(".txt")).alias("line"))
    return filters.apply_ignore(tree(t), fixed.unionByName(own)).select("path")


@query("SELECT path, size FROM tree WHERE is_dir OR size BETWEEN 500 AND 2000")
def filter_size(t):
    return filters.filter_size(tree(t), 500, 2000).select("path", "size")


@query(f"SELECT {_DECIDED} AS rule, count(*) AS hits FROM tree GROUP BY 1")
def rule_hits(t):
    return filters.rule_hits(tree(t), rules())


@query("SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent, k || '.txt' AS name, k::VARCHAR AS stem, 'txt' AS extension FROM src")
def path_parts(t):
    return t.src().select("path", paths.path_parts(F.col("path")).alias("p")).select("path", "p.*")


@query("SELECT path, CASE WHEN k % 2 = 0 THEN 'user::rw-' END AS acls, NULL::VARCHAR AS flags FROM src")
def attr_policy(t):
    of = t.src().select("path", F.when(F.col("k") % 2 == 0, "user::rw-").alias("acls"), F.lit("nodump").alias("flags"))
    return summaries.keep_attributes(of, {"acls"})


@query("SELECT path, 'copy' AS kind, path AS source FROM syms WHERE NOT is_symlink UNION ALL SELECT a.path, 'copy', a.symlink_target FROM syms a JOIN syms b ON a.symlink_target = b.path WHERE a.is_symlink AND NOT b.is_dir")
def symlink_plan(t):
    return compare.symlink_plan(t.syms(), "follow")


@query("AND hops(path, cur, n) AS (SELECT path, symlink_target, 1 FROM syms WHERE is_symlink UNION ALL SELECT h.path, s.symlink_target, n + 1 FROM hops h JOIN syms s ON h.cur = s.path WHERE s.is_symlink AND n < 64) SELECT DISTINCT path FROM hops WHERE n = 64")
def symlink_loops(t):
    return compare.symlink_loops(t.syms())


# links between folders: a link leads on to the links in the folder that it leads to
@query("""AND go(path, to_path) AS (SELECT a.path, b.path FROM dirlinks a JOIN dirlinks b ON b.path LIKE a.symlink_target || '/%'),
  reach(path, to_path) AS (SELECT path, to_path FROM go UNION SELECT r.path, g.to_path FROM reach r JOIN go g ON r.to_path = g.path)
SELECT DISTINCT path FROM reach WHERE to_path IN (SELECT path FROM reach WHERE path = to_path)""")
def symlink_folder_loops(t):
    return compare.symlink_loops(t.dirlinks())


@query("SELECT path, kind, name, permissions FROM (SELECT path, 'user' AS kind, '' AS name, 'rw-' AS permissions FROM src UNION ALL SELECT path, 'group', 'g' || k % 3, 'r--' FROM src WHERE k % 2 = 0)")
def acl_rows(t):
    k = F.col("k")
    acls = F.concat(F.lit("user::rw-\n"), F.when(k % 2 == 0, F.concat(F.lit("group:g"), (k % 3).cast("string"), F.lit(":r--\n"))).otherwise(""))
    return summaries.explode_acls(t.src().select("path", acls.alias("acls")))


@query("SELECT path, base64(encode(content)) AS encoded, true AS same FROM src")
def xattr_codec(t):
    of = t.src().select("path", F.create_map(F.lit("user.head"), F.col("content").cast("binary")).alias("x")).withColumn("e", summaries.encode_xattrs(F.col("x")))
    return of.select("path", F.col("e")["user.head"].alias("encoded"), (summaries.decode_xattrs(F.col("e"))["user.head"] == F.col("x")["user.head"]).alias("same"))


# --- one-way plans

_PLAN = ("path", "action", "src_size", "dst_size")


@query("SELECT path, action, src_size, dst_size, src_mt AS src_mtime, dst_mt AS dst_mtime FROM oneway")
def plan_oneway(t):
    return compare.plan_oneway(t.src(), t.dst()).select(*_PLAN, *micros("src_mtime", "dst_mtime"))


@query("SELECT s.path, CASE WHEN d.path IS NULL THEN 'create' WHEN s.size <> d.size OR abs(s.mt - d.mt) // 1000000 > 1 THEN 'update' ELSE 'skip' END AS action, s.size AS src_size, d.size AS dst_size FROM ord_src s LEFT JOIN ord_dst d USING (path)")
def plan_mtime(t):
    return compare.plan_oneway(t.ord_src(), t.ord_dst()).select(*_PLAN)


@query("SELECT path, CASE WHEN dst_size IS NULL THEN 'create' WHEN src_size <> dst_size THEN 'update' ELSE 'skip' END AS action, src_size, dst_size FROM oneway")
def plan_size_only(t):
    return compare.plan_oneway(t.src(), t.dst(), "size").select(*_PLAN)


@query("SELECT path, CASE WHEN dst_size IS NULL THEN 'create' ELSE 'update' END AS action, src_size, dst_size FROM oneway")
def plan_ignore_times(t):
    return compare.plan_oneway(t.src(), t.dst(), "ignore_times").select(*_PLAN)


def summed(df: DataFrame) -> DataFrame:
    return df.withColumn("checksum", blocks.checksum(F.col("content"), "md5"))


@query("SELECT s.path, CASE WHEN d.path IS NULL THEN 'create' WHEN md5(s.content) <> md5(d.content) THEN 'update' ELSE 'skip' END AS action, s.size AS src_size, d.size AS dst_size FROM src s LEFT JOIN dst d USING (path)")
def plan_checksum(t):
    return compare.plan_oneway(summed(t.src()), summed(t.dst()), "checksum").select(*_PLAN)


@query("SELECT path, dst_size FROM deletes")
def plan_deletes(t):
    return compare.plan_deletes(t.src(), t.dst()).select("path", "dst_size")


def full_plan(t: Tables) -> DataFrame:
    return compare.plan_sync(t.src(), t.dst())


@query("SELECT path, size, md5(content) AS checksum FROM src JOIN oneway USING (path) WHERE action IN ('create', 'update') UNION ALL SELECT path, size, md5(content) FROM dst JOIN oneway USING (path) WHERE action = 'skip'")
def apply_oneway(t):
    return compare.synchronise(summed(t.src()).drop("content"), summed(t.dst()).drop("content")).select("path", "size", "checksum")


@query("SELECT coalesce(sum(CASE WHEN action = 'create' THEN src_size END), 0)::BIGINT AS bytes_would_add, coalesce(sum(CASE WHEN action = 'update' THEN src_size END), 0)::BIGINT AS bytes_would_change, coalesce(sum(CASE WHEN action = 'delete' THEN dst_size END), 0)::BIGINT AS bytes_would_delete FROM plan")
def dry_run_summary(t):
    return summaries.dry_run(full_plan(t))


@query("SELECT action AS type, path, src_size AS size FROM plan UNION ALL SELECT 'summary', NULL, sum(CASE WHEN action IN ('create', 'update') THEN src_size END)::BIGINT FROM plan")
def event_log_json(t):
    kind = "type string, path string, size bigint, bytes_to_transfer bigint"
    return summaries.events_json(full_plan(t)).select(F.from_json("value", kind).alias("e")).select("e.type", "e.path", F.coalesce("e.size", "e.bytes_to_transfer").alias("size"))


_BYTES = "CASE WHEN {0} >= 1048576 THEN printf('%.2f MB', {0} / 1048576.0) WHEN {0} >= 1024 THEN printf('%.2f KB', {0} / 1024.0) ELSE {0} || ' B' END"


@query(f"SELECT path, CASE action WHEN 'create' THEN 'Would create: ' || path || ' (' || {_BYTES.format('src_size')} || ')' WHEN 'update' THEN 'Would update: ' || path || ' (' || {_BYTES.format('src_size')} || ')' ELSE 'Would delete: ' || path END AS text FROM plan WHERE action <> 'skip'")
def plan_text(t):
    return summaries.plan_text(full_plan(t))


@query("AND v AS (SELECT coalesce(s.path, d.path) AS path, CASE WHEN d.path IS NULL THEN 'only_source' WHEN s.path IS NULL THEN 'only_dest' WHEN md5(s.content) = md5(d.content) THEN 'matched' ELSE 'mismatched' END AS status FROM src s FULL JOIN dst d ON s.path = d.path) SELECT * FROM v")
def verify_detail(t):
    return compare.verify(summed(t.src()), summed(t.dst()))


@query("AND v AS (SELECT CASE WHEN d.path IS NULL THEN 'only_source' WHEN s.path IS NULL THEN 'only_dest' WHEN md5(s.content) = md5(d.content) THEN 'matched' ELSE 'mismatched' END AS status FROM src s FULL JOIN dst d ON s.path = d.path) SELECT count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'mismatched') AS mismatched, count(*) FILTER (status = 'only_source') AS only_source, count(*) FILTER (status = 'only_dest') AS only_dest, 1::INTEGER AS exit_status FROM v")
def verify_summary(t):
    return compare.verify_summary(compare.verify(summed(t.src()), summed(t.dst())))


@query("SELECT count(*) AS verified, 0::BIGINT AS failures FROM oneway WHERE action IN ('create', 'update')")
def verify_apply(t):
    src, dst = summed(t.src()).drop("content"), summed(t.dst()).drop("content")
    return compare.verify_apply(src, compare.synchronise(src, dst), compare.plan_sync(src, dst))


@query("SELECT path, action FROM plan WHERE path NOT IN (SELECT path FROM src WHERE k % 6 = 0)")
def resume_anti(t):
    done = t.src().where("k % 6 = 0").select("path")
    return compare.resume_plan(full_plan(t), done, {"delete": True}, {"delete": True}).select("path", "action")


@query("AND f AS (SELECT inode, min(path) AS first FROM links WHERE nlink > 1 GROUP BY inode) SELECT path, inode, CASE WHEN nlink > 1 AND path <> first THEN 'link' ELSE 'copy' END AS kind, CASE WHEN nlink > 1 AND path <> first THEN first END AS link_to, CASE WHEN nlink > 1 AND path <> first THEN 0 ELSE size END AS bytes FROM links LEFT JOIN f USING (inode)")
def hardlink_plan(t):
    return compare.hardlink_plan(t.links())


_PARENT = "regexp_replace(path, '/[^/]*$', '')"


@query(f"AND d AS (SELECT DISTINCT {_PARENT} AS dir FROM src), hit AS (SELECT dir FROM d WHERE dir NOT LIKE 'src1%') SELECT path, size, mt AS mtime, {_PARENT} AS dir FROM dst WHERE {_PARENT} IN (SELECT dir FROM hit) UNION ALL SELECT path, size, mt, {_PARENT} FROM src WHERE {_PARENT} NOT IN (SELECT dir FROM hit)")
def incremental_scan(t):
    placed = lambda df: df.withColumn("dir", paths.parent(F.col("path"))).select("path", "size", "mtime", "dir")
    fresh = placed(t.src())
    dirs = fresh.select("dir").distinct().withColumn("mtime", F.timestamp_micros(F.lit(T0)))
    late = F.when(F.col("dir").startswith("src1"), 5_000_000).otherwise(900_000)
    cached = dirs.select("dir", F.timestamp_micros(F.lit(T0) + late).alias("mtime"))
    return compare.incremental_scan(fresh, dirs, cached, placed(t.dst())).select("path", "size", *micros("mtime"), "dir")


# --- state and caches


@query("AND new AS (SELECT path, 'source' AS side, mt, size + 1 AS size FROM src WHERE k % 4 = 0) SELECT path, side, mt AS mtime, size FROM (SELECT path, side, mt, size FROM state WHERE (path, side) NOT IN (SELECT path, side FROM new) UNION ALL SELECT * FROM new) WHERE path NOT IN (SELECT path FROM base WHERE k % 10 = 1)")
def state_upsert(t):
    new = t.src().where("k % 4 = 0").select("path", F.lit("source").alias("side"), "mtime", (F.col("size") + 1).alias("size"), F.lit(None).cast("string").alias("checksum"), now().alias("last_sync"))
    return state.upsert(t.state(), new, ["path", "side"], t.base().where("k % 10 = 1")).select("path", "side", *micros("mtime"), "size")


@query("SELECT path, side, mt AS mtime, size FROM state")
def state_by_side(t):
    return t.state().orderBy("path", "side").select("path", "side", *micros("mtime"), "size")


@query("SELECT path, ps_size, ps_mt AS ps_mtime, pd_size, pd_mt AS pd_mtime FROM prior")
def state_pivot(t):
    return state.pivot_state(t.state()).select("path", "ps_size", *micros("ps_mtime"), "pd_size", *micros("pd_mtime"))


@query("SELECT s.path, md5(s.content) AS checksum, c.path IS NOT NULL AS from_cache FROM src s LEFT JOIN cache c ON c.path = s.path AND c.size = s.size AND c.mt = s.mt AND c.checksum_type = 'md5'")
def checksum_cache_lookup(t):
    return state.with_checksum(t.src(), t.cache(), "md5", F.md5("content")).select("path", "checksum", "from_cache")


@query("SELECT path, path IN (SELECT path FROM src) AS kept FROM cache")
def cache_prune(t):
    return state.flag_cache(t.cache(), t.src()).select("path", F.col("exists").alias("kept"))


@query("SELECT count(*) AS total, count(*) FILTER (checksum_type = 'md5') AS fast, count(*) FILTER (checksum_type <> 'md5') AS cryptographic FROM cache")
def cache_stats(t):
    return state.cache_stats(t.cache())


@query("AND r AS (SELECT o_orderkey AS k, 1 + (o_orderkey % 11 = 3)::INT AS version, CASE WHEN o_orderkey % 7 = 2 THEN 'rel' ELSE '/s' END AS source, o_orderkey % 100 AS completed, 50 AS total, CASE WHEN o_orderkey % 13 = 5 THEN 'skip' ELSE 'update' END AS action FROM orders) SELECT k, CASE WHEN version <> 1 THEN 'version' WHEN source <> '/s' THEN 'source' WHEN completed > total THEN 'count' WHEN action = 'skip' THEN 'action' END AS problem FROM r")
def resume_validate(t):
    k = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("timestamp")
    runs = t.orders.select(
        k.alias("k"), F.when(k % 11 == 3, 2).otherwise(1).alias("version"), F.when(k % 7 == 2, "rel").otherwise("/s").alias("source"), F.lit("/d").alias("destination"),
        start.alias("started"), start.alias("checkpoint"), (k % 100).alias("completed"), F.lit(50).alias("total"), F.when(k % 13 == 5, "skip").otherwise("update").alias("action"),
    )
    return state.resume_problems(runs, F.timestamp_micros(F.lit(T0 * 2))).select("k", "problem")


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 4 NOT IN (0, 1) THEN (c_custkey % 4)::INT WHEN c_custkey % 3 = 0 THEN 5 ELSE 1 END AS parallel, coalesce(c_custkey % 5 = 0, false) AS resume FROM customer")
def profile_merge(t):
    k = F.col("c_custkey")
    runs = t.customer.select(k.alias("k"), F.when(k % 4 != 0, k % 4).cast("int").alias("arg_parallel"), F.when(k % 3 == 0, 5).alias("profile_parallel"), F.lit(True).alias("arg_resume"), (k % 5 == 0).alias("profile_resume"))
    return state.merge_profile(runs, {"parallel": 1, "resume": False})


# --- summaries


@query("SELECT count(*) FILTER (action = 'create') AS created, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'delete') AS deleted, coalesce(sum(CASE WHEN action IN ('create', 'update') THEN src_size END), 0)::BIGINT AS bytes_to_transfer FROM plan")
def plan_stats(t):
    return summaries.summarize(full_plan(t))


@query("SELECT sum(greatest(bytes_written - literal_bytes, 0))::BIGINT AS delta_saved, sum(greatest(bytes_written - transferred_bytes, 0))::BIGINT AS compression_saved FROM (SELECT bytes_written, coalesce(literal_bytes, bytes_written) AS literal_bytes, coalesce(transferred_bytes, bytes_written) AS transferred_bytes FROM xfer)")
def transfer_savings(t):
    of = t.xfer()
    return summaries.savings(of.select("bytes_written", *[F.coalesce(c, "bytes_written").alias(c) for c in ("literal_bytes", "transferred_bytes")]))


@query("AND n AS (SELECT count(*) FILTER (action = 'delete') AS deletes FROM plan), m AS (SELECT count(*) AS dest_rows FROM dst) SELECT deletes, dest_rows, deletes * 100 > dest_rows * 10 AS refused, deletes > 50 AS needs_confirmation FROM n, m")
def deletion_guard(t):
    return summaries.deletion_guard(full_plan(t), t.dst(), 10, 50)


@query("AND n AS (SELECT sum(src_size)::BIGINT AS need FROM plan WHERE action IN ('create', 'update')) SELECT need, need + need // 10 AS required, need + need // 5 AS comfortable, CASE WHEN need + need // 10 > 1000000 THEN 'error' WHEN need + need // 5 > 1000000 THEN 'warn' ELSE 'ok' END AS status FROM n")
def capacity_check(t):
    return summaries.capacity_check(full_plan(t), 1_000_000)


@query(f"""AND c AS (SELECT {_PARENT} AS dir, path, size FROM src), p AS (SELECT dir, (count(*) + 39) // 40 AS parts FROM c GROUP BY dir),
h AS (SELECT c.*, parts, ('0x' || md5(path)[1:8])::BIGINT % parts AS chunk FROM c JOIN p USING (dir))
SELECT dir, chunk::INT AS chunk, count(*) AS n, string_agg(path || '=' || size, ';' ORDER BY path) AS children FROM h GROUP BY 1, 2""")
def children_by_dir(t):
    of = summaries.children_by_dir(t.src(), 40)
    return of.select("dir", "chunk", "n", F.array_join(F.transform("children", lambda c: F.concat(c["path"], F.lit("="), c["size"].cast("string"))), ";").alias("children"))


@query("AND s AS (SELECT count(*) AS files, sum(l_quantity) AS bytes, sum(l_linenumber) AS transfer_seconds, sum(l_linenumber) * 2 AS total_seconds FROM lineitem) SELECT round(bytes / transfer_seconds, 6) AS avg_speed, round(files::DOUBLE / total_seconds, 6) AS files_per_second, round(bytes / transfer_seconds / 20 * 100, 6) AS utilisation FROM s")
def perf_metrics(t):
    log = t.lineitem.select(F.lit(1).alias("files"), F.col("l_quantity").alias("bytes"), F.col("l_linenumber").alias("transfer_seconds"), (F.col("l_linenumber") * 2).alias("total_seconds"))
    return summaries.perf_metrics(log, 20).select(*[F.round(c, 6).alias(c) for c in ("avg_speed", "files_per_second", "utilisation")])


@query("SELECT count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'error') >= 100 AS abort FROM events")
def error_threshold(t):
    return summaries.error_threshold(t.events.select(F.when(F.col("event_type") == "error", F.col("props")).alias("error")), 100)


@query("SELECT 'e/' || event_id AS path, event_type AS error, 'update' AS action FROM events WHERE event_type = 'error'")
def error_rows(t):
    kind = F.col("event_type")
    return summaries.error_rows(t.events.select(F.concat(F.lit("e/"), F.col("event_id").cast("string")).alias("path"), F.when(kind == "error", kind).alias("error"), F.lit("update").alias("action")))


# --- checksums, blocks, compression


@query("SELECT path, md5(content) AS fast, sha256(content) AS cryptographic, 'none' AS none FROM src")
def content_checksum(t):
    c = F.col("content").cast("binary")
    return t.src().select("path", blocks.checksum(c, "md5").alias("fast"), blocks.checksum(c, "cryptographic").alias("cryptographic"), blocks.checksum_hex(blocks.checksum(c, "none")).alias("none"))


@query("SELECT o_orderkey AS k, least(greatest(floor(sqrt(round(o_totalprice * 1000))), 512), 131072)::BIGINT AS width FROM orders")
def block_size(t):
    return t.orders.select(F.col("o_orderkey").alias("k"), blocks.block_size(F.round(F.col("o_totalprice") * 1000)).alias("width"))


# Blocks in SQL are cut from the hexadecimal form, as DuckDB has no substring of blobs.
_BLK = "{0} AS (SELECT path, idx, idx * 512 AS off, substr(h, (idx * 1024 + 1)::BIGINT, 1024) AS h FROM (SELECT path, hex(encode(content)) AS h, unnest(range(0, (strlen(content) + 511) // 512)) AS idx FROM {1}))"


@query(f"AND {_BLK.format('b', 'src')} SELECT path, idx, off, length(h) // 2 AS size, md5(unhex(h)) AS strong FROM b")
def block_checksums(t):
    return blocks.block_table(t.src(), 512).select("path", "idx", "off", "size", "strong")


@query(f"AND {_BLK.format('x', 'src')}, {_BLK.format('y', 'dst')} SELECT path, idx, md5(unhex(x.h)) AS expected, md5(unhex(y.h)) AS actual FROM (SELECT * FROM x WHERE path IN (SELECT path FROM dst)) x FULL JOIN (SELECT * FROM y WHERE path IN (SELECT path FROM src)) y USING (path, idx) WHERE x.h IS DISTINCT FROM y.h")
def verify_blocks(t):
    return blocks.verify_blocks(t.src(), t.dst(), 512)


@query(f"AND {_BLK.format('x', 'src')}, {_BLK.format('y', 'dst')} SELECT path, count(*) AS blocks, count(*) FILTER (x.h IS DISTINCT FROM y.h) AS changed, sum(CASE WHEN x.h IS DISTINCT FROM y.h THEN length(x.h) // 2 ELSE 0 END)::BIGINT AS literal_bytes FROM (SELECT * FROM x WHERE path IN (SELECT path FROM dst)) x LEFT JOIN y USING (path, idx) GROUP BY path")
def block_diff(t):
    return blocks.block_diff(t.src(), t.dst(), 512)


@query("""AND j AS (SELECT s.path, hex(encode(s.content)) AS sh, hex(encode(d.content)) AS dh, s.size AS ss, d.size AS ds, abs(s.size - d.size)::DOUBLE / d.size AS apart, (d.size + 511) // 512 AS nb FROM src s JOIN dst d USING (path)),
r AS (SELECT *, least(20, nb) AS n FROM j WHERE apart <= 0.5), i AS (SELECT *, unnest(range(0, n)) AS i FROM r),
o AS (SELECT *, least(i * CASE WHEN n > 1 THEN nb // (n - 1) ELSE 0 END, nb - 1) * 1024 + 1 AS pos FROM i)
SELECT path, least(apart, 1.0) AS ratio, 0::BIGINT AS samples, least(apart, 1.0) <= 0.75 AS use_delta FROM j WHERE apart > 0.5
UNION ALL SELECT path, count_if(substr(sh, pos, 1024) <> substr(dh, pos, 1024))::DOUBLE / count(*), count(*), count_if(substr(sh, pos, 1024) <> substr(dh, pos, 1024))::DOUBLE / count(*) <= 0.75 FROM o GROUP BY path""")
def change_ratio(t):
    return blocks.change_ratio(t.src(), t.dst(), 512)


@query("SELECT s.path, CASE WHEN d.size IS NULL OR d.size < 1000 THEN 'full' WHEN s.k % 8 = 0 THEN 'sparse' WHEN (s.k % 10) / 10.0 > 0.75 THEN 'full' ELSE 'delta' END AS strategy FROM src s LEFT JOIN dst d USING (path)")
def strategy_choice(t):
    of = t.src().select("path", (F.col("k") % 8 == 0).alias("is_sparse"), (F.col("k") % 10 / 10).alias("ratio")).join(t.dst().select("path", F.col("size").alias("dst_size")), "path", "left")
    return blocks.choose_strategy(of, local_small=1000).select("path", "strategy")


def both_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.src().select("path", "content"), t.dst().select("path", "content")


PIECE = 1 << 14


def delta_ops(t: Tables) -> DataFrame:
    src, dst = both_sides(t)
    return pieces.rolling_delta(pieces.pieces(src, PIECE, 511), pieces.pieces(dst, PIECE), 512)


def transferred(t: Tables) -> DataFrame:
    src = t.src().select("path", "size", "mtime", "is_dir", "content", (F.col("k") % 8 == 0).alias("is_sparse"))
    return transfer.transfer(src, t.dst(), compare.plan_oneway(src, t.dst()), piece=PIECE)[1]


@query("SELECT o.path, o.action, CASE WHEN o.dst_size IS NULL OR o.dst_size < 4096 THEN 'full' WHEN s.k % 8 = 0 THEN 'sparse' ELSE 'measured' END AS strategy, o.src_size AS bytes_written, NULL::VARCHAR AS error FROM oneway o JOIN src s USING (path) WHERE o.action IN ('create', 'update')")
def transfer_run(t):
    small = F.col("dst_size").isNull() | (F.col("dst_size") < 4096)
    of = transferred(t).join(t.dst().select("path", F.col("size").alias("dst_size")), "path", "left")
    measured = F.when(small | (F.col("strategy") == "sparse"), F.col("strategy")).otherwise("measured")
    return of.select("path", "action", measured.alias("strategy"), "bytes_written", "error")


@query()
def transfer_run_savings(t):
    return summaries.savings(transferred(t))


@query()
def rolling_delta(t):
    return delta_ops(t).select("path", "at", "op", "off", "size")


@query("SELECT path, md5(content) AS checksum, size FROM src WHERE size > 0")
def delta_roundtrip(t):
    return pieces.digests(pieces.apply_delta(pieces.pieces(both_sides(t)[1], PIECE), stored(delta_ops(t)), PIECE))


@query()
def delta_ratio(t):
    return blocks.delta_ratio(delta_ops(t))


@query("""AND h AS (SELECT path, hex(encode(content)) AS h, size AS n FROM src WHERE size > 0), b AS (SELECT path, n, h, unnest(range(0, n)) AS i FROM h),
v AS (SELECT path, n, i, ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT AS v FROM b)
SELECT path, (n + sum((n - i) * v))::BIGINT % 65521 * 65536 + (1 + sum(v))::BIGINT % 65521 AS weak FROM v GROUP BY path, n""")
def adler32(t):
    return t.src().select("path", blocks.adler32(F.col("content").cast("binary")).alias("weak"))


def flagged(t: Tables) -> DataFrame:
    of = t.base().select("path", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.octet_length("content") / 512) - 1)).alias("idx"), F.octet_length("content").cast("long").alias("n")).where("n > 0")
    return of.select("path", "idx", (F.col("idx") * 512).alias("off"), F.least(F.lit(512), F.col("n") - F.col("idx") * 512).alias("size"), ((F.col("k") + F.col("idx")) % 3 == 0).alias("is_zero"))


@query(f"AND {_BLK.format('b', 'src')} SELECT path, idx, off, length(h) // 2 AS size, replace(h, '0', '') = '' AS is_zero FROM b")
def zero_blocks(t):
    return blocks.zero_blocks(t.src(), 512)


@query("""AND f AS (SELECT path, k, unnest(range(0, (strlen(content) + 511) // 512)) AS idx, strlen(content) AS n FROM base),
g AS (SELECT path, idx, idx * 512 AS off, least(512, n - idx * 512) AS size, idx - row_number() OVER (PARTITION BY path ORDER BY idx) AS island FROM f WHERE (k + idx) % 3 <> 0)
SELECT path, min(off) AS off, sum(size)::BIGINT AS length FROM g GROUP BY path, island""")
def data_regions(t):
    return blocks.data_regions(flagged(t))


@query(f"AND {_BLK.format('b', 'base')} SELECT path, md5(unhex(string_agg(CASE WHEN (k + idx) % 3 = 0 THEN repeat('0', length(h)) ELSE h END, '' ORDER BY idx))) AS checksum, sum(length(h) // 2)::BIGINT AS size FROM b JOIN base USING (path) GROUP BY path")
def sparse_roundtrip(t):
    table = blocks.block_table(t.base(), 512)
    kept = table.join(flagged(t).where("not is_zero").select("path", "idx"), ["path", "idx"]).select("path", "off", "data")
    sizes = t.base().select("path", F.octet_length("content").cast("long").alias("size"))
    return pieces.digests(pieces.rebuild_sparse(kept, sizes, PIECE))


@query("SELECT page_id AS k, page_id % 11 IN (0, 1, 4, 7, 8) AS compressed FROM pages")
def compressed_ext(t):
    k = F.col("page_id")
    name = F.element_at(F.array(*map(F.lit, ["a/b.zip", "x.tar.gz", "c.txt", "zip", "M.JPG", "d.tar", "e", "q.Heif", "r.wasm", "s.lz4", "t.odt"])), (k % 11 + 1).cast("int"))
    return t.pages.select(k.alias("k"), blocks.is_compressed(name).alias("compressed"))


@query("SELECT k, CASE WHEN size < 1048576 OR k % 6 = 0 THEN 'none' WHEN k % 5 = 0 OR (k % 10) / 10.0 < 0.9 THEN 'zstd' ELSE 'none' END AS codec FROM (SELECT o_orderkey AS k, round(o_totalprice * 100)::BIGINT AS size FROM orders)")
def codec_choice(t):
    k = F.col("o_orderkey")
    name = F.when(k % 6 == 0, "a.zip").otherwise("a.txt")
    ratio = F.when(k % 5 != 0, k % 10 / 10)
    return t.orders.select(k.alias("k"), blocks.choose_codec(F.round(F.col("o_totalprice") * 100).cast("long"), name, ratio).alias("codec"))


@query()
def compressibility(t):
    return t.src().select("path", blocks.compressibility(F.col("content")).alias("ratio"))


@query()
def bloom_membership(t):
    keys = t.src().select("path")
    n = keys.count()
    return blocks.bloom_filter(t.dst().select("path"), "path", blocks.bloom_build(keys, "path", n), n)


# --- merges


def changed(t: Tables) -> DataFrame:
    return merge.classify(t.src(), t.dst(), t.state())


@query("SELECT path, change_type, s_size, s_mt AS s_mtime, d_size, d_mt AS d_mtime, ps_size, pd_size FROM changes")
def bisync_classify(t):
    return changed(t).select("path", "change_type", "s_size", *micros("s_mtime"), "d_size", *micros("d_mtime"), "ps_size", "pd_size")


def _actions_sql(strategy: str) -> str:
    """The action of every change as a CASE, for one strategy."""
    one = "WHEN NOT d THEN 'CopyToDest' WHEN NOT s THEN 'CopyToSource'"
    a, b = {"newer": ("s_mt", "d_mt"), "larger": ("s_size", "d_size"), "smaller": ("d_size", "s_size")}.get(strategy, ("0", "0"))
    won = {
        "source": "WHEN s THEN 'CopyToDest' ELSE 'DeleteFromDest'", "dest": "WHEN d THEN 'CopyToSource' ELSE 'DeleteFromSource'", "rename": f"{one} ELSE 'RenameConflict'",
    }.get(strategy, f"{one} WHEN {a} > {b} THEN 'CopyToDest' WHEN {a} < {b} THEN 'CopyToSource' ELSE 'RenameConflict'")
    return f"""acts AS (SELECT *, CASE WHEN change_type IN ('NewInSource', 'ModifiedInSource') THEN 'CopyToDest' WHEN change_type IN ('NewInDest', 'ModifiedInDest') THEN 'CopyToSource'
  WHEN change_type = 'DeletedFromSource' THEN 'DeleteFromDest' WHEN change_type = 'DeletedFromDest' THEN 'DeleteFromSource' {won} END AS action FROM changes),
actions AS (SELECT *, CASE action WHEN 'CopyToDest' THEN s_size WHEN 'CopyToSource' THEN d_size END AS winner_size, CASE action WHEN 'CopyToDest' THEN s_mt WHEN 'CopyToSource' THEN d_mt END AS winner_mt,
  CASE WHEN action = 'RenameConflict' THEN regexp_replace(path, '[.]txt$', '.conflict-77-source.txt') END AS conflict_source_path, CASE WHEN action = 'RenameConflict' THEN regexp_replace(path, '[.]txt$', '.conflict-77-dest.txt') END AS conflict_dest_path FROM acts)"""


def resolved(t: Tables, strategy: str) -> DataFrame:
    return merge.resolve(changed(t), strategy, 77)


def _register_resolvers() -> None:
    for name in merge.STRATEGIES:
        def run(t, name=name):
            return resolved(t, name).select("path", "action", "winner_size", "conflict_source_path", "conflict_dest_path")

        run.__name__ = f"bisync_resolve_{name}"
        query(f"AND {_actions_sql(name)} SELECT path, action, winner_size, conflict_source_path, conflict_dest_path FROM actions")(run)


_register_resolvers()


def _applied_sql(own: str, other: str, copy: str, delete: str, name: str) -> str:
    return f"""AND {_actions_sql('newer')} SELECT path, size, md5(content) AS checksum FROM {own} WHERE path NOT IN (SELECT path FROM actions WHERE action IN ('{copy}', '{delete}', 'RenameConflict'))
UNION ALL SELECT path, size, md5(content) FROM {other} WHERE path IN (SELECT path FROM actions WHERE action = '{copy}')
UNION ALL SELECT a.{name}, o.size, md5(o.content) FROM {own} o JOIN actions a USING (path) WHERE a.action = 'RenameConflict'"""


def light(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Both sides with checksums for contents."""
    return summed(t.src()).drop("content"), summed(t.dst()).drop("content")


@query(_applied_sql("src", "dst", "CopyToSource", "DeleteFromSource", "conflict_source_path"))
def bisync_apply_source(t):
    return merge.apply_merge(*light(t), resolved(t, "newer"))[0].select("path", "size", "checksum")


@query(_applied_sql("dst", "src", "CopyToDest", "DeleteFromDest", "conflict_dest_path"))
def bisync_apply_dest(t):
    return merge.apply_merge(*light(t), resolved(t, "newer"))[1].select("path", "size", "checksum")


@query(f"""AND {_actions_sql('newer')}, new AS (SELECT path, 'dest' AS side, winner_mt AS mt, winner_size AS size FROM actions WHERE action = 'CopyToDest' UNION ALL SELECT path, 'source', winner_mt, winner_size FROM actions WHERE action = 'CopyToSource'
UNION ALL SELECT path, 'source', s_mt, s_size FROM actions WHERE action = 'RenameConflict' UNION ALL SELECT path, 'dest', d_mt, d_size FROM actions WHERE action = 'RenameConflict')
SELECT path, side, mt AS mtime, size FROM (SELECT path, side, mt, size FROM state WHERE (path, side) NOT IN (SELECT path, side FROM new) UNION ALL SELECT * FROM new) WHERE path NOT IN (SELECT path FROM actions WHERE action IN ('DeleteFromSource', 'DeleteFromDest'))""")
def bisync_state(t):
    return merge.update_state(t.state(), resolved(t, "newer"), now(), "receiver").select("path", "side", *micros("mtime"), "size")


@query(f"""AND {_actions_sql('newer')} SELECT count(*) FILTER (action IN ('CopyToDest', 'RenameConflict')) AS to_dest, count(*) FILTER (action IN ('CopyToSource', 'RenameConflict')) AS to_source, count(*) FILTER (action = 'DeleteFromSource') AS deleted_from_source,
count(*) FILTER (action = 'DeleteFromDest') AS deleted_from_dest, count(*) FILTER (action = 'RenameConflict') AS renamed, sum(coalesce(winner_size, 0) + CASE WHEN action = 'RenameConflict' THEN s_size + d_size ELSE 0 END)::BIGINT AS bytes FROM actions""")
def bisync_stats(t):
    return merge.merge_stats(resolved(t, "newer"))


@query("SELECT path, s_size, d_size, 'newer' AS strategy, CASE change_type WHEN 'ModifiedBoth' THEN 'both modified' WHEN 'CreateCreateConflict' THEN 'created on both sides' ELSE 'modified vs deleted' END AS conflict FROM changes WHERE change_type IN ('ModifiedBoth', 'CreateCreateConflict', 'ModifyDeleteConflict')")
def bisync_conflicts(t):
    return merge.conflict_report(changed(t), "newer").select("path", "s_size", "d_size", "strategy", "conflict")


@query("AND n AS (SELECT count(*) FILTER (change_type IN ('DeletedFromSource', 'DeletedFromDest')) AS deletions, count(*) AS changes FROM changes) SELECT deletions, changes, NOT (changes > 0 AND deletions * 100 > changes * 25) AS ok FROM n")
def bisync_deletion_guard(t):
    return merge.merge_deletion_guard(changed(t), 25)


@query(f"""AND {_actions_sql('source')}, w AS (SELECT * FROM actions WHERE action IN ('CopyToDest', 'CopyToSource')),
new AS (SELECT path, 'source' AS side, winner_size AS size, winner_mt AS mt FROM w UNION ALL SELECT path, 'dest', winner_size, winner_mt FROM w)
SELECT 'source' AS "table", '' AS side, path, size, mt AS mtime FROM src WHERE path NOT IN (SELECT path FROM actions WHERE action IN ('CopyToSource', 'DeleteFromSource'))
UNION ALL SELECT 'source', '', path, size, mt FROM dst WHERE path IN (SELECT path FROM actions WHERE action = 'CopyToSource')
UNION ALL SELECT 'dest', '', path, size, mt FROM dst WHERE path NOT IN (SELECT path FROM actions WHERE action IN ('CopyToDest', 'DeleteFromDest'))
UNION ALL SELECT 'dest', '', path, size, mt FROM src WHERE path IN (SELECT path FROM actions WHERE action = 'CopyToDest')
UNION ALL SELECT 'state', side, path, size, mt FROM (SELECT path, side, size, mt FROM state WHERE path NOT IN (SELECT path FROM w) AND path NOT IN (SELECT path FROM actions WHERE action IN ('DeleteFromSource', 'DeleteFromDest')) UNION ALL SELECT path, side, size, mt FROM new)""")
def bisync_end_to_end(t):
    src, dst, kept = merge.bisync(*(df.select("path", "size", "mtime", "is_dir") for df in (t.src(), t.dst())), t.state(), now(), "source", percent=90)
    row = lambda df, name, side: df.select(F.lit(name).alias("table"), side.alias("side"), "path", "size", *micros("mtime"))
    return row(src, "source", F.lit("")).unionByName(row(dst, "dest", F.lit(""))).unionByName(row(kept, "state", F.col("side")))


# --- scalar functions


@query("""AND p AS (SELECT k, size_text, regexp_extract(upper(trim(size_text)), '^([0-9]+)', 1)::BIGINT AS n, k % 6 AS u FROM sizes)
SELECT k, CASE u WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN n * 1024 WHEN 3 THEN n * 1048576 WHEN 4 THEN n * 1073741824 END AS bytes FROM p""")
def parse_size(t):
    return t.sizes().select("k", text.parse_size(F.col("size_text")).alias("bytes"))


@query(f"SELECT o_orderkey AS k, {_BYTES.format('(round(o_totalprice * 100)::BIGINT)')} AS text FROM orders")
def format_bytes(t):
    return t.orders.select(F.col("o_orderkey").alias("k"), text.format_bytes(F.round(F.col("o_totalprice") * 100).cast("long")).alias("text"))


# Hundredths in whole numbers: a half goes up.
@query("AND o AS (SELECT o_orderkey AS k, o_orderkey * o_orderkey * 7 % 100000007 AS v FROM orders), q AS (SELECT k, v, CASE WHEN v >= 1000000 THEN (v + 5000) // 10000 ELSE (v + 5) // 10 END AS q FROM o) SELECT k, CASE WHEN v >= 1000 THEN (q // 100) || '.' || lpad((q % 100)::VARCHAR, 2, '0') || CASE WHEN v >= 1000000 THEN ' MB/s' ELSE ' KB/s' END ELSE v || ' B/s' END AS text FROM q")
def format_speed(t):
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("k"), text.format_speed((k * k * 7 % 100000007).cast("double")).alias("text"))


@query("SELECT o_orderkey AS k, CASE WHEN v >= 3600 THEN (v::BIGINT // 3600) || 'h ' || (v::BIGINT % 3600 // 60) || 'm ' || (v::BIGINT % 60) || 's' WHEN v >= 60 THEN (v::BIGINT // 60) || 'm ' || (v::BIGINT % 60) || 's' ELSE printf('%.2fs', v::DOUBLE) END AS text FROM (SELECT o_orderkey, o_orderkey % 9001 AS v FROM orders)")
def format_duration(t):
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("k"), text.format_duration((k % 9001).cast("double")).alias("text"))


@query("""SELECT k, CASE k % 5 WHEN 1 THEN 's3' WHEN 2 THEN 's3' WHEN 3 THEN 'remote' ELSE CASE WHEN k % 5 = 0 THEN 'remote' ELSE 'local' END END AS kind, CASE WHEN k % 5 = 3 THEN 'user' END AS "user",
CASE k % 5 WHEN 3 THEN 'h' WHEN 0 THEN regexp_extract(uri, '^([^:]*):', 1) END AS host, CASE WHEN k % 5 IN (1, 2) THEN 'b' END AS bucket,
CASE k % 5 WHEN 1 THEN k::VARCHAR WHEN 2 THEN '' WHEN 3 THEN '/p/' || k WHEN 0 THEN regexp_extract(uri, '^[^:]*:(.*)$', 1) ELSE uri END AS path, CASE WHEN k % 5 = 1 THEN 'r1' END AS region, NULL::VARCHAR AS endpoint FROM uris""")
def parse_location(t):
    return t.uris().select("k", text.parse_location(F.col("uri")).alias("l")).select("k", "l.*")


@query("SELECT k, uri AS text FROM uris")
def format_location(t):
    return t.uris().select("k", text.format_location(text.parse_location(F.col("uri"))).alias("text"))


# --- streams, as batches


@query("""AND c AS (SELECT path, mt, kind FROM chg WHERE kind IN ('create', 'modify', 'remove')),
g AS (SELECT *, CASE WHEN mt - lag(mt) OVER w < 3600000000 THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY path ORDER BY mt)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY mt ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT path, min(mt) AS start, max(mt) + 3600000000 AS "end", count(*) AS n, arg_max(kind, (mt, kind)) AS kind FROM i GROUP BY path, island""")
def coalesce_sessions(t):
    return watch.coalesce_events(snapshots.changes_only(t.changes()), "1 hour").select("path", *micros("start", "end"), "n", "kind")


@query()
def token_bucket(t):
    e = t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"), (F.coalesce("value", F.lit(0.0)) * 100).alias("bytes"))
    return watch.token_bucket(e, 1000.0)
