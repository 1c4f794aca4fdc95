"""Snapshots, state and caches derived from the given tables by fixed rules; SQL has the same rules in CTES."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import parse_rules

#: 2024-01-01 00:00:00 UTC in microseconds.
T0 = 1704067200000000
SECOND = 1_000_000
RULES = ["- src1/", "+ *7.txt", "- */de/*", "- src2?/**", "+ *.txt", "- *"]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def base(self) -> DataFrame:
        k = F.col("doc_id")
        return self.documents.select(k.alias("k"), F.concat("source", F.lit("/"), "lang", F.lit("/"), k.cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"), (F.lit(T0) + k * SECOND).alias("mt"))

    def src(self) -> DataFrame:
        k = F.col("k")
        content = F.when(k % 7 == 2, F.concat("content", F.lit(" [src edit]"))).otherwise(F.col("content"))
        late = F.when(k % 7 == 2, 60 * SECOND).when(k % 5 == 4, 1_500_000).otherwise(0)
        return _snapshot(self.base().where(k % 13 != 1).withColumns({"content": content, "mt": F.col("mt") + late}))

    def dst(self) -> DataFrame:
        k = F.col("k")
        add = lambda text: F.concat("content", F.lit(text))
        content = F.when(k % 28 == 2, add(" [dst edit!]")).when(k % 14 == 2, add(" [dst edit]")).when(k % 28 == 9, add(" [longer dst edit]")).when(k % 21 == 3, F.reverse("content")).when(k % 7 == 3, add("!")).otherwise(F.col("content"))
        late = F.when(k % 28 == 2, 120).when(k % 14 == 2, 60).when(k % 28 == 9, 60).when(k % 21 == 3, 90).when(k % 7 == 3, 5).otherwise(0)
        rows = self.base().where(k % 13 != 2).withColumns({"content": content, "mt": F.col("mt") + late * SECOND})
        extra = self.base().where(k % 19 == 0).withColumns({"path": F.concat(F.lit("extra/"), k.cast("string"), F.lit(".txt")), "mt": F.lit(T0)})
        return _snapshot(rows.unionByName(extra))

    def dirs(self) -> DataFrame:
        d = self.documents
        paths = d.select(F.col("source").alias("path")).unionByName(d.select(F.concat("source", F.lit("/"), "lang").alias("path"))).distinct()
        return paths.select("path", F.lit(0).cast("long").alias("size"), F.timestamp_micros(F.lit(T0)).alias("mtime"), F.lit(True).alias("is_dir"))

    def state(self) -> DataFrame:
        k = F.col("k")
        rows = self.base().where(k % 11 != 0)
        one = lambda of, side: of.select("path", F.lit(side).alias("side"), F.timestamp_micros("mt").alias("mtime"), F.octet_length("content").cast("long").alias("size"), F.lit(None).cast("string").alias("checksum"), F.timestamp_micros(F.lit(T0)).alias("last_sync"))
        return one(rows.where(k % 17 != 5), "source").unionByName(one(rows.where(k % 17 != 3), "dest"))

    def _orders(self, path: Column, size: Column, micros: Column, keep: Column) -> DataFrame:
        return self.orders.where(keep).select(path.alias("path"), size.alias("size"), F.timestamp_micros(micros).alias("mtime"), F.lit(False).alias("is_dir"))

    def ord_src(self) -> DataFrame:
        return self._orders(*_order_columns(), F.lit(True))

    def ord_dst(self) -> DataFrame:
        path, size, micros = _order_columns()
        k = F.col("o_orderkey")
        return self._orders(path, size + F.when(k % 20 == 3, 1).otherwise(0), micros + F.when(k % 9 == 4, SECOND).when(k % 9 == 5, 2 * SECOND).otherwise(0), k % 50 != 7)

    def cache(self) -> DataFrame:
        k = F.col("k")
        sha = k % 8 == 6
        mt = F.unix_micros("mtime") + F.when(k % 4 == 1, SECOND).otherwise(0)
        rows = self.src().where(k % 3 != 0).select("path", F.timestamp_micros(mt).alias("mtime"), "size", F.when(sha, "sha256").otherwise("md5").alias("checksum_type"), F.when(sha, F.sha2("content", 256)).otherwise(F.md5("content")).alias("checksum"))
        gone = self.base().where(k % 23 == 0).select(F.concat(F.lit("gone/"), k.cast("string"), F.lit(".txt")).alias("path"), F.timestamp_micros(F.lit(T0)).alias("mtime"), F.octet_length("content").cast("long").alias("size"), F.lit("md5").alias("checksum_type"), F.md5("content").alias("checksum"))
        return rows.unionByName(gone)

    def links(self) -> DataFrame:
        k = F.col("k")
        return self.src().withColumns({"inode": k - k % 3, "nlink": F.when(k % 4 != 0, 3).otherwise(1)})

    def syms(self) -> DataFrame:
        k = F.col("page_id")
        name = lambda n: F.concat(F.lit("l/"), n.cast("string"))
        return self.pages.select(name(k).alias("path"), name(k * 3 % 250).alias("symlink_target"), (k % 2 == 0).alias("is_symlink"), F.lit(False).alias("is_dir"))

    def dirlinks(self) -> DataFrame:
        """Links from folder to folder: of page k in folder k % 97, to folder k * 7 % 101, which is a real one below 97."""
        k = F.col("page_id")
        name = lambda n: F.concat(F.lit("d"), n.cast("string"))
        return self.pages.where(k % 3 == 0).select(F.concat(name(k % 97), F.lit("/l"), k.cast("string")).alias("path"), name(k * 7 % 101 + k % 2 * 1000).alias("symlink_target"), F.lit(True).alias("is_symlink"), F.lit(False).alias("is_dir"))

    def xfer(self) -> DataFrame:
        k, size = F.col("k"), F.col("size")
        return self.src().select("path", size.alias("bytes_written"), F.when(k % 2 == 0, F.expr("size div 3")).alias("literal_bytes"), F.when(k % 5 == 0, F.expr("size div 2")).alias("transferred_bytes"))

    def changes(self) -> DataFrame:
        kinds = F.create_map(*[F.lit(x) for p in {"signup": "create", "click": "modify", "purchase": "modify", "error": "remove", "view": "access"}.items() for x in p])
        return self.events.select(F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("ts"), kinds[F.col("event_type")].alias("kind"))

    def sizes(self) -> DataFrame:
        k = F.col("doc_id")
        unit = F.element_at(F.array(*map(F.lit, ["", "B", "KB", "m", " GB", "x"])), (k % 6 + 1).cast("int"))
        return self.documents.select(k.alias("k"), F.concat((k % 2000).cast("string"), unit).alias("size_text"))

    def uris(self) -> DataFrame:
        k = F.col("page_id")
        n = k.cast("string")
        uri = F.when(k % 5 == 0, F.col("url")).when(k % 5 == 1, F.concat(F.lit("s3://b/"), n, F.lit("?region=r1"))).when(k % 5 == 2, "s3://b").when(k % 5 == 3, F.concat(F.lit("user@h:/p/"), n)).otherwise(F.concat(F.lit("C:/x/"), n))
        return self.pages.select(k.alias("k"), uri.alias("uri"))


def _order_columns() -> tuple[Column, Column, Column]:
    return F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")), F.round(F.col("o_totalprice") * 100).cast("long"), F.unix_micros(F.col("o_orderdate").cast("timestamp"))


def _snapshot(df: DataFrame) -> DataFrame:
    return df.select("k", "path", "content", F.octet_length("content").cast("long").alias("size"), F.timestamp_micros("mt").alias("mtime"), F.lit(False).alias("is_dir"))


def rules():
    return parse_rules(RULES)


CTES = f"""
base AS (SELECT doc_id AS k, source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content, {T0} + doc_id * {SECOND} AS mt FROM documents),
src AS (SELECT k, path, content, strlen(content) AS size, mt, false AS is_dir FROM (SELECT k, path, CASE WHEN k % 7 = 2 THEN content || ' [src edit]' ELSE content END AS content,
  mt + CASE WHEN k % 7 = 2 THEN 60000000 WHEN k % 5 = 4 THEN 1500000 ELSE 0 END AS mt FROM base WHERE k % 13 <> 1)),
dst AS (SELECT k, path, content, strlen(content) AS size, mt, false AS is_dir FROM (SELECT k, path,
  CASE WHEN k % 28 = 2 THEN content || ' [dst edit!]' WHEN k % 14 = 2 THEN content || ' [dst edit]' WHEN k % 28 = 9 THEN content || ' [longer dst edit]' WHEN k % 21 = 3 THEN reverse(content) WHEN k % 7 = 3 THEN content || '!' ELSE content END AS content,
  mt + 1000000 * CASE WHEN k % 28 = 2 THEN 120 WHEN k % 14 = 2 THEN 60 WHEN k % 28 = 9 THEN 60 WHEN k % 21 = 3 THEN 90 WHEN k % 7 = 3 THEN 5 ELSE 0 END AS mt FROM base WHERE k % 13 <> 2
  UNION ALL SELECT k, 'extra/' || k || '.txt', content, {T0} FROM base WHERE k % 19 = 0)),
dirs AS (SELECT DISTINCT path, 0::BIGINT AS size, {T0} AS mt, true AS is_dir FROM (SELECT source AS path FROM documents UNION ALL SELECT source || '/' || lang FROM documents)),
tree AS (SELECT path, size, is_dir FROM src UNION ALL SELECT path, size, is_dir FROM dirs),
state AS (SELECT path, 'source' AS side, mt, strlen(content) AS size FROM base WHERE k % 11 <> 0 AND k % 17 <> 5 UNION ALL SELECT path, 'dest', mt, strlen(content) FROM base WHERE k % 11 <> 0 AND k % 17 <> 3),
ord_src AS (SELECT 'orders/' || o_orderkey AS path, round(o_totalprice * 100)::BIGINT AS size, epoch_us(o_orderdate) AS mt, false AS is_dir FROM orders),
ord_dst AS (SELECT 'orders/' || o_orderkey AS path, round(o_totalprice * 100)::BIGINT + CASE WHEN o_orderkey % 20 = 3 THEN 1 ELSE 0 END AS size,
  epoch_us(o_orderdate) + CASE WHEN o_orderkey % 9 = 4 THEN 1000000 WHEN o_orderkey % 9 = 5 THEN 2000000 ELSE 0 END AS mt, false AS is_dir FROM orders WHERE o_orderkey % 50 <> 7),
cache AS (SELECT path, mt + CASE WHEN k % 4 = 1 THEN 1000000 ELSE 0 END AS mt, size, CASE WHEN k % 8 = 6 THEN 'sha256' ELSE 'md5' END AS checksum_type, CASE WHEN k % 8 = 6 THEN sha256(content) ELSE md5(content) END AS checksum FROM src WHERE k % 3 <> 0
  UNION ALL SELECT 'gone/' || k || '.txt', {T0}, strlen(content), 'md5', md5(content) FROM base WHERE k % 23 = 0),
links AS (SELECT *, k - k % 3 AS inode, CASE WHEN k % 4 <> 0 THEN 3 ELSE 1 END AS nlink FROM src),
syms AS (SELECT 'l/' || page_id AS path, 'l/' || (page_id * 3 % 250) AS symlink_target, page_id % 2 = 0 AS is_symlink, false AS is_dir FROM pages),
dirlinks AS (SELECT 'd' || (page_id % 97) || '/l' || page_id AS path, 'd' || (page_id * 7 % 101 + page_id % 2 * 1000) AS symlink_target FROM pages WHERE page_id % 3 = 0),
xfer AS (SELECT path, size AS bytes_written, CASE WHEN k % 2 = 0 THEN size // 3 END AS literal_bytes, CASE WHEN k % 5 = 0 THEN size // 2 END AS transferred_bytes FROM src),
chg AS (SELECT 'u/' || user_id AS path, epoch_us(ts) AS mt, CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'modify' WHEN 'purchase' THEN 'modify' WHEN 'error' THEN 'remove' WHEN 'view' THEN 'access' END AS kind FROM events),
sizes AS (SELECT doc_id AS k, (doc_id % 2000) || (CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'B' WHEN 2 THEN 'KB' WHEN 3 THEN 'm' WHEN 4 THEN ' GB' ELSE 'x' END) AS size_text FROM documents),
uris AS (SELECT page_id AS k, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 's3://b/' || page_id || '?region=r1' WHEN 2 THEN 's3://b' WHEN 3 THEN 'user@h:/p/' || page_id ELSE 'C:/x/' || page_id END AS uri FROM pages),
oneway AS (SELECT s.path, CASE WHEN d.path IS NULL THEN 'create' WHEN s.size <> d.size OR abs(s.mt - d.mt) // 1000000 > 1 THEN 'update' ELSE 'skip' END AS action, s.is_dir, s.size AS src_size, d.size AS dst_size, s.mt AS src_mt, d.mt AS dst_mt FROM src s LEFT JOIN dst d USING (path)),
deletes AS (SELECT d.path, 'delete' AS action, d.is_dir, NULL::BIGINT AS src_size, d.size AS dst_size, NULL::BIGINT AS src_mt, d.mt AS dst_mt FROM dst d ANTI JOIN src s USING (path)),
plan AS (SELECT * FROM oneway UNION ALL SELECT * FROM deletes),
prior AS (SELECT path, max(CASE WHEN side = 'source' THEN size END) AS ps_size, max(CASE WHEN side = 'source' THEN mt END) AS ps_mt, max(CASE WHEN side = 'dest' THEN size END) AS pd_size, max(CASE WHEN side = 'dest' THEN mt END) AS pd_mt FROM state GROUP BY path),
sides AS (SELECT coalesce(s.path, d.path) AS path, s.size AS s_size, s.mt AS s_mt, d.size AS d_size, d.mt AS d_mt FROM src s FULL JOIN dst d ON s.path = d.path),
facts AS (SELECT sides.*, ps_size, ps_mt, pd_size, pd_mt, s_size IS NOT NULL AS s, d_size IS NOT NULL AS d, ps_size IS NOT NULL AS ps, pd_size IS NOT NULL AS pd,
  s_size = d_size AS eq, s_size <> ps_size OR s_mt > ps_mt AS ms, d_size <> pd_size OR d_mt > pd_mt AS md FROM sides LEFT JOIN prior USING (path)),
changes AS (SELECT * FROM (SELECT *, CASE
  WHEN s AND d AND NOT ps AND NOT pd THEN CASE WHEN eq THEN NULL ELSE 'CreateCreateConflict' END
  WHEN s AND d AND ps AND pd THEN CASE WHEN ms AND md THEN CASE WHEN eq THEN NULL ELSE 'ModifiedBoth' END WHEN ms THEN 'ModifiedInSource' WHEN md THEN 'ModifiedInDest' END
  WHEN s AND d AND ps THEN CASE WHEN eq THEN NULL WHEN ms THEN 'CreateCreateConflict' ELSE 'NewInDest' END
  WHEN s AND d THEN CASE WHEN eq THEN NULL WHEN md THEN 'CreateCreateConflict' ELSE 'NewInSource' END
  WHEN s AND ps AND pd THEN CASE WHEN ms THEN 'ModifyDeleteConflict' ELSE 'DeletedFromDest' END
  WHEN s AND pd THEN 'DeletedFromDest' WHEN s THEN 'NewInSource'
  WHEN d AND ps AND pd THEN CASE WHEN md THEN 'ModifyDeleteConflict' ELSE 'DeletedFromSource' END
  WHEN d AND ps THEN 'DeletedFromSource' WHEN d THEN 'NewInDest' END AS change_type FROM facts) WHERE change_type IS NOT NULL)
"""
