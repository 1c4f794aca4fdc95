"""Tables in the cluster's shared folder, and connected components over them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes in an Arrow batch, at most.
ROWS = 1000
BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one if driver and executors are one
    process (tests); a cluster without the setting is an error, as its executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ROWS rows and about BYTES bytes. Rows hold whole texts, sets or vectors here,
    and a batch of them is in memory on both sides of a Python worker's pipe. Smaller bounds that are set stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)):
        if not 0 < int(re.sub(r"\D", "", spark.conf.get(key)) or 0) <= most:
            spark.conf.set(key, str(most))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    This cuts lineage: a lost executor costs the tasks it ran and not the steps before. A table stays until discard()
    drops it or the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    small_batches(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.shared_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most that many rows; counts no further."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint behind a check of the size; a larger table is left to a shuffled join."""
    return F.broadcast(df) if small_enough(df, rows) else df


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (id, component): every id that occurs in edges (a, b), and the smallest id it reaches.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step groups by an endpoint with map-side
    minima and joins the minimum back, so no neighbourhood is ever collected. It ends when a round leaves the number of
    links and the exclusive or of their hashes as they were. Ids may be any longs. Self-loops and repeated edges are fine;
    edges with a null end are ignored; no edges give no rows. Each round's table replaces the last one's.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = materialise(e, "edges")
    loops = edges.where("a = b").select(F.col("a").alias("u"))
    before = None
    while True:
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "u", "v"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, e = e, materialise(small.where("u <> v").distinct(), "small-star")
        discard(last, large)
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("id"), F.col("u").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots).unionByName(alone).groupBy("id").agg(F.min("component").alias("component"))
