"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import broadcast_if_small, materialise

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
#: Sources, one narrow row each, that are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null or empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_repeat: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, size).

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes by weight. A target
    stops at max_repeat times its source's size; what is over is shared again by weight among the rest. In the order of
    cap per weight the capped sources are a prefix, so that running sums over one row per source give the fixed point
    without iteration. Sums are whole numbers; a target is one division.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % n + 1).cast("int")).cast("long")
    per = per.withColumn("nth", nth).withColumn("w", w).withColumn("cap", F.col("source_size") * max_repeat)
    order = Window.orderBy(F.col("cap") / F.col("w"), "nth")
    everything = Window.partitionBy()
    per = per.withColumns({
        "total": F.sum("source_size").over(everything),
        "cap_before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "w_from": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    per = per.withColumn("capped", F.col("cap") * F.col("w_from") < (F.col("total") - F.col("cap_before")) * F.col("w"))
    per = per.withColumns({
        "cap_all": F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything),
        "w_free": F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(everything),
    })
    share = ((F.col("total") - F.col("cap_all")) * F.col("w")).cast("double") / F.col("w_free")
    return per.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def copies(doc_id: Column, rate: Column, seed: str = SEED) -> Column:
    """floor(rate) copies, and one more if the hash of seed and id, as a number in [0, 1), is below the fraction."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mixed_sizes(docs: DataFrame, max_repeat: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = SEED) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken), one for each row of documents.

    Sizes are counted once and kept in a narrow table; the text is not read again. A source without words has the
    target 0. Repeated rows are drawn alike, as their ids are equal. Empty input gives no rows.
    """
    sizes = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    targets = source_targets(sizes, max_repeat, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = broadcast_if_small(targets.withColumnRenamed("source", "of_source"), BROADCAST_SOURCES)
    joined = sizes.join(t, sizes["source"].eqNullSafe(t["of_source"]))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("doc_id"), rate, seed)).alias("taken"))


def mix_sources(docs: DataFrame, max_repeat: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = SEED) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; columns as they were.

    Documents of a source without words are not taken; null and empty texts count as no words and follow their source's
    rate. Repeated rows are drawn alike, as their ids are equal; so are null ids. Other columns may have any name. Empty input gives no
    rows.
    """
    sizes = materialise(docs.select("source", word_count(F.col("text")).alias("size")), "sizes")
    t = source_targets(sizes, max_repeat, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # names that no column of the documents has
    name = max(map(len, docs.columns)) * "_"
    of, at, n = (f"{name}_{x}" for x in ("source", "rate", "copies"))
    t = broadcast_if_small(t.select(F.col("source").alias(of), rate.alias(at)), BROADCAST_SOURCES)
    joined = docs.join(t, docs["source"].eqNullSafe(t[of]))
    taken = joined.withColumn(n, copies(F.col("doc_id"), F.col(at), seed)).where(F.col(n) > 0)
    return taken.withColumn(of, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*docs.columns)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mixed_sizes() of all documents, with weights 1, 2, 3 and three repeats at most."""
    return mixed_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH s AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT source, source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS nth FROM p),
c AS (SELECT *, (nth - 1) % 3 + 1 AS w, source_size * 3 AS cap FROM w),
o AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total,
        coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cap_before,
        sum(w) OVER (ORDER BY cap::DOUBLE / w, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS w_from FROM c),
f AS (SELECT *, cap * w_from < (total - cap_before) * w AS capped FROM o),
g AS (SELECT *, sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()::BIGINT AS cap_all, sum(CASE WHEN capped THEN 0 ELSE w END) OVER ()::BIGINT AS w_free FROM f),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE ((total - cap_all) * w)::DOUBLE / w_free END AS target FROM g),
r AS (SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
