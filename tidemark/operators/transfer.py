"""Contents of a plan applied by strategy: whole, without their zeros, or as a delta; and what that moved."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pieces
from .blocks import change_ratio, choose_codec, choose_strategy
from .tables import stored

#: Zeros are left out in blocks of so many bytes.
SPARSE = 4096


def compressed_size(data: Column, codec: Column) -> Column:
    """Bytes of data as it would be sent with the codec: none, lz4 or zstd; what doesn't shrink is sent as it is."""

    @F.pandas_udf("long")
    def run(data: pd.Series, codec: pd.Series) -> pd.Series:
        known = {"lz4": pa.Codec("lz4_raw"), "zstd": pa.Codec("zstd", 3)}
        sizes = [min(len(d), len(known[c].compress(d, asbytes=True))) if d and c in known else len(d or b"") for d, c in zip(data, codec)]
        return pd.Series(sizes, dtype="int64")

    return run(data, codec)


def route(src: DataFrame, dst: DataFrame, plan: DataFrame, width: int = 512, local: bool = False, limit: float = 0.75, local_small: int = 10 << 20) -> DataFrame:
    """Rows (path, action, size, strategy) of the files that a plan creates or updates: by the destination's size, whether
    the source (path, content[, is_sparse]) is sparse, and the ratio of changed blocks, which is measured only where it decides."""
    todo = plan.where("action in ('create', 'update') and not is_dir").select("path", "action")
    sparse = F.col("is_sparse") if "is_sparse" in src.columns else F.lit(False)
    size = lambda df: F.octet_length(F.col("content").cast("binary")).cast("long")
    mine = src.select("path", size(src).alias("size"), sparse.alias("is_sparse"))
    other = dst.select("path", size(dst).alias("dst_size"))
    met = stored(todo.join(mine, "path").join(other, "path", "left"))
    asked = met.where(~F.col("is_sparse") & (F.col("dst_size") >= (local_small if local else SPARSE))).select("path")
    ratio = change_ratio(src.join(asked, "path", "left_semi"), dst.join(asked, "path", "left_semi"), width, threshold=limit).select("path", "ratio")
    return choose_strategy(met.join(ratio, "path", "left"), small=SPARSE, local_small=local_small, is_local=local, limit=limit).select("path", "action", "size", "strategy")


def regions(of: DataFrame) -> DataFrame:
    """Operations (pieces.OPS) for the runs of blocks in pieces that aren't zero; runs end with their piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for b in batches:
            rows = []
            for path, off, size, data in zip(*(c.to_pylist() for c in b.columns)):
                data = data[:size]
                held = np.maximum.reduceat(np.frombuffer(data, np.uint8), np.arange(0, size, SPARSE)) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]])))
                for a, z in zip((edge[0::2] * SPARSE).tolist(), (edge[1::2] * SPARSE).tolist()):
                    z = min(z, size)
                    rows.append((path, off + a, "data", off + a, z - a, data[a:z]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["path", "at", "op", "off", "size", "data"])

    return of.select("path", "off", "size", "data").mapInArrow(run, pieces.OPS)


def transfer(src: DataFrame, dst: DataFrame, plan: DataFrame, width: int = 512, piece: int = pieces.PIECE, codec: str = "auto", local: bool = False, limit: float = 0.75, local_small: int = 10 << 20) -> tuple[DataFrame, DataFrame]:
    """(pieces, results): the contents that a plan creates and updates, and one row a file (path, action, strategy,
    bytes_written, literal_bytes, transferred_bytes, error).

    Files are routed once (route()). Each goes as operations: a whole one as its pieces, a sparse one as what isn't zero,
    a changed one as a delta against the destination. Operations are written once; contents are built from them and the
    destination, as on the receiving side, and compared with the source by checksum. bytes_written is the content's size,
    literal_bytes what the operations carry, transferred_bytes the same after the codec that size, name and a probe choose.
    error tells of what came out otherwise than it went in.
    """
    routed = stored(route(src, dst, plan, width, local, limit, local_small))
    going = lambda strategy: src.join(routed.where(F.col("strategy") == strategy).select("path"), "path", "left_semi")
    base = pieces.pieces(dst.join(routed.where("strategy = 'delta'").select("path"), "path", "left_semi"), piece)
    whole = pieces.pieces(going("full"), piece).select("path", F.col("off").alias("at"), F.lit("data").alias("op"), "off", "size", "data")
    groups = routed.where("strategy = 'delta' and size > 0").select("path", F.explode(F.expr(f"sequence(0L, (size - 1) div {piece * pieces.GROUP})")).alias("group"))
    delta = pieces.rolling_delta(pieces.pieces(going("delta"), piece, width - 1), base, width, groups)
    ops = stored(whole.unionByName(regions(pieces.pieces(going("sparse"), piece))).unionByName(delta))
    made = stored(pieces.apply_delta(base, ops, piece, routed.select("path", F.col("size").alias("n"))))
    probe = F.lit(None).cast("double")
    sent = ops.where("op = 'data'").join(routed.select("path", F.col("size").alias("whole")), "path")
    sent = sent.select("path", "size", compressed_size(F.col("data"), choose_codec(F.col("whole"), F.col("path"), probe, codec, local)).alias("sent"))
    moved = sent.groupBy("path").agg(F.sum("size").alias("literal_bytes"), F.sum("sent").alias("transferred_bytes"))
    want = src.join(routed.select("path"), "path", "left_semi").select("path", F.md5(F.col("content").cast("binary")).alias("want"))
    got = pieces.digests(made).select("path", "checksum", F.col("size").alias("written"))
    j = routed.join(moved, "path", "left").join(want, "path").join(got, "path", "left")
    zero = F.lit(0).cast("long")
    wrong = F.when(F.coalesce("written", zero) != F.col("size"), "size differs").when((F.col("size") > 0) & (F.col("checksum") != F.col("want")), "checksum differs")
    results = j.select("path", "action", "strategy", F.coalesce("written", zero).alias("bytes_written"), F.coalesce("literal_bytes", zero).alias("literal_bytes"), F.coalesce("transferred_bytes", zero).alias("transferred_bytes"), wrong.alias("error"))
    return made, results
