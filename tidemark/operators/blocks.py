"""Checksums, block tables, deltas, data regions and compression choices."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import basename

# Name endings of files that are compressed already.
COMPRESSED = (
    "jpg", "jpeg", "png", "gif", "webp", "avif", "heic", "heif", "mp4", "mkv", "avi", "mov", "webm", "m4v", "flv", "wmv", "mp3", "m4a", "aac", "ogg",
    "opus", "flac", "wma", "zip", "gz", "bz2", "xz", "7z", "rar", "tar.gz", "tgz", "tar.bz2", "pdf", "docx", "xlsx", "pptx", "wasm", "br", "zst",
)


def checksum(content: Column, kind: str) -> Column:
    """none: null; fast: 64-bit xxHash; md5; cryptographic: SHA-256, as lower-case hex."""
    kinds = {"none": F.lit(None).cast("string"), "fast": F.lower(F.hex(F.xxhash64(content))), "md5": F.md5(content), "cryptographic": F.sha2(content, 256)}
    return kinds[kind]


def checksum_hex(value: Column) -> Column:
    return F.coalesce(value, F.lit("none"))


def block_size(size: Column) -> Column:
    """The square root of the size, from 512 to 131,072."""
    return F.least(F.greatest(F.floor(F.sqrt(size)), F.lit(512)), F.lit(131072)).cast("long")


def adler32(content: Column) -> Column:
    """Adler-32 of a binary column; null stays null."""

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else zlib.adler32(b)).astype("Int64")

    return run(content)


def block_table(df: DataFrame, size: int | Column, weak: bool = False) -> DataFrame:
    """Rows (path, idx, off, size, strong[, weak], data) of fixed blocks of the binary content; the last may be shorter,
    and empty content has none."""
    width = F.lit(size).cast("long") if isinstance(size, int) else size.cast("long")
    of = df.select("path", F.col("content").cast("binary").alias("content"), width.alias("width")).where(F.octet_length("content") > 0)
    last = F.floor((F.octet_length("content") - 1) / F.col("width")).cast("long")
    rows = of.select("path", "content", "width", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("idx")).withColumn("off", F.col("idx") * F.col("width"))
    rows = rows.withColumn("data", F.expr("substring(content, cast(off + 1 as int), cast(width as int))"))
    out = rows.select("path", "idx", "off", F.octet_length("data").cast("long").alias("size"), F.md5("data").alias("strong"), "data")
    return out.withColumn("weak", adler32(F.col("data"))) if weak else out


def block_hashes(df: DataFrame, size: int) -> DataFrame:
    """Rows (path, n, hashes): the content's length in bytes, and the MD5 of each of its blocks in order. Blocks are hashed
    where the content is read, so that what is joined or grouped after it holds 32 characters a block."""
    of = df.select("path", F.col("content").cast("binary").alias("content")).withColumn("n", F.octet_length("content").cast("long"))
    hashes = F.expr(f"transform(sequence(0, cast((n - 1) div {size} as int)), i -> md5(substring(content, cast(i * {size} + 1 as int), {size})))")
    return of.select("path", "n", F.when(F.col("n") > 0, hashes).otherwise(F.array().cast("array<string>")).alias("hashes"))


def _sides(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """Rows (path, x_n, x, y_n, y) of paths on both sides."""
    one = lambda df, c: block_hashes(df, size).select("path", F.col("n").alias(f"{c}_n"), F.col("hashes").alias(c))
    return one(a, "x").join(one(b, "y"), "path")


def verify_blocks(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """Rows (path, idx, expected, actual) of blocks that differ or that one side lacks, for paths on both sides."""
    met = _sides(a, b, size).select("path", F.posexplode(F.arrays_zip(F.col("x").alias("expected"), F.col("y").alias("actual"))).alias("idx", "z"))
    rows = met.select("path", F.col("idx").cast("long").alias("idx"), F.col("z.expected").alias("expected"), F.col("z.actual").alias("actual"))
    return rows.where(~F.col("expected").eqNullSafe(F.col("actual")))


def block_diff(src: DataFrame, dst: DataFrame, size: int) -> DataFrame:
    """Rows (path, blocks, changed, literal_bytes) for paths on both sides: source blocks whose like-numbered destination
    block differs or is missing, and their bytes. An empty source gives no row."""
    met = _sides(src, dst, size).where("x_n > 0").withColumn("other", F.expr("filter(sequence(0, size(x) - 1), i -> not (x[i] <=> get(y, i)))"))
    literal = F.expr(f"aggregate(other, 0L, (t, i) -> t + least({size}L, x_n - i * {size}L))")
    return met.select("path", F.size("x").cast("long").alias("blocks"), F.size("other").cast("long").alias("changed"), literal.alias("literal_bytes"))


#: Destination paths, each with the hashes of its sampled blocks, that are broadcast.
BROADCAST_PATHS = 50_000


def sampled_hashes(df: DataFrame, size: int, samples: int) -> DataFrame:
    """Rows (path, n, blocks, places, hashes): the numbers of evenly spaced blocks of the content and their MD5s. Places may
    repeat, as a step is a whole number of blocks."""
    of = df.select("path", F.col("content").cast("binary").alias("content")).withColumn("n", F.octet_length("content").cast("long"))
    of = of.withColumn("blocks", F.expr(f"(n + {size - 1}) div {size}")).withColumn("k", F.least(F.lit(samples).cast("long"), "blocks"))
    step = F.when(F.col("k") > 1, F.expr("blocks div (k - 1)")).otherwise(0)
    places = F.when(F.col("k") > 0, F.expr("transform(sequence(0L, k - 1), i -> cast(least(i * step, blocks - 1) as int))")).otherwise(F.array().cast("array<int>"))
    of = of.withColumn("step", step).withColumn("places", places)
    return of.select("path", "n", "blocks", "places", F.expr(f"transform(places, i -> md5(substring(content, i * {size} + 1, {size})))").alias("hashes"))


def change_ratio(src: DataFrame, dst: DataFrame, size: int, samples: int = 20, threshold: float = 0.75, broadcast_paths: int = BROADCAST_PATHS) -> DataFrame:
    """Rows (path, ratio, samples, use_delta) for paths on both sides: the share of evenly spaced destination blocks that
    differ from the source's. Where the sizes differ by more than half of the destination's, the difference itself.

    A destination's size says which blocks are looked at, so it hashes these alone. Up to broadcast_paths of such rows go to
    the sources, which hash the same blocks where they are read, and none where the sizes decide; no content moves. Of more
    paths each source hashes its blocks, as moving contents to their samples would cost more, and the hashes are joined.
    """
    asked = sampled_hashes(dst, size, samples).select("path", F.col("n").alias("ds"), F.col("places"), F.col("hashes").alias("y"))
    ss, ds = F.col("ss"), F.col("ds")
    apart = F.when(ds == 0, F.when(ss == 0, 0.0).otherwise(1.0)).otherwise(F.abs(ss - ds) / ds)
    quick = (apart > 0.5) | (ds == 0)
    if dst.select("path").limit(broadcast_paths + 1).count() <= broadcast_paths:
        of = src.select("path", F.col("content").cast("binary").alias("content")).withColumn("ss", F.octet_length("content").cast("long"))
        j = of.join(F.broadcast(asked), "path").withColumn("quick", quick).withColumn("apart", apart)
        own = F.expr(f"transform(if(quick, array(), places), i -> if(i * {size}L < ss, md5(substring(content, i * {size} + 1, {size})), null))")
        j = j.select("path", "ss", "ds", "places", "y", "quick", "apart", own.alias("x"))
    else:
        j = block_hashes(src, size).select("path", F.col("n").alias("ss"), F.col("hashes").alias("all")).join(asked, "path").withColumn("quick", quick).withColumn("apart", apart)
        j = j.withColumn("x", F.expr("transform(places, i -> get(`all`, i))"))
    differ = F.size(F.expr("filter(sequence(0, size(places) - 1), i -> not (x[i] <=> y[i]))"))
    out = j.select("path", F.when(F.col("quick"), F.least("apart", F.lit(1.0))).otherwise(differ / F.size("places")).alias("ratio"), F.when(F.col("quick"), 0).otherwise(F.size("places")).cast("long").alias("samples"))
    return out.withColumn("use_delta", F.col("ratio") <= threshold)


def choose_strategy(df: DataFrame, small: int = 4096, local_small: int = 10 << 20, is_local: bool = True, limit: float = 0.75) -> DataFrame:
    """df (dst_size, is_sparse, ratio) with `strategy`: full, sparse or delta."""
    floor = local_small if is_local else small
    return df.withColumn("strategy", F.when(F.col("dst_size").isNull(), "full").when(F.col("dst_size") < floor, "full").when(F.col("is_sparse"), "sparse").when(F.col("ratio") > limit, "full").otherwise("delta"))


def weak_sums(x: np.ndarray, width: int) -> np.ndarray:
    """The two sums of Adler's checksum, without its modulus, in 16 and 32 bits, of all runs of `width` bytes."""
    sums, steps = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * np.arange(len(x)))])
    a = sums[width:] - sums[:-width]
    b = np.arange(width, len(x) + 1) * a - (steps[width:] - steps[:-width])
    return (a & 0xFFFF) | ((b & 0xFFFFFFFF) << 16)


def block_sums(x: np.ndarray, width: int) -> np.ndarray:
    """weak_sums() of the blocks of `width` bytes that x is made of."""
    rows = x.reshape(-1, width).astype(np.int64)
    return (rows.sum(axis=1) & 0xFFFF) | ((rows @ np.arange(width, 0, -1) & 0xFFFFFFFF) << 16)


def places_of(x: np.ndarray, width: int, sums: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The places of x where weak_sums() is among sums, which are ordered; low tells which low halves the second parts of these
    have. Sums are taken in 32 bits, where what runs over doesn't count."""
    x = x.astype(np.uint32)
    s, t = np.zeros(len(x) + 1, np.uint32), np.zeros(len(x) + 1, np.uint32)
    np.cumsum(x, out=s[1:], dtype=np.uint32)
    np.cumsum(x * np.arange(len(x), dtype=np.uint32), out=t[1:], dtype=np.uint32)
    a = s[width:] - s[:-width]
    b = np.arange(width, len(x) + 1, dtype=np.uint32) * a - (t[width:] - t[:-width])
    at = np.flatnonzero(low[b & np.uint32(0xFFFF)])
    weak = (a[at] & 0xFFFF).astype(np.int64) | (b[at].astype(np.int64) << 16)
    return at[sums[np.minimum(np.searchsorted(sums, weak), len(sums) - 1)] == weak]


def delta(source: bytes, base: bytes, width: int, piece: int = 1 << 20) -> Iterator[tuple[str, int, int, bytes | None]]:
    """Operations (op, off, size, data) that rebuild source from base: from left to right a block that base has becomes
    a copy of its first such block, and everything else literal bytes; a rest shorter than a block may match base's last.

    Weak sums of all places come from prefix sums, over one piece of the source after another, so that memory beside the
    two contents does not grow with them; only places whose sum base has are looked at further."""
    blocks: dict[bytes, int] = {}
    for off in range(0, len(base), width):
        blocks.setdefault(base[off : off + width], off)
    n, at, begun = len(source), 0, 0
    full = np.frombuffer(base, np.uint8, len(base) // width * width).reshape(-1, width)
    known = np.unique(np.concatenate([np.empty(0, np.int64), *(weak_sums(np.ascontiguousarray(full[lo : lo + 1024]).ravel().astype(np.int64), width)[::width] for lo in range(0, len(full), 1024))]))
    for lo in range(0, n - width + 1 if len(known) else 0, piece):
        x = np.frombuffer(source, np.uint8)[lo : lo + piece + width - 1].astype(np.int64)
        for p in (lo + np.flatnonzero(np.isin(weak_sums(x, width), known))).tolist():
            if p >= at and source[p : p + width] in blocks:
                if begun < p:
                    yield "data", begun, p - begun, source[begun:p]
                yield "copy", blocks[source[p : p + width]], width, None
                at = begun = p + width
    tail = next((t for t in range(max(at, n - width + 1), n) if source[t:] in blocks), n) if len(base) % width else n
    if begun < tail:
        yield "data", begun, tail - begun, source[begun:tail]
    if tail < n:
        yield "copy", blocks[source[tail:]], n - tail, None


OPS = "path string, op_idx long, op string, off long, size long, data binary"


def rolling_delta(src: DataFrame, dst: DataFrame, width: int = 512) -> DataFrame:
    """Rows (path, op_idx, op, off, size, data) for every source path; without a destination all is literal, and an empty
    source has no operations."""
    one = lambda df, c: df.select("path", F.col("content").cast("binary").alias(c))
    j = one(src, "s").join(one(dst, "d"), "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, s, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                rows += [(path, i, *op) for i, op in enumerate(delta(s or b"", d or b"", width))]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["path", "op_idx", "op", "off", "size", "data"])

    return j.mapInArrow(run, OPS)


def apply_delta(base: DataFrame, ops: DataFrame) -> DataFrame:
    """Rows (path, content, n_ops, literal_bytes, size) rebuilt from the base's content; a copy without a base fails. The
    operations of a path are gathered first, so that its base is joined once."""
    of = ops.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("op_idx", "op", "off", "size", "data"))).alias("ops"))
    j = of.join(base.select("path", F.col("content").cast("binary").alias("base")), "path", "left").select("path", "ops", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                path, ops, old = (b.column(c)[i].as_py() for c in range(3))
                if old is None and any(o["op"] == "copy" for o in ops):
                    raise ValueError(f"{path}: copy without a base")
                parts = [o["data"] if o["op"] == "data" else old[o["off"] : o["off"] + o["size"]] for o in ops]
                literal = sum(o["size"] for o in ops if o["op"] == "data")
                row = (path, b"".join(parts), len(ops), literal, sum(o["size"] for o in ops))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["path", "content", "n_ops", "literal_bytes", "size"])

    return j.mapInArrow(run, "path string, content binary, n_ops long, literal_bytes long, size long")


def write_delta(ops: DataFrame, path: str) -> None:
    """The operations of rolling_delta() as a table in zstd-compressed parquet, to be applied elsewhere or later."""
    ops.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_delta(spark: SparkSession, path: str) -> DataFrame:
    """Operations that write_delta() left, for apply_delta()."""
    return spark.read.schema(OPS).parquet(path)


def delta_ratio(ops: DataFrame) -> DataFrame:
    """Rows (path, literal, copied, ratio, percent); the ratio of nothing is 1 and its percentage null."""
    s = lambda op: F.coalesce(F.sum(F.when(F.col("op") == op, F.col("size"))), F.lit(0)).alias({"data": "literal", "copy": "copied"}[op])
    total = F.col("literal") + F.col("copied")
    return ops.groupBy("path").agg(s("data"), s("copy")).select("path", "literal", "copied", F.when(total == 0, 1.0).otherwise(F.col("literal") / total).alias("ratio"), F.when(total > 0, F.col("literal") * 100.0 / total).alias("percent"))


def zero_blocks(df: DataFrame, size: int = 4096) -> DataFrame:
    """Rows (path, idx, off, size, is_zero)."""
    return block_table(df, size).select("path", "idx", "off", "size", (F.regexp_replace(F.hex("data"), "0", "") == "").alias("is_zero"))


def data_regions(blocks: DataFrame) -> DataFrame:
    """Rows (path, off, length) of the longest runs of blocks (path, idx, off, size, is_zero) that aren't zero."""
    island = F.col("idx") - F.row_number().over(Window.partitionBy("path").orderBy("idx"))
    return blocks.where("not is_zero").withColumn("island", island).groupBy("path", "island").agg(F.min("off").alias("off"), F.sum("size").alias("length")).drop("island")


def rebuild_sparse(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (path, content) from regions (path, off, data) and sizes (path, size), with zeros between."""
    of = sizes.join(regions.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("off", "data"))).alias("r")), "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for size, regions in zip(b.column("size").to_pylist(), b.column("r").to_pylist()):
                content = bytearray(size)
                for x in regions or []:
                    content[x["off"] : x["off"] + len(x["data"])] = x["data"]
                out.append(bytes(content))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.binary())], ["path", "content"])

    return of.select("path", "size", "r").mapInArrow(run, "path string, content binary")


def is_compressed(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]*)$", 1)).isin(*COMPRESSED)


def choose_codec(size: Column, path: Column, ratio: Column, mode: str = "auto", is_local: bool = False) -> Column:
    """none, lz4 or zstd. Local transfers need none; `always` and `never` decide next; small and compressed files need
    none; `extension` then says zstd, and `auto` does where the probe came below 0.9 or is missing."""
    if mode not in ("auto", "extension", "always", "never"):
        raise ValueError(f"unknown mode {mode}")
    if is_local or mode == "never":
        return F.lit("none")
    if mode == "always":
        return F.lit("zstd")
    none = (size < 1 << 20) | is_compressed(path)
    rest = F.lit("zstd") if mode == "extension" else F.when(ratio.isNull() | (ratio < 0.9), "zstd").otherwise("none")
    return F.when(none, "none").otherwise(rest)


def compressibility(content: Column, sample: int = 65536) -> Column:
    """Compressed size (LZ4 and 4 bytes of length) of the first bytes over their number; 1 for empty or null content."""

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        codec = pa.Codec("lz4_raw")
        return values.map(lambda b: (codec.compress(b, asbytes=True).__len__() + 4) / len(b) if b else 1.0).astype(float)

    return run(F.substring(content.cast("binary"), 1, sample))


def _bloom_columns(column: str, n: int, bits_per_key: int) -> tuple[Column, list[Column]]:
    """The 512-bit block of a value, and the bits it sets there as eight words: seven places of nine hash bits each."""
    value = F.col(column)
    block = F.pmod(F.xxhash64(F.lit(1), value), F.lit(max(1, -(-n * bits_per_key // 512))))
    places = [F.shiftrightunsigned(F.xxhash64(value), 9 * i).bitwiseAND(511) for i in range(7)]
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(64)).cast("int"))
    words = []
    for w in range(8):
        of = [F.when(F.floor(p / 64) == w, bit(p)).otherwise(F.lit(0).cast("long")) for p in places]
        words.append(functools.reduce(lambda x, y: x.bitwiseOR(y), of))
    return block, words


def bloom_build(df: DataFrame, column: str, n: int, bits_per_key: int = 10) -> DataFrame:
    """A blocked Bloom filter of n values as rows (block, w0 to w7): one aggregate with partial sums, nothing collected.
    About one false positive in a hundred, no false negative."""
    block, words = _bloom_columns(column, n, bits_per_key)
    rows = df.where(F.col(column).isNotNull()).select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])


def bloom_filter(df: DataFrame, column: str, bloom: DataFrame, n: int, bits_per_key: int = 10) -> DataFrame:
    """df with `maybe`: false only where the value was surely not among the n of the filter."""
    block, words = _bloom_columns(column, n, bits_per_key)
    b = bloom.select(F.col("block").alias("__block"), *[F.col(f"w{i}").alias(f"__w{i}") for i in range(8)])
    j = df.join(b, block == F.col("__block"), "left")
    held = functools.reduce(lambda x, y: x & y, [F.col(f"__w{i}").bitwiseAND(w) == w for i, w in enumerate(words)])
    return j.select(*df.columns, F.coalesce(held, F.lit(False)).alias("maybe"))
