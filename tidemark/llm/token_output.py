"""Training-order materialisation: token ids at permuted places in fixed-stride shards."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import broadcast_if_small, materialise
from .tokens import byte_bpe

SCHEMA = "slot long, shard long, byte_offset long, n_tokens long, doc_ids array<long>, doc_starts array<long>, ids_crc32 long, ids binary"


def feistel(x: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0..n-1, for an array of numbers below n.

    A balanced Feistel network permutes the smallest 2^(2k) >= n numbers; a result of n or more is sent through again
    until it is below n (cycle-walking), which keeps it a permutation. Fewer than four passes are needed on average.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), x.astype(np.uint64).copy()
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            v = out[todo]
            left, right = v >> np.uint64(half), v & mask
            for r in range(rounds):
                f = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 0x100000001B3 + r * 0xD1B54A32D192ED03) % (1 << 64))
                f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((f ^ (f >> np.uint64(31))) & mask)
            out[todo] = (left << np.uint64(half)) | right
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def token_rows(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows (part, local_start, n, doc_id, ids): ids as unsigned 16-bit numbers, and where they begin among the task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, at = byte_bpe(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                piece, starts, ns, raw = b.slice(lo, 1024), [], [], []
                for text in piece.column(1):
                    ids = np.append(bpe.ids(text.as_py()), np.uint32(end_id))
                    if ids.max() > 0xFFFF:
                        raise ValueError("ids of a shard are 16-bit numbers, and this vocabulary has larger ones")
                    ids = ids.astype("<u2")
                    starts.append(at)
                    ns.append(len(ids))
                    raw.append(ids.tobytes())
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ns), pa.int32()), pa.array(starts, pa.int64()), pa.array(ns, pa.int64()), piece.column(0), pa.array(raw, pa.binary())], ["part", "local_start", "n", "doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "part int, local_start long, n long, doc_id long, ids binary")


def token_shards(docs: DataFrame, length: int = 1024, shard_slots: int = 1024, key: int = 20240607, tokenizer: str = "byte_bpe_50k.json", end_id: int = 50256) -> DataFrame:
    """One row for each sequence in training order: slot, shard, byte_offset in the shard, n_tokens, doc_ids and
    doc_starts of the documents in it, ids_crc32 and ids, a record of 2 * length bytes (little-endian 16-bit).

    The documents' ids, each document closed by end_id, make one stream in the order in which Spark reads the rows; it
    (so another layout of the files gives another stream; sort the table first to be free of that)
    is cut every `length` ids, and only the last sequence is filled up with end_id (n_tokens tells how far it goes).
    feistel() gives every sequence its slot. A partition holds a range of whole shards in slot order, so that a shard is
    written and read as one run, and a reader that stopped after slot s goes on at s + 1. Null and empty texts are
    end_id alone. Repeated rows are kept. No rows: no sequences. Ids must be below 65,536.

    Tokens are computed once, and written; the start of a task's stream is a running sum over one row per task. Each
    piece then moves once, straight to the partition of its slot, whose size does not depend on the documents.
    """
    spark = docs.sparkSession
    tokens = materialise(token_rows(docs, tokenizer, end_id), "tokens")
    parts = tokens.groupBy("part").agg(F.sum("n").alias("part_n"))
    parts = parts.withColumn("part_start", F.sum("part_n").over(Window.orderBy("part")) - F.col("part_n"))
    total = parts.agg(F.sum("part_n")).first()[0] or 0
    n = -(-total // length)
    n_shards = max(1, -(-n // shard_slots))
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    per_part = -(-n_shards // wanted) * shard_slots
    n_parts = max(1, -(-n // per_part))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for start, doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                raw = ids.as_buffer()
                size, at = len(raw) // 2, 0
                while at < size:
                    seq, offset = divmod(start + at, length)
                    take = min(length - offset, size - at)
                    out.append((seq, offset, doc, at, raw[2 * at : 2 * (at + take)].to_pybytes()))
                    at += take
            if out:
                seq, offset, doc, at, raw = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(feistel(np.array(seq, np.int64), n, key)), pa.array(offset, pa.int32()), pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(raw, pa.binary())], ["slot", "offset", "doc_id", "start", "ids"])

    placed = tokens.join(broadcast_if_small(parts, 1_000_000), "part").select((F.col("part_start") + F.col("local_start")).alias("at"), "doc_id", "ids")
    pieces = placed.mapInArrow(cut, "slot long, offset int, doc_id long, start long, ids binary")
    ranged = pieces.repartitionById(n_parts, F.expr(f"cast(slot div {per_part} as int)")).sortWithinPartitions("slot", "offset")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def close():
            slot, raw = held[0][0], b"".join(h[3] for h in held)
            full = raw + np.full(length - len(raw) // 2, end_id, "<u2").tobytes()
            out.append((slot, slot // shard_slots, slot % shard_slots * 2 * length, len(raw) // 2, [h[1] for h in held], [h[2] for h in held], zlib.crc32(full), full))

        def batch():
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            for slot, doc, start, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if held and held[0][0] != slot:
                    close()
                    held = []
                held.append((slot, doc, start, raw))
            if len(out) >= 512:
                yield batch()
                out.clear()
        if held:
            close()
        if out:
            yield batch()

    return ranged.mapInArrow(records, SCHEMA)


def write_token_shards(shards: DataFrame, uri: str) -> DataFrame:
    """Write each shard of token_shards() to one raw file `shard-<number>.bin` under uri (file:, s3:, hdfs: or gs:), and
    return rows (shard, path, records, first_slot). A file appears whole, by a move from another
    name (a rename, or a copy on object stores); a task that runs again writes the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        shard = out = temp = None
        n = first = 0
        done: list[tuple] = []

        def close():
            out.close()
            final = f"{root}/shard-{shard:08d}.bin"
            store.move(temp, final)
            done.append((shard, final, n, first))

        for b in batches:
            for slot, at, record in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if at != shard:
                    if out is not None:
                        close()
                    shard, n, first, temp = at, 0, slot, f"{root}/.shard-{at:08d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(temp)
                out.write(record)
                n += 1
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["shard", "path", "records", "first_slot"])

    return shards.select("slot", "shard", "ids").mapInArrow(run, "shard long, path string, records long, first_slot long")


def read_token_shard(uri: str, shard: int, length: int = 1024, from_record: int = 0) -> Iterator[np.ndarray]:
    """The sequences of one raw shard, from a record on."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    with store.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
        f.seek(from_record * 2 * length)
        while raw := f.read(2 * length):
            yield np.frombuffer(raw, "<u2")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_shards() of all documents: sequences of 1,024 ids of byte_bpe_50k.json, 1,024 in a shard."""
    return token_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
