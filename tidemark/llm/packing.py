"""Packing documents into training sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .shared import small_batches
from .tokens import byte_bpe

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: (doc_id, start, ids, number of the document's ids)
Piece = tuple


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of the given lengths whose sum comes closest to room, from below; {} if none fits.

    Bit i of a whole number stands for a reachable sum i. A length with several copies enters as 1, 2, 4, ... copies.
    Long lengths first; the search ends as soon as room itself is reached. Going back through the states gives the counts.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, lot = min(counts[length], room // length), 1
        while left:
            lot = min(lot, left)
            steps.append((reach, length, lot))
            reach |= (reach << (length * lot)) & mask
            left, lot = left - lot, lot * 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, defaultdict(int)
    for before, length, lot in reversed(steps):
        if not before >> at & 1:
            chosen[length] += lot
            at -= length * lot
    return dict(chosen)


class Pool:
    """Remainders, shorter than a sequence, that wait for a place."""

    def __init__(self, capacity: int):
        self.capacity, self.by_length, self.n, self.total = capacity, defaultdict(list), 0, 0

    def add(self, piece: Piece) -> None:
        self.by_length[len(piece[2])].append(piece)
        self.n, self.total = self.n + 1, self.total + len(piece[2])

    def take(self, length: int) -> Piece:
        pieces = self.by_length[length]
        piece = pieces.pop()
        if not pieces:
            del self.by_length[length]
        self.n, self.total = self.n - 1, self.total - length
        return piece

    def fill(self, room: int) -> list[Piece]:
        """Pieces that fill room to the last place: the longest, the best multiset beside it, and, where slack is left,
        the head of one more piece, whose tail waits on. The pool must hold room tokens at least."""
        fitting = [x for x in self.by_length if x <= room]
        out = [self.take(max(fitting))] if fitting else []
        slack = room - sum(len(p[2]) for p in out)
        for length, times in (fullest({k: len(v) for k, v in self.by_length.items()}, slack) if slack else {}).items():
            out += [self.take(length) for _ in range(times)]
            slack -= length * times
        while slack:
            doc, start, ids, n = self.take(max(self.by_length))
            out.append((doc, start, ids[:slack], n))
            if len(ids) > slack:
                self.add((doc, start + slack, ids[slack:], n))
            slack -= min(slack, len(ids))
        return out


def pack(documents: Iterator[tuple], capacity: int, window: int) -> Iterator[list[Piece]]:
    """Sequences, as lists of pieces, from (doc_id, ids) of one task.

    Full sequences of a long document leave at once. Remainders wait in a window; when it is full, all but a quarter of
    them is packed, so that the next ones have a choice of partners. At the end less than a sequence is left; it goes
    into sequences whose lengths are the powers of two in its sum. So nothing is padded.
    """
    pool = Pool(capacity)
    for doc, ids in documents:
        n, cut = len(ids), len(ids) - len(ids) % capacity
        for start in range(0, cut, capacity):
            yield [(doc, start, ids[start : start + capacity], n)]
        if cut < n:
            pool.add((doc, cut, ids[cut:], n))
        if pool.n >= window:
            while pool.n > window // 4 and pool.total >= capacity:
                yield pool.fill(capacity)
    while pool.total:
        yield pool.fill(min(capacity, 1 << (pool.total.bit_length() - 1)))


def pack_documents(docs: DataFrame, capacity: int = 1024, window: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds the ids,
    as little-endian unsigned 32-bit integers.

    A document is its ids and then end_id; null and empty texts are end_id alone. Repeated rows are packed each on its
    own. Tasks pack what they read and nothing is shuffled; sequence_id is unique over all tasks, as it holds the task's
    partition. A task that is run again gives the same rows for the same input.
    capacity must be a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, first = byte_bpe(tokenizer), TaskContext.get().partitionId() << 40

        def documents():
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                    yield doc, np.append(bpe.ids(text.as_py()), np.uint32(end_id)).astype("<u4")

        rows: list[tuple] = []
        for k, sequence in enumerate(pack(documents(), capacity, window)):
            offset = 0
            for doc, start, ids, n in sequence:
                raw = ids.tobytes()
                rows.append((doc, start, len(ids), zlib.crc32(raw), n, first + k, offset, *([raw] * with_ids)))
                offset += len(ids)
            if len(rows) >= 8192:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns, names = list(zip(*rows)), [x.split()[0] for x in SCHEMA.split(", ")]
        arrays = [pa.array(c, pa.int64()) for c in columns[: len(names)]]
        if with_ids:
            arrays, names = [*arrays, pa.array(columns[-1], pa.binary())], [*names, "ids"]
        return pa.RecordBatch.from_arrays(arrays, names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA + ", ids binary" * with_ids)


def op10_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_documents() of all documents into sequences of 1,024 ids of byte_bpe_50k.json."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
