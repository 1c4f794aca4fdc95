"""Quality classifier by compression with a dictionary of good text and one of bad text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches

PIECE = 2048
DICTIONARY = 65536
#: Bytes added to a text's length where sizes are normalised, so that a few words decide little.
DAMP = 64
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text is divisible by 5. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def pieces(text: bytes) -> list[bytes]:
    """The whole text in pieces; a dictionary weighs the same in each, however long the text is."""
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


def dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary from the samples, or, where they are too few to train one, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content)
    d.precompute_compress(level=3)
    return zstandard.ZstdCompressor(dict_data=d, level=3, write_content_size=False, write_checksum=False, write_dict_id=False)


def difference(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """(compressed size with the bad dictionary - with the good one) / (length + DAMP); 0 for the empty text."""
    d = sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces(text))
    return d / (len(text) + DAMP)


def shortness(text: bytes) -> float:
    """From 1 for the empty text to 0: how little the text can say against what most texts are."""
    return DAMP / (len(text) + DAMP)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of P(y = 1 | x), the last for the constant, by Newton steps; columns are expected near unit scale."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - p) - ridge * w
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(a.shape[1]), grad)
        w = w + np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    return w


@dataclass
class Model:
    """Two dictionaries, and the curve over a text's difference and shortness."""

    good: bytes
    bad: bytes
    slope: float
    short: float
    intercept: float

    def score(self, d: float, short: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * d + self.short * short + self.intercept))))

    def scorer(self):
        """A function that scores a text; a null one counts as empty."""
        good, bad = (compressor(self.good), compressor(self.bad)) if self.good and self.bad else (None, None)

        def run(text: str | None) -> float:
            raw = (text or "").encode("utf-8", "replace")
            return self.score(difference(raw, good, bad) if good else 0.0, shortness(raw))

        return run


def fit(rows: list[tuple[int, str]]) -> Model:
    """From (label, text): dictionaries from all rows, and a logistic curve over shortness and the differences that each half
    of the rows got from dictionaries of the other half. With one label or none the score is that label's smoothed share."""
    rows = [(int(y), (t or "").encode("utf-8", "replace")) for y, t in rows]
    share = (sum(y for y, _ in rows) + 1) / (len(rows) + 2)

    def dictionaries(part):
        return [dictionary([p for y, t in part if y == label for p in pieces(t)]) for label in (1, 0)]

    halves = [rows[0::2], rows[1::2]]
    if any(len({y for y, _ in h}) < 2 for h in halves):
        if len({y for y, _ in rows}) < 2:
            return Model(b"", b"", 0.0, 0.0, math.log(share / (1 - share)))
        halves = [rows, rows]
    x, short, y = [], [], []
    for own, other in (halves, halves[::-1]):
        good, bad = map(compressor, dictionaries(other))
        x += [difference(t, good, bad) for _, t in own]
        short += [shortness(t) for _, t in own]
        y += [label for label, _ in own]
    x = np.array(x)
    scale = float(x.std()) or 1.0
    slope, of_short, intercept = logistic(np.column_stack([x / scale, short]), np.array(y, float))
    return Model(*dictionaries(rows), float(slope) / scale, float(of_short), float(intercept))


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1500) -> Model:
    """A model from at most per_label rows of each label, by the order of a hash of the id, with all their text.

    Held-out rows, rows without a label and labels other than 0 and 1 take no part. Repeated labels of an id: the least
    counts. The bound is what is collected; scoring reads everything.
    """
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    there = docs.select("doc_id").where(~held_out(F.col("doc_id"))).distinct().join(known, "doc_id")
    chosen = []
    for label in (0, 1):
        chosen += there.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id")).limit(per_label).select("doc_id", "quality").collect()
    if not chosen:
        return fit([])
    # 2 * per_label ids at most: the texts come to them without a shuffle
    ids = F.broadcast(docs.sparkSession.createDataFrame(chosen, there.select("doc_id", "quality").schema))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    text_of = {r[0]: r[1] for r in texts.collect()}
    rows = [(y, text_of[i]) for i, y in chosen]
    return fit(rows)


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of documents.

    A null text counts as empty, and gets the curve's value for the shortest. Only the text is looked at. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = model.scorer()
        for b in batches:
            score = [score_of(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    small_batches(docs.sparkSession)
    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return of.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of at least the threshold, with all their columns."""

    @F.pandas_udf("boolean")
    def good_enough(texts):
        score_of = model.scorer()
        return texts.map(lambda t: score_of(t) >= threshold).astype(bool)

    small_batches(docs.sparkSession)
    return docs.where(good_enough(F.col("text").cast("string")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_quality() of all documents, learnt from 1,500 labelled ones of each quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
