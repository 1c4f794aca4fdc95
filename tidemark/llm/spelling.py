"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists, and the form each goes back to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import broadcast_if_small, discard, materialise, small_batches

LETTERS = "A-Za-zÀ-ÿ"
_BREAK = re.compile(f"[^{LETTERS}]")
#: Characters of a text that are cut into words at a time, to the end of the word that is open there.
PIECE = 1 << 20
#: Different words that a task counts before it gives them out.
HELD = 200_000
#: Words that share a key, at most; larger groups are split by longer keys.
GROUP = 50_000
#: Hot keys that are broadcast; more meet the words in a shuffled join.
BROADCAST_KEYS = 1_000_000


def runs(text: str, least: int) -> Iterator[list[str]]:
    """Maximal runs of letters of at least that length, a piece of the text after another."""
    find = re.compile(f"[{LETTERS}]{{{least},}}").findall
    at = 0
    while at < len(text):
        end = at + PIECE
        stop = _BREAK.search(text, end) if end < len(text) else None
        end = stop.start() if stop else len(text)
        yield find(text if end - at == len(text) else text[at:end])
        at = end


def slips(doc_id: int | None, counted: Counter, every: int) -> Iterator[tuple[str, int]]:
    """The counted runs of a document; those whose crc32 with the id `every` divides lose one code point."""
    prefix = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for run, n in counted.items():
        h = zlib.crc32(run.encode(), prefix)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def count_words(docs: DataFrame, least_length: int = 6, least_n: int = 5, every: int = 199) -> DataFrame:
    """Rows (word, n): words of at least least_length code points that occur at least least_n times in all texts.

    A word is a maximal run `[A-Za-z\\u00C0-\\u00FF]+`, with A-Z as a-z, or that run without one code point where the hash of
    document and run says so. Null and empty texts have no words; repeated rows count each; a null id is hashed as no
    characters. Tasks give out sums over up to HELD different words; a word's sums meet in one shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = text.as_buffer()
                if raw is None or not len(raw):
                    continue
                counted: Counter = Counter()
                for found in runs(str(raw.to_pybytes().lower(), "utf-8", "replace"), least_length):
                    counted.update(found)
                for word, n in slips(doc_id, counted, every):
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    small_batches(docs.sparkSession)
    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return of.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def common_prefixes(key: np.ndarray, codes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each word the code points it shares with the word before it; -1 at the first word of a key. Words end in 0."""
    lcp = np.full(len(key), -1, np.int64)
    i, d = 1 + np.flatnonzero(key[1:] == key[:-1]), 0
    while len(i):
        c = codes[start[i] + d]
        lcp[i] = d
        i, d = i[(c == codes[start[i - 1] + d]) & (c != 0)], d + 1
    return lcp


def near_pairs(key: np.ndarray, codes: np.ndarray, start: np.ndarray, length: np.ndarray, query: np.ndarray, batch: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of words of one key that are exactly one edit apart: i is a query, and j no query or a later one.

    Words come sorted by key and code points, codes holds them with a 0 behind each. Every query scans its key's sorted list with
    the three middle cells of the edit matrix. Words that share a prefix are one range of the list and share its row; a range
    parts where adjacent words share no more than the depth; one whose row is over one edit throughout is skipped whole.
    Queries go side by side, one code point of the list's words at a time.
    """
    lcp = common_prefixes(key, codes, start)
    by_depth = np.argsort(lcp, kind="stable")
    depth_of = lcp[by_depth]
    first = np.flatnonzero(lcp == -1)
    group = np.cumsum(lcp == -1) - 1
    begin, end = first[group], np.append(first, len(key))[group + 1]
    queries = np.flatnonzero(query & (end - begin > 1))
    left, right = [], []
    for at in range(0, len(queries), batch):
        q = queries[at : at + batch]
        lo, hi = begin[q], end[q]
        # edits from the first d code points of the list's word to the first d - 1, d and d + 1 of the query's
        a, b, c = np.full(len(q), 2, np.int8), np.zeros(len(q), np.int8), np.ones(len(q), np.int8)
        d = 0
        while len(q):
            parts = by_depth[np.searchsorted(depth_of, d) : np.searchsorted(depth_of, d, "right")]
            if len(parts):
                x, y = np.searchsorted(parts, lo, "right"), np.searchsorted(parts, hi)
                n = y - x + 1
                if n.max() > 1:
                    of = np.repeat(np.arange(len(q)), n)
                    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                    edge = x[of] + nth
                    lo = np.where(nth == 0, lo[of], parts[np.minimum(np.maximum(edge - 1, 0), len(parts) - 1)])
                    hi = np.where(nth == n[of] - 1, hi[of], parts[np.minimum(edge, len(parts) - 1)])
                    q, a, b, c = q[of], a[of], b[of], c[of]
            ch, m = codes[start[lo] + d], length[q]
            ended = ch == 0
            if ended.any():
                edits = np.where(m == d, b, np.where(m == d - 1, a, np.where(m == d + 1, c, 2)))
                hit = ended & (edits == 1) & (~query[lo] | (lo > q))
                left.append(q[hit])
                right.append(lo[hit])
            s = start[q]
            other = lambda j: (codes[s + np.clip(j, 0, m)] != ch).astype(np.int8) if j >= 0 else np.ones(len(q), np.int8)  # noqa: B023, E731
            na = np.where(d <= m, np.minimum(a + other(d - 1), b + 1), 2)
            nb = np.where(d + 1 <= m, np.minimum(np.minimum(b + other(d), c + 1), na + 1), 2)
            nc = np.where(d + 2 <= m, np.minimum(c + other(d + 1), nb + 1), 2)
            alive = ~ended & (np.minimum(np.minimum(na, nb), nc) < 2)
            q, lo, hi = q[alive], lo[alive], hi[alive]
            a, b, c = (np.minimum(v[alive], 2).astype(np.int8) for v in (na, nb, nc))
            d += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def share_more(codes: np.ndarray, start: np.ndarray, length: np.ndarray, back: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether words i and j, read backwards where back says so, begin with the same `most` code points."""
    same = np.ones(len(i), bool)
    k, d = np.flatnonzero(most > 0), 0
    while len(k):
        at = lambda x: codes[start[x] + np.where(back[i[k]], length[x] - 1 - d, d)]  # noqa: B023, E731
        fits = np.minimum(length[i[k]], length[j[k]]) > d
        ok = fits & (at(i[k]) == at(j[k]))
        same[k[~ok]] = False
        d += 1
        k = k[ok & (most[k] > d)]
    return same


def neighbours(table: pa.Table) -> pa.RecordBatch | None:
    """Rows (word, n_near, near_n, near) over whole keys of sorted rows (key, w, n, short, back, below): how many words of its
    keys each is near to, and the most frequent of them, the first in code-point order of equals."""
    words = table["w"].to_pylist()
    key, n, short, back, below = (table[c].to_numpy() for c in ("key", "n", "short", "back", "below"))
    codes = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(length + 1) - length - 1
    i, j = near_pairs(key, codes, start, length, short)
    bound = below[i]
    own = ~((bound >= 0) & share_more(codes, start, length, back, i, j, np.maximum(bound, 0)))
    i, j = i[own], j[own]
    if not len(i):
        return None
    plain = [w[::-1] if r else w for w, r in zip(words, back.tolist())]
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=plain.__getitem__)] = np.arange(len(words))
    u, v = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((rank[v], -n[v], u))
    u, v = u[order], v[order]
    at = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    counts = np.diff(np.append(at, len(u)))
    return pa.RecordBatch.from_arrays(
        [pa.array([plain[x] for x in u[at].tolist()], pa.string()), pa.array(counts, pa.int64()), pa.array(n[v[at]], pa.int64()), pa.array([plain[x] for x in v[at].tolist()], pa.string())],
        ["word", "n_near", "near_n", "near"],
    )


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """neighbours() over about GROUP rows of whole keys at a time."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size < GROUP:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table["key"].to_numpy()
        last = int(np.searchsorted(key, key[-1]))  # where the key that may go on begins
        if last:
            if (out := neighbours(table.slice(0, last))) is not None:
                yield out
            held = table.slice(last).combine_chunks().to_batches()
            size = table.num_rows - last
    if size and (out := neighbours(pa.Table.from_batches(held).combine_chunks())) is not None:
        yield out


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, short, s, lo, hi, below) with their key: what words must have in common to be compared."""
    of = F.xxhash64("s", "lo", "hi", "below", F.substring("word", F.lit(1), F.col("lo")), F.substring("word", F.length("word") - F.col("hi") + 1, F.col("hi")))
    return rows.withColumn("key", of)


def _parted(rows: DataFrame) -> DataFrame:
    """Each row once with a longer common beginning and once with a longer common end.

    Two words one edit apart, the shorter of s code points, have s - 1 of these before and behind the edit. Of the middle
    that a key leaves open, half is thus the same before the edit or behind it. A pair with the first half in common
    belongs to the first row's key, and `below` keeps it from the other's.
    """
    half = ((F.col("s") - F.col("lo") - F.col("hi")) / 2).cast("int")
    to = F.col("lo") + half
    row = lambda lo, hi, below: F.struct(lo.alias("lo"), hi.alias("hi"), below.alias("below"))
    capped = F.when((F.col("below") >= 0) & (F.col("below") < to), F.col("below")).otherwise(to)
    both = F.array(row(to, F.col("hi"), F.col("below")), row(F.col("lo"), F.col("hi") + half, capped))
    return rows.select("word", "n", "short", "s", F.explode(both).alias("x")).select("word", "n", "short", "s", "x.*")


def near_words(vocabulary: DataFrame, group: int = GROUP) -> DataFrame:
    """Rows (word, n_near, near_n, near) for words of the vocabulary (word, n; words distinct) that have others one edit away.

    A word is compared with words of its own length and of one more. Keys are halves of words (_parted()); a key of more
    than `group` words is split again, as often as it takes: a key that leaves one code point open can't be split and holds
    at most the alphabet and its square. Keys are dealt out by hash and sorted; what leaves a task is one row a word and
    stretch of keys, so that frequent neighbours cost no more than rare ones.
    """
    spark = vocabulary.sparkSession
    small_batches(spark)
    long_as = F.array(F.struct(F.lit(True).alias("short"), F.length("word").alias("s")), F.struct(F.lit(False).alias("short"), (F.length("word") - 1).alias("s")))
    rows = vocabulary.select("word", "n", F.explode(long_as).alias("x")).select("word", "n", "x.*").where("s > 0")
    rows = rows.withColumns({"lo": F.lit(0), "hi": F.lit(0), "below": F.lit(-1)})
    work, ready = _keyed(_parted(rows)), []
    while True:
        hot = materialise(work.where("s - lo - hi > 1").groupBy("key").agg(F.count("*").alias("words")).where(F.col("words") > group).select("key"), "hot-keys")
        if hot.isEmpty():
            discard(hot)
            break
        few = broadcast_if_small(hot, BROADCAST_KEYS)
        ready.append(work.join(few, "key", "left_anti"))
        work = materialise(_keyed(_parted(work.join(few, "key", "left_semi").select("word", "n", "short", "s", "lo", "hi", "below"))), "split-keys")
    for r in ready:
        work = work.unionByName(r)
    back = F.col("hi") > F.col("lo")
    of = work.select("key", F.when(back, F.reverse("word")).otherwise(F.col("word")).alias("w"), "n", "short", back.alias("back"), "below")
    found = of.repartition("key").sortWithinPartitions("key", "w").mapInArrow(scan, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.m")).alias("near_n"), F.col("best.near").alias("near"))


def with_roots(forms: DataFrame) -> DataFrame:
    """Rows (word, form) with `root`: the last form that is reached from form to form. Each step doubles the distance;
    forms must not go in circles (here each is several times as frequent as the word before)."""
    at = materialise(forms.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("more")), "roots")
    while not at.where("more").isEmpty():
        nxt = at.select(F.col("word").alias("mid"), F.col("root").alias("far"))
        step = at.join(nxt, at["root"] == nxt["mid"], "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("more"))
        last, at = at, materialise(step, "roots")
        discard(last)
    return forms.join(at.drop("more"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(vocabulary: DataFrame, ratio: int = 5, group: int = GROUP) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one for each word of the vocabulary (word, n).

    A word's form is the near word (one code point inserted, deleted or replaced) of largest n, of equals the first in
    code-point order, if that n is at least ratio times its own; root follows forms to the last and is the word itself where
    there is none. An empty vocabulary gives no rows.
    """
    kept = materialise(vocabulary.select("word", "n"), "vocabulary")
    none = lambda kind: F.lit(None).cast(kind)
    rows = kept.select("word", "n", F.lit(0).cast("long").alias("n_near"), none("long").alias("near_n"), none("string").alias("near"))
    near = near_words(kept, group).select("word", none("long").alias("n"), "n_near", "near_n", "near")
    met = rows.unionByName(near).groupBy("word").agg(*[F.max(c).alias(c) for c in ("n", "n_near", "near_n", "near")])
    often: Column = F.col("near_n") >= F.col("n") * ratio
    out = materialise(met.select("word", F.when(often, F.col("near")).alias("form"), "n", "n_near", F.when(often, F.col("near_n")).alias("form_n")), "forms")
    return with_roots(out).select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spelling_variants() of the words of all documents: six code points, five occurrences, forms five times as frequent."""
    return spelling_variants(count_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))
