"""N-gram Jaccard join: documents whose shingle sets overlap enough, and their connected components."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import broadcast_if_small, connected_components, discard, materialise, small_enough
from .shingles import chunks, shingles

#: A threshold as (numerator, denominator): intersection / union >= numerator / denominator.
Ratio = tuple[int, int]
BROADCAST_IDS = 2_000_000
#: Cells of a histogram over elements beyond a prefix.
CELLS = 256
#: Elements of common lists in a tile of documents, about.
TILE_ELEMENTS = 2_000_000
#: How many times the rows of its longest list a bundle of lists may have.
WIDER = 4


def least_overlap(a, b, ratio: Ratio):
    """The smallest intersection with which sets of sizes a and b link."""
    num, den = ratio
    return -(-(num * (a + b)) // (num + den))


def prefix_length(n: int, ratio: Ratio) -> int:
    """Two sets that link share one of the first prefix_length(n) elements of either, in any common order."""
    return n + 1 - -(-ratio[0] * n // ratio[1]) if n else 0


def cells(elements: np.ndarray, times: int = 1) -> np.ndarray:
    return np.bincount(elements.astype(np.int64), minlength=times * CELLS)


def _lists(rows: list[np.ndarray], kind=np.int64) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(kind)))


ROW = "doc_id long, n long, k1 long, k2 long, prefix array<long>, rare int, rest binary"


def cut_row(own: np.ndarray, crowd: np.ndarray, ratio: Ratio) -> tuple[np.ndarray, int, bytes | None]:
    """(prefix, rare, rest) of a set's rare and common elements, both sorted."""
    p = prefix_length(len(own) + len(crowd), ratio)
    if len(own) >= p:
        return own[:p], p, None
    beyond = crowd[p - len(own) :]
    rest = cells(np.concatenate([own % CELLS, beyond % CELLS + np.uint64(CELLS)]), 2)
    return np.concatenate([own, crowd[: p - len(own)]]), len(own), rest.astype("<u4").tobytes()


def rows_of(docs: DataFrame, n: int, ratio: Ratio, common: np.ndarray) -> DataFrame:
    """Rows of the incidence matrix, cut to their prefix: doc_id, n (set size), k1 and k2 (128 bits that stand for the
    set), prefix, rare, rest. The order of elements is by hash, with the common ones after all others; the first `rare` of
    the prefix aren't common. Where others are, the prefix holds all rare ones, and rest counts these and the elements beyond the prefix by cells
    of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in chunks(b.column(1)):
                sizes, keys, cut = [], [], []
                for s in shingles(texts, n):
                    s = np.unique(s)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sizes.append(len(s))
                    is_common = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)
                    cut.append(cut_row(s[~is_common], s[is_common], ratio))
                k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                prefixes, rare, rest = zip(*cut)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array(sizes, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), _lists(prefixes), pa.array(rare, pa.int32()), pa.array(rest, pa.binary())], ["doc_id", "n", "k1", "k2", "prefix", "rare", "rest"])

    return docs.select("doc_id", "text").mapInArrow(run, ROW)


def rows_joined(docs: DataFrame, n: int, ratio: Ratio, common: DataFrame) -> DataFrame:
    """rows_of() with the common elements as a table (h) of any size, which meets the documents' elements in a join."""

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in chunks(b.column(1)):
                rows = [np.unique(s) for s in shingles(texts, n)]
                keys = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in rows)
                k = np.frombuffer(keys, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array(k[:, 0]), pa.array(k[:, 1]), _lists(rows)], ["doc_id", "k1", "k2", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part, cut, sizes = b.slice(lo, 256), [], []
                for own, crowd in zip(part.column("own"), part.column("crowd")):
                    own, crowd = (np.sort(x.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) for x in (own, crowd))
                    sizes.append(len(own) + len(crowd))
                    cut.append(cut_row(own, crowd, ratio))
                prefixes, rare, rest = zip(*cut)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), part.column("k1"), part.column("k2"), _lists(prefixes), pa.array(rare, pa.int32()), pa.array(rest, pa.binary())], ["doc_id", "n", "k1", "k2", "prefix", "rare", "rest"])

    of = docs.select("doc_id", "text").mapInArrow(elements, "doc_id long, k1 long, k2 long, h array<long>").select("doc_id", "k1", "k2", F.explode("h").alias("h"))
    marked = of.join(common.select("h", F.lit(True).alias("common")), "h", "left")
    own, crowd = (F.collect_list(F.when(c, F.col("h"))) for c in (F.col("common").isNull(), F.col("common").isNotNull()))
    return marked.groupBy("doc_id", "k1", "k2").agg(own.alias("own"), crowd.alias("crowd")).mapInArrow(run, ROW)


class Known:
    """A table (h) of common elements, in memory too where it has no more rows than the bound."""

    def __init__(self, table: DataFrame, most: int):
        self.table, self.most = table, most
        self.array = np.sort(np.array([r[0] for r in table.collect()], np.int64).view(np.uint64)) if small_enough(table, most) else None

    def both(self, more: "Known", write) -> "Known":
        return Known(write(self.table.unionByName(more.table), "common"), self.most)


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, elements): whole sets, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in chunks(b.column(1)):
                rows = [np.unique(s).tobytes() for s in shingles(texts, n)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array(rows, pa.binary())], ["doc_id", "elements"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, elements binary")


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with one of the ids; without moving the texts where the ids are few."""
    return docs.join(broadcast_if_small(ids.select("doc_id").distinct(), BROADCAST_IDS), "doc_id", "left_semi")


class Join:
    """One run of the join over distinct sets."""

    def __init__(self, docs: DataFrame, n: int, ratio: Ratio, crowd: int, max_common: int):
        self.docs, self.n, self.ratio, self.crowd, self.max_common = docs, n, ratio, crowd, max_common
        self.all = materialise(rows_of(docs, n, ratio, np.empty(0, np.uint64)), "rows")
        classes = self.all.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"))
        self.classes = materialise(classes, "classes")
        self.spent: list[DataFrame] = []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """materialise() of a table that nothing reads once the links are written."""
        self.spent.append(materialise(df, label))
        return self.spent[-1]

    def rows(self, docs: DataFrame, ratio: Ratio, common: Known) -> DataFrame:
        found = rows_of(docs, self.n, ratio, common.array) if common.array is not None else rows_joined(docs, self.n, ratio, common.table)
        return found.select("doc_id", "n", "prefix", "rare", "rest").dropDuplicates(["doc_id"])

    def prefixes(self) -> DataFrame:
        """Rows (doc_id, n, prefix, rare, rest) of one document for each set.

        A shingle that more than `crowd` prefixes hold is common, goes to the end of the order, and the documents whose
        prefix held it get the next ones in its place; what then turns out common follows, until nothing does. Rows
        that held none stay as they are, as their prefix is the same in the new order. So at the end no list of a rare
        element has more than `crowd` rows, however many elements are common.
        """
        first = self.all.join(self.classes.select("doc_id", "k1", "k2"), ["doc_id", "k1", "k2"]).select("doc_id", "n", "prefix", "rare", "rest").dropDuplicates(["doc_id"])
        common = Known(self.docs.sparkSession.createDataFrame([], "h long"), self.max_common)
        parts, turn = [(self.write(first, "prefixes"), 0)], 0  # with the turn that each was made in
        while True:
            new = self.crowded(parts[-1][0])
            if new.table.isEmpty():
                break
            touched = self.touched(parts, common, new)
            if turn:  # documents whose next elements are common as well: all of their elements are counted at once
                new = new.both(self.crowded(self.rows(only(self.docs, touched), (0, 1), common.both(new, self.write))), self.write)
                touched = self.touched(parts, common, new)
            common, turn = common.both(new, self.write), turn + 1
            parts.append((self.write(self.rows(only(self.docs, touched), self.ratio, common), "prefixes"), turn))
        return functools.reduce(DataFrame.unionByName, [self.holding(p, common, None) if made < turn else p for p, made in parts])

    def crowded(self, rows: DataFrame) -> Known:
        """Elements that more than `crowd` of the rows have among their rare ones."""
        of = rows.select(F.explode(F.slice("prefix", F.lit(1), F.col("rare"))).alias("h")).groupBy("h").count().where(F.col("count") > self.crowd)
        return Known(self.write(of.select("h"), "crowded"), self.max_common)

    def touched(self, parts: list[tuple[DataFrame, int]], common: Known, new: Known) -> DataFrame:
        return self.write(functools.reduce(DataFrame.unionByName, [self.holding(p, common, new) for p, _ in parts]), "touched")

    def holding(self, rows: DataFrame, without_of: Known, new_of: Known | None) -> DataFrame:
        """Rows with none of the elements `without` among their rare ones; with `new`, ids of those that hold one of these."""
        if without_of.array is None or (new_of is not None and new_of.array is None):
            of = rows.select("doc_id", F.explode(F.slice("prefix", F.lit(1), F.col("rare"))).alias("h"))
            ids = lambda table: of.join(table, "h", "left_semi").select("doc_id").distinct()
            kept = rows.join(ids(without_of.table), "doc_id", "left_anti")
            return kept.select("doc_id", "n", "prefix", "rare", "rest") if new_of is None else kept.join(ids(new_of.table), "doc_id", "left_semi").select("doc_id")
        without, new = without_of.array, None if new_of is None else new_of.array
        sent = self.docs.sparkSession.sparkContext.broadcast((without, new))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            without, new = sent.value
            for b in batches:
                prefix, rare = b.column("prefix"), b.column("rare").to_numpy(zero_copy_only=False)
                flat = prefix.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                starts = np.concatenate([[0], np.cumsum(prefix.value_lengths().to_numpy(zero_copy_only=False))])

                def hits(those):
                    hit = np.zeros(len(flat), np.int64)
                    if len(flat) and len(those):
                        hit[those[np.minimum(np.searchsorted(those, flat), len(those) - 1)] == flat] = 1
                    sums = np.concatenate([[0], np.cumsum(hit)])
                    return sums[starts[:-1] + rare] > sums[starts[:-1]]

                keep = ~hits(without)
                yield b.filter(pa.array(keep if new is None else keep & hits(new))).select(["doc_id"] if new is not None else ["doc_id", "n", "prefix", "rare", "rest"])

        return rows.mapInArrow(run, "doc_id long" if new is not None else "doc_id long, n long, prefix array<long>, rare int, rest binary")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose whole sets link, as the exact dot product of their rows."""
        pairs = self.write(pairs.select("a", "b"), "pairs")
        ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
        sets = self.write(sets_of(only(self.docs, ids), self.n).dropDuplicates(["doc_id"]), "sets")
        left = sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("x"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("y"))
        num, den = self.ratio

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = []
                for x, y in zip(b.column("x"), b.column("y")):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(den * both >= num * (len(x) + len(y) - both))
                kept = b.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

        return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")

    def rare_pairs(self, rows: DataFrame) -> DataFrame:
        """Candidates (a, b) that share rare elements of their prefixes.

        Blocks of the product are ranges of a hash of the element. Within an element's list, sorted by size, a pair is
        counted if its sizes allow a link; the counts of a pair are added up, and what they and the elements beyond the
        prefixes can reach at most is held against the least overlap.
        """
        num, den = self.ratio

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = [np.empty(0, np.int64)] * 4
            for b in batches:
                cols = [np.concatenate([o, b.column(i).to_numpy(zero_copy_only=False)]) for i, o in enumerate(held)]
                if not len(cols[0]):
                    continue
                cut = int(np.searchsorted(cols[0], cols[0][-1])) if cols[0][0] != cols[0][-1] else 0
                held = [c[cut:] for c in cols]
                yield from pairs([c[:cut] for c in cols])
            yield from pairs(held)

        def pairs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            h, doc, n, beyond = cols
            for d in range(1, len(h)):
                i = np.flatnonzero(h[d:] == h[:-d])
                if not len(i):
                    break
                i = i[den * n[i] >= num * n[i + d]]
                if len(i):
                    swap = doc[i] > doc[i + d]
                    a, b = np.where(swap, i + d, i), np.where(swap, i, i + d)
                    need = least_overlap(n[a], n[b], (num, den)) - np.maximum(beyond[a], beyond[b])
                    yield pa.RecordBatch.from_arrays([pa.array(doc[a]), pa.array(doc[b]), pa.array(need)], ["a", "b", "need"])

        # beyond: what a partner may share besides rare elements of this prefix
        of = rows.select(F.posexplode(F.slice("prefix", F.lit(1), F.col("rare"))).alias("pos", "h"), "doc_id", "n", (F.col("n") - F.col("rare")).alias("beyond"))
        sorted_rows = of.select("h", "doc_id", "n", "beyond").repartition("h").sortWithinPartitions("h", "n", "doc_id")
        found = sorted_rows.mapInArrow(run, "a long, b long, need long")
        return found.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("need").alias("need")).where("c >= need").select("a", "b")

    def common_rows(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows (h, doc_id, n), one for each common element that a prefix can't do without, and rows (doc_id, n, shared,
        rest), one for each document that has such elements."""
        wide = self.write(rows.where("rare < size(prefix)").select("doc_id", "n", F.slice("prefix", F.col("rare") + 1, F.size("prefix")).alias("shared"), "rest"), "wide")
        return self.write(wide.select(F.explode("shared").alias("h"), "doc_id", "n"), "lists"), wide

    def bundles(self, lists: DataFrame) -> DataFrame:
        """Rows (bundle, doc_id): every two documents of a list are in one bundle, and a document is in fewer bundles than
        lists where lists resemble each other, as those of long near copies do.

        A list goes to the smallest element that any of its documents has. Where that makes more than WIDER times the
        rows of the longest list, only lists of the very same documents go together.
        """
        least = lists.groupBy("doc_id").agg(F.min("h").alias("least"))
        per = lists.join(least, "doc_id").groupBy("h").agg(F.min("least").alias("home"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("doc_id")).alias("same"))
        per = self.write(per.where("m > 1"), "homes")
        held = lists.join(per.select("h", "home"), "h").select("home", "doc_id").distinct().groupBy("home").agg(F.count("*").alias("held"))
        fits = per.groupBy("home").agg(F.max("m").alias("longest")).join(held, "home").where(F.col("held") <= WIDER * F.col("longest"))
        named = per.join(fits.select("home", F.lit(True).alias("fits")), "home", "left").select("h", F.when(F.col("fits"), F.col("home")).otherwise(F.col("same")).alias("bundle"))
        return self.write(lists.join(named, "h").select("bundle", "doc_id").distinct(), "bundles")

    def pivot_pairs(self, lists: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
        """Candidates (a, b): in every list one document of the largest component stands for it, another in each turn,
        and meets the documents of all other components; as many pairs as rows."""
        of = lists.select("h", "doc_id", "n").join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        per = of.groupBy("h", "label").agg(F.count("*").alias("s"), F.min_by(F.struct("doc_id", "n"), F.xxhash64("doc_id", F.lit(turn))).alias("one"))
        top = per.groupBy("h").agg(F.max_by(F.struct("label", "one"), F.struct("s", "label")).alias("top"), F.count("*").alias("k")).where("k > 1")
        met = of.join(top, "h").where("label <> top.label")
        num, den = self.ratio
        fits = (F.col("n") * den >= F.col("top.one.n") * num) & (F.col("top.one.n") * den >= F.col("n") * num)
        return met.where(fits).select(F.least("doc_id", "top.one.doc_id").alias("a"), F.greatest("doc_id", "top.one.doc_id").alias("b")).distinct()

    def common_pairs(self, bundles: DataFrame, wide: DataFrame, labels: DataFrame, tile: int = 1024) -> DataFrame:
        """All candidates (a, b) of different components that share common elements of their prefixes.

        In a bundle only documents outside the largest component need to be compared, with all others. Both sides are cut
        into tiles by a hash of the id, of `tile` documents and TILE_ELEMENTS elements or so, and every two tiles meet in
        one group: there the product of the tiles' incidence rows, taken over blocks of elements, counts what two
        documents share, and the size-derived bound discards pairs or gives them out. What two documents share is at
        most, cell by cell, the fewer of their rare elements and the fewer of their common ones. Ids alone are
        bundled; each document's elements are fetched once for each two tiles that it is in.
        """
        of = bundles.join(wide.select("doc_id", F.size("shared").alias("w")), "doc_id").join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        of = self.write(of, "members")
        per = of.groupBy("bundle", "label").agg(F.count("*").alias("s"), F.sum("w").alias("w"))
        largest = F.max(F.struct("s", "label", "w"))
        top = per.groupBy("bundle").agg(largest.alias("most"), F.sum("s").alias("m"), F.sum("w").alias("w"), F.count("*").alias("k")).where("k > 1")
        tiles = lambda m, w: F.greatest(F.ceil(m / tile), F.ceil(w / TILE_ELEMENTS)).cast("int")
        m, w, most = F.col("m"), F.col("w"), F.col("most")
        top = top.select("bundle", most["label"].alias("top"), tiles(m, w).alias("tall"), tiles(m - most["s"], w - most["w"]).alias("trest"))
        of = of.drop("w").join(top, "bundle")
        spread = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
        rest = of.where("label <> top").withColumn("i", spread("trest")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("tall") - 1)))
        every = of.withColumn("j", spread("tall")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("trest") - 1)))
        key, ratio = ["bundle", "i", "j"], self.ratio

        def elements(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            """(elements, their rows), sorted by element."""
            shared = t.column("shared").combine_chunks()
            flat = shared.flatten().to_numpy(zero_copy_only=False)
            order = np.argsort(flat, kind="stable")
            return flat[order], np.repeat(np.arange(len(shared)), shared.value_lengths().to_numpy(zero_copy_only=False))[order]

        def histogram(t: pa.Table, e: np.ndarray, row: np.ndarray) -> np.ndarray:
            g = np.stack([np.frombuffer(x, "<u4") for x in t.column("rest").to_pylist()])
            place = row * CELLS + (e.view(np.uint64) % np.uint64(CELLS)).astype(np.int64)
            g[:, CELLS:] += np.bincount(place, minlength=len(g) * CELLS).reshape(-1, CELLS).astype(np.uint32)
            return g

        def compare(x: pa.Table, y: pa.Table) -> pa.Table:
            a = b = np.empty(0, np.int64)
            if x.num_rows and y.num_rows:
                (ex, rx), (ey, ry) = elements(x), elements(y)
                both, count = np.intersect1d(ex, ey), np.zeros((x.num_rows, y.num_rows), np.float32)
                for lo in range(0, len(both), 4096):
                    block, parts = both[lo : lo + 4096], []
                    for e, r, rows in ((ex, rx, x.num_rows), (ey, ry, y.num_rows)):
                        here = slice(np.searchsorted(e, block[0]), np.searchsorted(e, block[-1], "right"))
                        at = np.searchsorted(block, e[here])
                        hit = block[at] == e[here]
                        parts.append(np.zeros((rows, len(block)), np.float32))
                        parts[-1][r[here][hit], at[hit]] = 1
                    count += parts[0] @ parts[1].T
                dx, dy, nx, ny, cx, cy = (t.column(c).to_numpy() for c in ("doc_id", "n", "label") for t in (x, y))
                num, den = ratio
                i, j = np.nonzero((count > 0) & (cx[:, None] != cy[None]) & (den * nx[:, None] >= num * ny[None]) & (den * ny[None] >= num * nx[:, None]))
                gx, gy, fine = histogram(x, ex, rx), histogram(y, ey, ry), np.zeros(len(i), bool)
                for lo in range(0, len(i), 16384):
                    p, q = i[lo : lo + 16384], j[lo : lo + 16384]
                    reach = np.minimum(gx[p], gy[q]).sum(1, dtype=np.int64)
                    fine[lo : lo + 16384] = reach >= least_overlap(nx[p], ny[q], ratio)
                i, j = i[fine], j[fine]
                a, b = np.minimum(dx[i], dy[j]), np.maximum(dx[i], dy[j])
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        def side(t: DataFrame):
            full = t.select(*key, "doc_id", "label").join(wide, "doc_id")
            return full.select(*[F.col(c).alias(c) for c in (*key, "doc_id", "n", "label", "shared", "rest")]).groupBy(*key)

        return side(rest).cogroup(side(every)).applyInArrow(compare, "a long, b long").distinct()

    def edges(self) -> DataFrame:
        """Links (a, b) between different sets that join all that can be joined: every link that is left out lies within
        a component of those given out."""
        rows = self.write(self.prefixes(), "order")
        found = [materialise(self.verified(self.rare_pairs(rows)), "links")]
        lists, wide = self.common_rows(rows)
        if not lists.isEmpty():
            found += self.common_links(lists, wide, found)
        discard(*self.spent)
        self.spent = []
        return functools.reduce(DataFrame.unionByName, found)

    def common_links(self, lists: DataFrame, wide: DataFrame, found: list[DataFrame]) -> list[DataFrame]:
        """Tables of links (a, b) that common elements lead to, beside those found so far."""
        more: list[DataFrame] = []

        def labels():
            of = connected_components(functools.reduce(DataFrame.unionByName, found + more))
            return self.write(of.select(F.col("id").alias("doc_id"), F.col("component").alias("label")), "labels")

        for turn in range(2):
            pairs = self.write(self.pivot_pairs(lists, labels(), turn), "pivots")
            if pairs.isEmpty():
                break
            more.append(materialise(self.verified(pairs), "links"))
            if more[-1].isEmpty():
                break
        more.append(materialise(self.verified(self.common_pairs(self.bundles(lists), wide, labels())), "links"))
        return more


def jaccard_components(docs: DataFrame, n: int = 4, ratio: Ratio = (85, 100), crowd: int = 16, max_common: int = 1_000_000) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, the smallest doc_id that it reaches by links.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z as a-z; a document's set holds its distinct n-word shingles; with fewer
    words the whole sequence is one. Texts that are null, empty or without words have no shingles and link with nothing.
    Documents with equal sets are one row of the incidence matrix, and share a component. Rows of one doc_id count as
    one document; a null doc_id links with nothing.

    The product of the documents' incidence rows is taken in blocks of n-grams, over prefixes whose length follows from
    the set size (see Join): no pair that links is lost, whatever crowd and max_common are. `crowd` moves frequent n-grams
    to the end of the order. Up to max_common of these are told to the tasks as numbers of 8 bytes; more meet the documents'
    n-grams in a join. An empty table gives no rows; other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    join = Join(docs.where("doc_id is not null"), n, ratio, crowd, max_common)
    edges = join.edges()
    labels = connected_components(edges)
    reps = join.classes.join(labels, F.col("doc_id") == F.col("id"), "left").select("k1", "k2", F.coalesce("component", "doc_id").alias("component_id"))
    out = join.all.join(reps, (F.col("n") > 0) & (join.all["k1"] == reps["k1"]) & (join.all["k2"] == reps["k2"]), "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    nulls = rows_of(docs.where("doc_id is null"), n, ratio, np.empty(0, np.uint64))
    return out.unionByName(nulls.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, n: int = 5, ratio: Ratio = (80, 100)) -> DataFrame:
    """The documents with all their columns, of each component only the one with the smallest id. Documents without an
    id stay; of repeated rows of an id one stays."""
    found = materialise(jaccard_components(docs.where("doc_id is not null"), n, ratio), "components")
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("__kept_id"), F.lit(1).alias("__kept"))
    if not kept.groupBy("__kept_id").count().where("count > 1").isEmpty():
        docs = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))
    kept = broadcast_if_small(kept.select("__kept_id").distinct(), BROADCAST_IDS)
    return docs.where("doc_id is not null").join(kept, docs["doc_id"] == kept["__kept_id"], "left_semi").unionByName(docs.where("doc_id is null"))


def op2_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jaccard_components() of all documents: four words, a similarity of 0.85."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
