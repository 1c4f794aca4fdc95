"""Near-duplicates and nearest neighbours among embeddings, by cosine in double precision."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import broadcast_if_small, connected_components, materialise


#: Leaves, one narrow row each, that are broadcast; more are joined by a shuffle.
BROADCAST_LEAVES = 1_000_000


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero; false where it would be null."""
    inf = float("inf")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x != inf) & (x != -inf)) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def keyed(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, dim, vec, k1, k2): usable vectors with an id, and 128 bits of hash. A column of floats stays one, as
    it takes half the room; tasks reckon in doubles."""
    kind = vectors.schema[vector].dataType.simpleString()
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast(kind if kind == "array<float>" else "array<double>").alias("vec"))
    v = v.where(usable(F.col("vec")) & F.col("vec_id").isNotNull())
    return v.select("vec_id", F.size("vec").alias("dim"), "vec", F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(7), "vec").alias("k2"))


def sampled(classes: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """Unit vectors by dimension, of at most so many rows in all, the first by their hashes."""
    out: dict[int, list] = {}
    for dim, vec in classes.orderBy("k1", "k2").limit(rows).select("dim", "vec").collect():
        out.setdefault(dim, []).append(vec)
    return {dim: unit(np.array(v, float)) for dim, v in out.items()}


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit rows) of an array column for each length of its rows."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        yield at, unit(matrix(column.take(pa.array(at))))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an array column, of one length."""
    n = len(column)
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    if not len(x):
        return x
    x = x / abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


# --- near-duplicates


def spanning(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the given links among 0..n-1."""
    root, out = list(range(n)), []
    for a, b in pairs.tolist():
        x, y = a, b
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def links(ids: np.ndarray, x: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Spanning links of cosine >= threshold among unit rows."""
    a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    return [(int(ids[i]), int(ids[j])) for i, j in spanning(np.stack([a, b], 1), len(ids))]


class Passes:
    """Random hashes for vectors of one dimension: for each pass `bits` directions, and where to cut them.

    A bit tells on which side of a cut a vector's projection lies. The cut of each of the first bits is the median of those
    rows of a sample that agree in all bits before, and of the later ones the median of those that agree in the first ones.
    So cells hold about as many rows, also where vectors crowd in a cone, of which a cut through the origin would split none.
    """

    TOP = 9

    def __init__(self, sample: np.ndarray, dim: int, bits: int, passes: int, seed: int):
        rng = np.random.default_rng((seed, dim))
        self.bits, self.top = bits, max(0, min(bits, self.TOP, int(math.log2(max(1, len(sample) / 8)))))
        self.planes = rng.standard_normal((passes, bits, dim))
        self.cuts = [self.fit(sample @ p.T) for p in self.planes]

    def fit(self, side: np.ndarray) -> list[np.ndarray]:
        """For each bit the cuts by the number that the first bits make."""
        cell, out = np.zeros(len(side), np.int64), []
        for k in range(self.bits):
            cut = np.zeros(1 << min(k, self.top))
            order = np.lexsort((side[:, k], cell))
            at = np.searchsorted(cell[order], np.arange(len(cut) + 1))
            for c in np.flatnonzero(np.diff(at)).tolist():
                lo, hi = at[c], at[c + 1]
                cut[c] = (side[order[(lo + hi - 1) // 2], k] + side[order[(lo + hi) // 2], k]) / 2
            out.append(cut)
            if k < self.top:
                cell = 2 * cell + (side[:, k] > cut[cell])
        return out

    def keys(self, x: np.ndarray, p: int, bits: int | None = None) -> np.ndarray:
        """The first bits of unit rows in pass p as one number, the first bit highest."""
        side, key = x @ self.planes[p].T, np.zeros(len(x), np.int64)
        cell = key
        for k in range(self.bits if bits is None else bits):
            bit = side[:, k] > self.cuts[p][k][cell]
            key = 2 * key + bit
            if k < self.top:
                cell = key
        return key


def passes_for(sample: np.ndarray, dim: int, bits: int, threshold: float, missed: float, seed: int, trials: int = 24, most: int = 1024) -> int:
    """How many passes leave at most the share `missed` of pairs at the threshold in different cells of that many bits.

    Measured, not assumed: rows of the sample get a partner in a random direction, at the threshold, and trial passes tell
    how often a pair of a region shares a cell; regions are cells of four bits, so that a crowded one counts for itself.
    """
    if bits <= 0 or not len(sample):
        return 2
    x = sample[:most]
    other = np.random.default_rng(seed + 1).standard_normal(x.shape)
    other -= (other * x).sum(1, keepdims=True) * x
    other /= np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-300)
    y = threshold * x + math.sqrt(1 - threshold * threshold) * other if dim > 1 else x
    trial = Passes(sample, dim, bits, trials, seed + 2)
    hit = np.mean([trial.keys(x, p) == trial.keys(y, p) for p in range(trials)], 0)
    region = trial.keys(x, 0, min(4, bits))
    found = [(np.mean(region == r), max(hit[region == r].mean(), 0.5 / (trials * (region == r).sum()))) for r in np.unique(region)]
    n = 2
    while sum(w * (1 - p) ** n for w, p in found) > missed:
        n += max(1, n // 8)
    return n


def pass_edges(classes: DataFrame, threshold: float, window: int, missed: float, seed: int, sample_rows: int = 8192) -> DataFrame:
    """Links (a, b) found by sorted projection passes over rows (id, dim, vec, k1, k2).

    In each pass every vector gets its bits as one number (Passes), and all are range-partitioned and sorted by dimension,
    pass and number. A task walks along its range and compares each block of `window` rows within itself and with the
    block before; the ends of neighbouring ranges meet afterwards. Of the verified links of two blocks a spanning forest is
    given out, so that a dense block gives rows in proportion to its size. The passes of a dimension are as many as
    its sample asks for (passes_for), with no bound; the sample has sample_rows rows at most, for all dimensions.
    """
    spark = classes.sparkSession
    counts = {r[0]: r[1] for r in classes.groupBy("dim").count().collect()}
    sample = sampled(classes, sample_rows)
    fits, rows = {}, 0
    for dim, n in counts.items():
        have = sample.get(dim, np.empty((0, dim)))
        shared = max(0, math.ceil(math.log2(n / window)) + 1) if n > window else 0
        passes = passes_for(have, dim, shared, threshold, missed, seed)
        fits[dim] = (have, min(60, shared + 6), passes)
        rows += n * passes
    sent = spark.sparkContext.broadcast(fits)

    made: dict[int, Passes] = {}

    def hashes(dim: int) -> Passes:
        if dim not in made:
            have, bits, passes = sent.value[dim]
            made.clear()
            made[dim] = Passes(have, dim, bits, passes, seed)
        return made[dim]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in by_length(b.column(1)):
                own, part = hashes(x.shape[1]), b.take(pa.array(at))
                for p in range(len(own.planes)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(np.full(len(x), p, np.int32)), pa.array(own.keys(x, p)), part.column(0), part.column(1)], ["dim", "pass", "key", "id", "vec"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links have a and b; the first and last rows of the task's range have a, vec and border, its number."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def out(pairs, border=None, ids=(), raw=()):
            ids = np.asarray(ids, np.int64).tolist()
            return pa.RecordBatch.from_arrays([
                pa.array([p[0] for p in pairs] + ids, pa.int64()), pa.array([p[1] for p in pairs] + [None] * len(ids), pa.int64()),
                pa.array([None] * len(pairs) + [v.tolist() for v in raw], pa.list_(pa.float64())), pa.array([None] * len(pairs) + [border] * len(ids), pa.int64()),
            ], ["a", "b", "vec", "border"])

        def blocks():
            """(ids, vectors) of at most `window` rows of one dimension; None before another dimension begins."""
            ids, held, dim = [], [], None
            for b in batches:
                size = b.column(4).value_lengths().to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(size)]
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    if lo == hi:
                        continue
                    if size[lo] != dim:
                        if ids:
                            yield np.concatenate(ids), np.concatenate(held)
                        if dim is not None:
                            yield None
                        ids, held, dim = [], [], size[lo]
                    for at in range(lo, hi, window):
                        piece = b.slice(at, min(window, hi - at))
                        ids.append(piece.column(3).to_numpy(zero_copy_only=False))
                        held.append(matrix(piece.column(4)))
                        while sum(map(len, ids)) >= window:
                            i, x = np.concatenate(ids), np.concatenate(held)
                            yield i[:window], x[:window]
                            ids, held = ([i[window:]], [x[window:]]) if len(i) > window else ([], [])
            if ids:
                yield np.concatenate(ids), np.concatenate(held)

        first, before_ids, before, tail = True, None, None, None
        for block in blocks():
            if block is None:
                before = tail = None
                continue
            ids, raw = block
            x = unit(raw)
            both_ids, both = (ids, x) if before is None else (np.concatenate([before_ids, ids]), np.concatenate([before, x]))
            yield out(links(both_ids, both, threshold))
            if first:
                yield out([], part - 1, ids, raw)
            tail = (ids, raw) if tail is None else (np.concatenate([tail[0], ids])[-window:], np.concatenate([tail[1], raw])[-window:])
            first, before_ids, before = False, ids, x
        if tail is not None:
            yield out([], part, *tail)

    def border(t: pa.Table) -> pa.Table:
        found = links(t.column("a").to_numpy(), unit(matrix(t.column("vec"))), threshold)
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // (4 * window)))
    kind = classes.schema["vec"].dataType.simpleString()
    keys = classes.select("id", "vec").mapInArrow(hashed, f"dim int, pass int, key long, id long, vec {kind}")
    order = ["dim", "pass", "key", "id"]
    walked = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(walk, "a long, b long, vec array<double>, border long")
    walked = materialise(walked, "passes")
    met = walked.where("border is not null").select("border", F.size("vec").alias("dim"), "a", "vec").groupBy("border", "dim").applyInArrow(border, "a long, b long")
    return walked.where("b is not null").select("a", "b").unionByName(met).distinct()


def link_counts(members: DataFrame, threshold: float, tile: int = 1024) -> DataFrame:
    """Rows (id, others): for every row of (component, id, weight, vec), the weights of the others in its component that
    it links with. Components are cut into tiles by a hash of the id and every two tiles meet in one group, so that a
    group holds about two tiles whatever the component's size; counts leave it, not pairs."""
    sizes = members.groupBy("component").agg(F.count("*").alias("s")).where("s > 1").select("component", F.ceil(F.col("s") / tile).cast("int").alias("t"))
    rows = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("id"), F.col("t")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    rows = rows.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "weight", "vec")

    def count(t: pa.Table) -> pa.Table:
        i, j, own = (t.column(c).to_numpy() for c in ("i", "j", "own"))
        ids, w, x = t.column("id").to_numpy(), t.column("weight").to_numpy(), unit(matrix(t.column("vec")))
        if i[0] == j[0]:
            hit = x @ x.T >= threshold
            np.fill_diagonal(hit, False)
            got = hit @ w
        else:
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            hit = x[left] @ x[right].T >= threshold
            got = np.zeros(len(ids), np.int64)
            got[left], got[right] = hit @ w[right], hit.T @ w[left]
        return pa.table({"id": pa.array(ids), "others": pa.array(got.astype(np.int64))})

    return rows.groupBy("component", "i", "j").applyInArrow(count, "id long, others long").groupBy("id").agg(F.sum("others").alias("others"))


def near_duplicates(vectors: DataFrame, vector: str = "embedding", threshold: float = 0.95, window: int = 512, missed: float = 0.002, seed: int = 11) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept.

    Equal vectors are first taken as one with a weight. Links come from sorted projection passes, are united into
    components, and within each component every pair is then compared, so that n_links is whole there. `missed` is the
    share of single pairs at the threshold that no pass may bring together; a larger cosine is met more often.
    Vectors of different dimensions never link; each dimension is searched for itself. Vectors that are null, empty, zero,
    or hold null or non-finite components link with nothing: 0, their own id, true. Repeated rows count as other vectors,
    also several vectors of one id. A null vec_id links with nothing. Other columns and labels are not looked at. An empty
    table gives no rows.
    """
    v = materialise(keyed(vectors, vector), "vectors")
    classes = v.groupBy("k1", "k2", "dim").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.any_value("vec").alias("vec"))
    classes = materialise(classes, "classes")
    # the same id on different vectors: both stay, as classes are told apart by k1 and k2
    if not classes.groupBy("id").count().where("count > 1").isEmpty():
        classes = materialise(classes.withColumn("id", F.xxhash64("k1", "k2")), "classes")
    parts = materialise(connected_components(pass_edges(classes, threshold, window, missed, seed)), "components")
    members = materialise(classes.join(parts, "id").select("component", "id", "weight", "vec"), "members")
    others = link_counts(members, threshold)
    lowest = v.groupBy("k1", "k2").agg(F.min("vec_id").alias("least_id"))
    told = classes.join(lowest, ["k1", "k2"]).select("id", "weight", "k1", "k2", "least_id").join(parts, "id", "left").join(others, "id", "left")
    told = materialise(told.withColumn("component", F.coalesce("component", "id")), "told")
    names = told.groupBy("component").agg(F.min("least_id").alias("component_id"))
    told = told.join(names, "component").select("k1", "k2", "component_id", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    done = v.join(told, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    all_rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("vec"))
    alone = all_rows.where(~usable(F.col("vec")) | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


# --- nearest neighbours


class Forest:
    """Trees of random hyperplanes over unit vectors of one dimension, as deep as n rows ask for with leaf_rows in a leaf.

    The upper levels have a hyperplane for each node, cut at the median of the sample rows there, down to some 16 of these.
    The deeper levels have a direction for each level, cut at the median of the sample rows of the node where
    they begin. So the number of leaves grows with n, and the sample and the forest's size hardly do.
    """

    def __init__(self, sample: np.ndarray, n: int, leaf_rows: int, trees: int, seed: int):
        depth = max(0, math.ceil(math.log2(max(1, n / leaf_rows))))
        self.top = max(0, min(depth, int(math.log2(max(1, len(sample) / 16)))))
        self.deep, dim = depth - self.top, sample.shape[1]
        rng, nodes = np.random.default_rng(seed), (1 << self.top) - 1
        self.planes, self.cut = rng.standard_normal((trees, nodes, dim)), np.zeros((trees, nodes))
        self.planes /= np.linalg.norm(self.planes, axis=2, keepdims=True)
        self.under, self.under_cut = rng.standard_normal((trees, self.deep, dim)), np.zeros((trees, self.deep, 1 << self.top))
        self.under /= np.linalg.norm(self.under, axis=2, keepdims=True)
        for t in range(trees):
            at = np.zeros(len(sample), np.int64)
            for level in range(self.top):
                side = (sample * self.planes[t, at]).sum(1)
                for i in np.unique(at).tolist():
                    self.cut[t, i] = np.median(side[at == i])
                at = 2 * at + 1 + (side > self.cut[t, at])
            for i in np.unique(at).tolist():
                self.under_cut[t, :, i - nodes] = np.median(sample[at == i] @ self.under[t].T, axis=0)

    @property
    def trees(self) -> int:
        return len(self.cut)

    def keep(self, trees: int, depth: int | None = None) -> None:
        """Only so many trees, cut off below so many levels."""
        for name in ("planes", "cut", "under", "under_cut"):
            setattr(self, name, getattr(self, name)[:trees])
        if depth is not None and depth < self.top + self.deep:
            self.deep, self.top = max(0, depth - self.top), min(depth, self.top)
            nodes = (1 << self.top) - 1
            self.planes, self.cut, self.under = self.planes[:, :nodes], self.cut[:, :nodes], self.under[:, : self.deep]
            self.under_cut = self.under_cut[:, : self.deep] if self.deep else np.zeros((trees, 0, 1 << self.top))

    def ways(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(node at every level, whether the way turns right there) of unit rows in a tree; the deeper levels have the
        number of the upper leaf as their node. The turns, as bits, are the leaf."""
        at, nodes, turns = np.zeros(len(x), np.int64), [], []
        for _ in range(self.top):
            nodes.append(at)
            turns.append((x * self.planes[t, at]).sum(1) > self.cut[t, at])
            at = 2 * at + 1 + turns[-1]
        leaf = at - (1 << self.top) + 1
        for k in range(self.deep):
            nodes.append(leaf)
            turns.append(x @ self.under[t, k] > self.under_cut[t, k, leaf])
        none = np.zeros((len(x), 0), np.int64)
        return (np.stack(nodes, 1), np.stack(turns, 1)) if nodes else (none, none.astype(bool))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every unit row in every tree; the tree's number stands in the bits from 48 on."""
        out = np.empty((len(x), self.trees), np.int64)
        for t in range(self.trees):
            _, turns = self.ways(x, t)
            leaf = np.zeros(len(x), np.int64)
            for k in range(turns.shape[1]):
                leaf = 2 * leaf + turns[:, k]
            out[:, t] = leaf + (t << 48)
        return out

    def order(self, q: np.ndarray, most: float = math.inf, bound: float = math.inf) -> list[int]:
        """The leaves that one priority queue over all trees gives for a unit vector, best first, up to `most` leaves or
        as long as they are within the bound. A way is as good as its worst turn, and going to the side where the query
        isn't is as bad as the distance to the plane: no row behind it is nearer than that."""
        side, flat = self.planes @ q - self.cut, self.under @ q
        queue: list[tuple] = [(-math.inf, t, 0, 0) for t in range(self.trees)]  # worst turn, tree, level, turns so far
        heapq.heapify(queue)
        out, depth = [], self.top + self.deep
        while queue and len(out) < most:
            worst, t, level, turns = heapq.heappop(queue)
            if worst > bound:
                break
            while level < depth:
                if level < self.top:
                    s = side[t, (1 << level) - 1 + turns]
                else:
                    s = flat[t, level - self.top] - self.under_cut[t, level - self.top, turns >> (level - self.top)]
                right, level = int(s > 0), level + 1
                if max(worst, abs(s)) <= bound:
                    heapq.heappush(queue, (max(worst, abs(s)), t, level, 2 * turns + 1 - right))
                turns = 2 * turns + right
            out.append(turns + (t << 48))
        return out

    def calibrate(self, sample: np.ndarray, k: int, recall: float, queries: int = 100, leaves: int = 32) -> float:
        """Keep the number of trees with the least to compare, and return how bad a turn may be, as a share of the distance
        to the k-th nearest, so that within the sample the leaves found hold that share of the true k nearest.

        Trees are cut off where a query would go to more than `leaves` leaves in all, as estimated by the share of the sample
        that it sees: where vectors have no structure, that share hardly falls with the depth, and deeper leaves would only be
        more of them, in proportion to the table. Their rows are all compared either way."""
        n, depth = len(sample), self.top + self.deep
        if n <= k + 1 or not depth:
            self.keep(min(self.trees, 2))
            return math.inf
        asked = np.arange(0, n, max(1, n // queries))
        sims = sample[asked] @ sample.T
        sims[np.arange(len(asked)), asked] = -2
        true = np.argpartition(-sims, k, axis=1)[:, :k]
        far = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(sims, true, 1).min(1), 1e-12))
        worst = np.zeros((self.trees, len(asked), n), np.float32)
        at = [self.ways(sample, t) for t in range(self.trees)]
        best = None
        for level in range(depth):
            for t, (nodes, turns) in enumerate(at):
                for r, i in enumerate(asked):
                    if level < self.top:
                        of = slice((1 << level) - 1, (2 << level) - 1)
                        side = (self.planes[t, of] @ sample[i] - self.cut[t, of])[nodes[:, level] - of.start]
                    else:
                        side = self.under[t, level - self.top] @ sample[i] - self.under_cut[t, level - self.top][nodes[:, level]]
                    np.maximum(worst[t, r], np.where((side > 0) != turns[:, level], np.abs(side) / far[r], 0), out=worst[t, r])
            here = None
            for trees in (x for x in (2, 4, 8, 16) if x <= self.trees):
                needed = np.take_along_axis(worst[:trees].min(0), true, 1)
                share = float(np.quantile(needed, recall, method="higher"))
                seen = float((worst[:trees] <= share).mean((1, 2)).sum())
                if (level < 2 or seen * (2 << level) <= leaves) and (here is None or seen < here[0]):
                    here = seen, trees, share, level + 1
            if here is None:
                break
            if best is None or level < 2 or here[0] <= 1.05 * best[0]:
                best = here
        self.keep(best[1], best[3])
        return best[2]


def nearest(vectors: DataFrame, queries: Column, k: int = 5, vector: str = "embedding", trees: int = 8, leaf_rows: int = 128, sample_rows: int = 8192, recall: float = 0.97, block: int = 8192, seed: int = 5) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row that the condition `queries` picks, its k nearest others found.

    Each dimension has a forest, fitted on a sample (sample_rows vectors at most for all dimensions, by the order of a
    hash) and as deep as the number of its vectors asks for, unless a query would then go to very many leaves (Forest.calibrate). Every vector is put into its leaf in every tree. A query first
    goes to its four best leaves a tree, which gives a distance to its k-th best; then to all further leaves within
    that distance times a share, the least share that finds `recall` of the true neighbours within the sample. With fewer
    than k found in the first leaves, all others are gone to; what is further than the distance to the k-th is not given out
    there. Each leaf's vectors and queries are dealt out in blocks of bounded
    size that meet in one group, which reranks exactly and gives out k + 1 rows for a query.
    Equal vectors are searched once: of a class of equals the k + 1 smallest ids matter. Ties go to the smaller id.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; those of another
    dimension are no candidates. Fewer candidates than k: all of them. Repeated rows of an id count as one result. Several
    different vectors of one id that queries picks are all asked for, and the best of their results count. No rows: none.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    v = materialise(keyed(vectors, vector), "vectors")
    first = v.withColumn("nth", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    classes = first.groupBy("k1", "k2", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.any_value("vec").alias("vec"))
    classes = materialise(classes, "classes")
    asked = materialise(v.where(queries).select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct(), "queries")
    counts = {r[0]: r[1] for r in classes.groupBy("dim").count().collect()}
    if not counts:
        return spark.createDataFrame([], schema)
    sample, fits = sampled(classes, sample_rows), {}
    for dim, n in counts.items():
        have = sample.get(dim, np.empty((0, dim)))
        forest = Forest(have, n, leaf_rows, trees, seed)
        fits[dim] = forest, forest.calibrate(have, k, recall)
    sent, kind = spark.sparkContext.broadcast(fits), classes.schema["vec"].dataType.simpleString()

    def into_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in by_length(b.column(1)):
                leaf, part = sent.value[x.shape[1]][0].leaves(x), b.take(pa.array(at))
                for t in range(leaf.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(leaf[:, t]), part.column(0), part.column(1)], ["dim", "leaf", "ids", "vec"])

    def to_leaves(rows: DataFrame, later: bool) -> DataFrame:
        """Queries (k1, k2, vec, last) with the leaves that they go to at first, or later; last is the cosine of the k-th
        best so far, -2 without one."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, x in by_length(b.column(2)):
                    forest, share = sent.value[x.shape[1]]
                    most = 4 * forest.trees
                    for lo in range(0, len(x), 64):
                        part = b.take(pa.array(at[lo : lo + 64]))
                        far = [math.sqrt(max(1e-12, 2 - 2 * c)) if c > -2 else math.inf for c in part.column(3).to_pylist()]
                        if later:
                            order = [forest.order(q, bound=share * d if d < math.inf else math.inf)[most:] for q, d in zip(x[lo : lo + 64], far)]
                        else:
                            order = [forest.order(q, most) for q in x[lo : lo + 64]]
                        row = pa.array(np.repeat(np.arange(len(order)), [len(o) for o in order]))
                        leaf = np.concatenate([np.array(o, np.int64) for o in order])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), x.shape[1], np.int32)), pa.array(leaf), *(part.column(c).take(row) for c in range(4))], ["dim", "leaf", "k1", "k2", "vec", "last"])

        return materialise(rows.mapInArrow(run, f"dim int, leaf long, k1 long, k2 long, vec {kind}, last double"), "routed")

    index = materialise(classes.select("ids", "vec").mapInArrow(into_leaves, f"dim int, leaf long, ids array<long>, vec {kind}"), "index")
    sizes = materialise(index.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("nb")), "sizes")
    pair = ["dim", "leaf", "b", "q"]

    def rerank(have: pa.Table, want: pa.Table) -> pa.Table:
        out = []
        if have.num_rows and want.num_rows:
            y, ids = unit(matrix(have.column("vec"))), have.column("ids").to_pylist()
            for lo in range(0, want.num_rows, 512):
                s = want.slice(lo, 512)
                sims = unit(matrix(s.column("vec"))) @ y.T
                least = np.partition(sims, max(0, sims.shape[1] - k - 1), axis=1)[:, max(0, sims.shape[1] - k - 1)]
                least = np.maximum(least, s.column("last").to_numpy() - 1e-12)
                for r, (k1, k2) in enumerate(zip(s.column("k1").to_pylist(), s.column("k2").to_pylist())):
                    found = sorted((-sims[r, c], i) for c in np.flatnonzero(sims[r] >= least[r]) for i in ids[c])[: k + 1]
                    out += [(k1, k2, i, -d) for d, i in found]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, kinds)], names=["k1", "k2", "vec_id", "score"])

    def search(routed: DataFrame) -> DataFrame:
        blocks = sizes.join(routed.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("nq")), ["dim", "leaf"])
        blocks = broadcast_if_small(blocks, BROADCAST_LEAVES)
        left = index.join(blocks, ["dim", "leaf"]).withColumn("b", F.pmod(F.xxhash64("ids"), F.col("nb")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
        right = routed.join(blocks, ["dim", "leaf"]).withColumn("q", F.pmod(F.xxhash64("k1", "k2"), F.col("nq")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        return left.select(*pair, "ids", "vec").groupBy(*pair).cogroup(right.select(*pair, "k1", "k2", "vec", "last").groupBy(*pair)).applyInArrow(rerank, "k1 long, k2 long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        found = found.groupBy("k1", "k2", "vec_id").agg(F.max("score").alias("score"))
        nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id"))
        return materialise(found.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth"), "best")

    wanted = classes.join(asked.select("k1", "k2").distinct(), ["k1", "k2"]).select("k1", "k2", "vec")
    near = best(search(to_leaves(wanted.withColumn("last", F.lit(-2.0)), False)))
    # the query itself is among the first k + 1
    last = near.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    last = last.select("k1", "k2", F.when(F.col("n") > k, F.col("least")).alias("last"))
    rest = wanted.join(last, ["k1", "k2"], "left").withColumn("last", F.coalesce("last", F.lit(-2.0)))
    found = best(near.unionByName(search(to_leaves(rest.select("k1", "k2", "vec", "last"), True))))
    of = asked.join(found, ["k1", "k2"]).where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return of.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op5_near_duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all embeddings at a cosine of 0.95."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nearest(): the five nearest of each embedding whose vec_id is divisible by 50, among all others."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
