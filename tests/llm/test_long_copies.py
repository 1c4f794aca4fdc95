"""Common n-grams of long near copies: what is written for them grows with the texts, and no pair that may link is lost."""

import itertools
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard


def editions(words, copies=20, edits=3, seed=5):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        t = list(base)
        for _ in range(edits):
            t[r.randrange(words)] = f"e{r.randrange(10**9)}"
        out.append(" ".join(t))
    return out


def size(table):
    return sum(f.stat().st_size for f in pathlib.Path(table.shared_path).rglob("*.parquet"))


@pytest.mark.parametrize("words", [1000, 20_000])
def test_lists_of_long_copies_are_linear(spark, words):
    texts = editions(words)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    join = jaccard.Join(docs, 4, (85, 100), 16, 10**6)
    lists, wide = join.common_rows(join.write(join.prefixes(), "order"))
    assert lists.count() > words
    bundles = join.bundles(lists)
    # each document's elements are fetched a few times, not once for each of its elements
    assert bundles.count() <= 4 * len(texts)
    assert size(lists) + size(wide) + size(bundles) < 10 * sum(map(len, texts))
    found = jaccard.jaccard_components(docs)
    assert {r.component_id for r in found.collect()} == {0}


def test_bundles_hold_every_two_documents_of_a_list(spark):
    r = random.Random(3)
    rows = {(h, d) for h in range(60) for d in r.sample(range(40), r.randrange(1, 9))}
    # an element that all share would make one bundle of everything
    lists = spark.createDataFrame([*rows, *((-1, d) for d in range(0, 40, 4))], "h long, doc_id long").withColumn("n", F.lit(9).cast("long"))
    join = jaccard.Join(spark.createDataFrame([], "doc_id long, text string"), 4, (85, 100), 16, 10)
    pairs = lambda of: {p for k in {x for x, _ in of} for p in itertools.combinations(sorted(d for x, d in of if x == k), 2)}
    bundles = [tuple(b) for b in join.bundles(lists).select("bundle", "doc_id").collect()]
    assert pairs([(x.h, x.doc_id) for x in lists.collect()]) <= pairs(bundles)
    assert len(bundles) == len(set(bundles)) <= lists.count()


def test_components_of_long_texts_equal_brute_force(spark):
    """Editions with many edits, some of which link only through others."""
    texts = editions(1500, 24, 60, 1) + editions(1500, 24, 90, 1) + editions(400, 20, 12, 2)
    texts += [t + " " + " ".join(texts[i].split()[:60]) for i, t in enumerate(editions(900, 20, 8, 4))]
    order = list(range(len(texts)))
    random.Random(9).shuffle(order)
    sets = {}
    for at, i in enumerate(order):
        w = texts[i].split()
        sets[at] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = 0
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            linked += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([(at, texts[i]) for at, i in enumerate(order)], "doc_id long, text string")
    for crowd in (3, 16):
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, crowd=crowd).collect()}
        assert got == {i: find(i) for i in sets}
    assert 100 < linked
