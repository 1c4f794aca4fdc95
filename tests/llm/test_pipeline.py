"""The pipeline against plain versions of its stages, over the smallest tables."""

import hashlib
import itertools
from collections import Counter

import pytest

import corpus_pipeline
from tidemark.llm import mixing, pii, quality

from .test_operators import ids_of, roots, words


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The documents before each stage and the last one's rows."""
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def as_rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage(spark, sf_dir, stages):
    model = quality.train(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good, bad = quality.compressor(model.good), quality.compressor(model.bad)
    score = lambda t: model.score(quality.difference(t, good, bad), 64 / (len(t) + 64))
    want = {i for i, r in as_rows(stages[0]).items() if score(r.text.encode()) >= 0.3}
    assert 0 < len(want) < stages[0].count() and set(as_rows(stages[1])) == want


def test_near_duplicates_stage(stages):
    before = sorted(as_rows(stages[1]).items())
    sets = []
    for _, r in before:
        w = words(r.text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = {before[i][0] for i, root in enumerate(roots(len(sets), links)) if i == root}
    assert links and set(as_rows(stages[2])) == want


def test_personal_data_stage(stages):
    field = pii.train(stages[2])
    after = as_rows(stages[3])
    for i, r in as_rows(stages[2]).items():
        want = pii.redact(r.text, sum(pii.find(r.text, field), []))
        assert (after[i].text, after[i].n_chars, after[i].source) == (want, len(want), r.source)


def test_mixing_stage(stages):
    sizes, docs = Counter(), as_rows(stages[3])
    for r in docs.values():
        sizes[r.source] += len(words(r.text))
    weight, capped, total = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}, set(), sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    target |= {s: 3 * sizes[s] for s in capped}
    want = {}
    for i, r in docs.items():
        rate = target[r.source] / sizes[r.source]
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:8], 16) / 2**32
        want[i] = int(rate) + (u < rate - int(rate))
    got = Counter(r.doc_id for r in stages[4].collect())
    assert got == Counter({i: n for i, n in want.items() if n})


def test_packing_stage(spark, sf_dir, stages):
    want = Counter()
    for r in stages[4].collect():
        want[r.doc_id] += len(ids_of(r.text)) + 1
    got = Counter()
    for r in stages[5].collect():
        got[r.doc_id] += r.length
    assert got == want
    whole = Counter()
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        whole[r.doc_id] += r.length
    assert whole == want


@pytest.mark.parametrize("k", range(5))
def test_stages_take_any_table(spark, tmp_path, k):
    """Null and empty texts, null ids and sources, repeated rows, ids at both ends, columns with other steps' names; no rows."""
    name, stage = corpus_pipeline.STAGES[k]
    text = "pay 4111111111111111 or mail a.b@c.example " + " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "s"), (1, text, "s"), (2, None, "s"), (3, "", None), (None, text + " more", None), (2**63 - 1, text, "t"), (-(2**63), "x", "t"), (4, text + " end", "s")]
    docs = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 as __mix_rate", "2 as n", "3 as prefix", "'k' as kept", "4 as component", "5 as score", "6 as size", "7 as label")
    labels = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (4, 0, None), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{labels}/labels.parquet")
    out = stage(spark, docs, labels)
    found = out.collect()
    if k < 4:
        assert out.columns == docs.columns
    ids = Counter(r.doc_id for r in found)
    if k == 1:
        assert ids == Counter({-(2**63): 1, 1: 1, 2: 1, 3: 1, None: 1})
    elif k == 2:
        assert len(found) == len(rows) and {r.text for r in found if r.doc_id == 2} == {None}
        assert not any("4111111111111111" in (r.text or "") for r in found) and all(r.n_chars == (r.text and len(r.text) if r.text is not None else None) for r in found if r.text)
    elif k == 4:
        assert sum(r.length for r in found) == sum(len(ids_of(t)) + 1 for _, t, _ in rows)
    assert stage(spark, docs.limit(0), labels).count() == 0
