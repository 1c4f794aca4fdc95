"""Spelling variants, languages and whitening against plain versions of themselves."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import language, spelling, whitening

ODD = "doc_id long, text string, lang string, word string, n long, key long, at string"


def odd_docs(spark, texts, lang=lambda i: "en", ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t, lang(i), "x", 1, 2, "y") for i, t in enumerate(texts)], ODD)


# --- spelling variants


def plain_counts(docs, least_length=6, least_n=5, every=199):
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    n = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least_n}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) == len(a):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(vocabulary, ratio=5):
    near = {w: [v for v in vocabulary if one_edit(w, v)] for w in vocabulary}
    form = {}
    for w, ws in near.items():
        best = min(ws, key=lambda v: (-vocabulary[v], v), default=None)
        form[w] = best if best and vocabulary[best] >= ratio * vocabulary[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), vocabulary[form[w]] if form[w] else None) for w, n in vocabulary.items()}


def as_dict(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def made_vocabulary(seed, count, alphabet, lengths):
    r = random.Random(seed)
    out = {}
    while len(out) < count:
        w = "".join(r.choice(alphabet) for _ in range(r.choice(lengths)))
        out[w] = r.choice([5, 6, 30, 31, 900, 5000])
        for _ in range(2):
            i = r.randrange(len(w))
            out.setdefault(r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(alphabet) + w[i:], w[:i] + r.choice(alphabet) + w[i + 1 :]]) or "z", r.choice([1, 5, 25]))
    return out


@pytest.mark.parametrize(("group", "alphabet", "lengths"), [(50_000, "abé", [6, 7, 8, 9]), (4, "abé", [5, 6, 7, 8]), (3, "abcde", [1, 2, 3, 4]), (8, "abcdefgh÷ÿ", [6, 12, 40])])
def test_variants(spark, group, alphabet, lengths):
    """Also where every key is hot and is split down to what can't be split."""
    vocabulary = made_vocabulary(1, 150, alphabet, lengths)
    got = as_dict(spelling.spelling_variants(spark.createDataFrame(list(vocabulary.items()), "word string, n long"), group=group))
    want = plain_variants(vocabulary)
    assert sum(v[0] is not None for v in want.values()) > 3
    assert got == want


def test_hot_beginning(spark):
    """Many words with one beginning and one end: their keys are split by what stands between."""
    r = random.Random(2)
    vocabulary = {"contra" * 3 + "".join(r.choice("abcdef") for _ in range(6)) + "tional" * 3: r.choice([5, 50]) for _ in range(600)}
    got = as_dict(spelling.spelling_variants(spark.createDataFrame(list(vocabulary.items()), "word string, n long"), group=20))
    assert got == plain_variants(vocabulary)


def test_chain_of_forms(spark):
    vocabulary = {"aaaaaa" + "b" * i: 5 * 5**i for i in range(9)}
    got = as_dict(spelling.spelling_variants(spark.createDataFrame(list(vocabulary.items()), "word string, n long")))
    assert got == plain_variants(vocabulary) and got["aaaaaa"][1] == "aaaaaa" + "b" * 8


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_word_counts(spark, monkeypatch, piece):
    monkeypatch.setattr(spelling, "PIECE", piece)
    r = random.Random(3)
    words = ["Straße", "straße", "naïvely", "NAÏVELY", "×÷×÷×÷", "letters", "lettres", "a" * 40, "short", "ſtrange", "Ωmegaletter", "under_score", "x1letters2y"]
    texts = [None, "", "   ", "12 34"] + [" ".join(r.choice(words) for _ in range(r.randrange(60))) for _ in range(200)] + ["letters" * 300, "letters " * 3000]
    ids = [None if i == 7 else -5 if i == 8 else i for i in range(len(texts))]
    docs = odd_docs(spark, texts, ids=ids)
    got = {r.word: r.n for r in spelling.count_words(docs).collect()}
    assert got == plain_counts(list(zip(ids, texts)))
    # hardly any run is cut at 1 in 199
    assert {r.word: r.n for r in spelling.count_words(docs, every=3).collect()} == plain_counts(list(zip(ids, texts)), every=3)


def test_spelling_of_no_rows(spark):
    assert spelling.count_words(odd_docs(spark, [])).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_op11(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert as_dict(spelling.op11_spelling_variants(spark, sf_dir)) == plain_variants(plain_counts(docs))


# --- languages


def test_path_is_the_best_one():
    rng = np.random.default_rng(4)
    n = [0, 1, 5, 3, 6, 0, 4]
    first = np.concatenate([[0], np.cumsum(n)])
    scores = rng.normal(size=(9, 3)) * 3
    scores[2, 1] = scores[5, 0] = -np.inf
    number = rng.integers(0, 9, first[-1])
    got = language.viterbi(number, scores, first, 2.5)
    worth = lambda ws, p: sum(scores[w, x] for w, x in zip(ws, p)) - 2.5 * sum(x != y for x, y in zip(p, p[1:]))
    for a, z in zip(first[:-1], first[1:]):
        best = max((worth(number[a:z], p) for p in itertools.product(range(3), repeat=int(z - a))), default=0)
        assert worth(number[a:z], got[a:z]) == pytest.approx(best)
    for penalty in (0.0, 2.5, 6.0, 40.0):
        one, other = (f(number, scores, first, penalty) for f in (language.best_path, language.viterbi))
        value = lambda p: sum(scores[w, x] for w, x in zip(number, p)) - penalty * sum(x != y for a, z in zip(first[:-1], first[1:]) for x, y in zip(p[a:z], p[a + 1 : z]))  # noqa: B023, E731
        assert value(one) == pytest.approx(value(other))
    assert (language.of_one_language(number, scores, first, 40.0) >= 0).all()


def test_word_scores_are_chances(spark):
    """What may follow a word's beginning has chances that add up to one."""
    g = language.Grams(["ab", "b", "日本"])
    assert g.length.tolist() == [3, 2, 3] and len(g.places[0]) == 8 and [len(c) for c in g.context] == [8] * 3
    # the same n-gram in other words has the same place
    h = language.Grams(["xxab"])
    assert h.places[1][3] == g.places[1][1] and h.places[0][2] == g.places[0][0] and h.places[3][3] != g.places[3][1]
    model = language.train(odd_docs(spark, ["a b ab ba aab"] * 8))
    letters = "abcdefghij"
    words = ["".join(w) for k in range(1, 5) for w in itertools.product(letters, repeat=k)]
    total = np.exp(model.scores(words)).sum()
    assert 0.5 < total <= 1.0 + 1e-9


EN = "the quick brown fox jumps over the lazy dog and then it runs away with the other animals of the wood"
DE = "der schnelle braune fuchs springt über den faulen hund und dann läuft er mit den anderen tieren des waldes weg"
RU = "быстрая коричневая лиса прыгает через ленивую собаку и потом убегает"
JA = "素早い茶色の狐が怠け者の犬を飛び越える"


def trained(spark):
    texts, langs = [], []
    r = random.Random(5)
    for lang, text in (("en", EN), ("de", DE), ("ru", RU), ("ja", JA)):
        for _ in range(40):
            w = text.split()
            r.shuffle(w)
            texts.append(" ".join(w))
            langs.append(lang)
    return language.train(odd_docs(spark, texts, lambda i: langs[i]))


def test_scripts_and_spans(spark):
    model = trained(spark)
    assert model.languages == ["de", "en", "ja", "ru"]
    mixed = f"{EN} {DE} {EN} {RU}"
    texts = [None, "", "123 !? 45", EN, DE.upper(), RU, JA, "собаку", "犬", mixed, "ελληνικά", "é", "x" * 3000, f"{EN}. " * 2000 + DE, "the"]
    rows = sorted(language.identify(odd_docs(spark, texts), model).collect(), key=lambda r: r.doc_id)
    got = [r.lang_pred for r in rows]
    assert got[:10] == ["und", "und", "und", "en", "de", "ru", "ja", "ru", "ja", "en"]
    assert got[10] in model.languages and got[11] in model.languages and got[13] == "en"
    assert all(0 <= r.score <= 1 for r in rows) and rows[0].score == 0 and rows[3].score > 0.9
    n_en, n_de, n_ru = (len(t.split()) for t in (EN, DE, RU))
    want = [("en", 0), ("de", n_en), ("en", n_en + n_de), ("ru", 2 * n_en + n_de)]
    spans = [s.split(":") for s in rows[9].spans.split(",")]
    assert [s[0] for s in spans] == [w[0] for w in want]
    assert all(abs(int(s[1]) - w[1]) <= 1 for s, w in zip(spans, want)) and int(spans[-1][2]) == 2 * n_en + n_de + n_ru
    assert rows[13].spans.endswith(str(2000 * n_en + n_de)) and rows[13].spans.count(",") == 1


def test_languages_of_odd_tables(spark):
    empty = language.train(odd_docs(spark, []))
    rows = language.identify(odd_docs(spark, [EN, None]), empty).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)] * 2
    assert language.identify(odd_docs(spark, []), empty).count() == 0
    # languages without text, null languages and ids, repeated rows
    model = language.train(odd_docs(spark, [None, "", EN, EN, "no language"], lambda i: ["xx", "yy", "en", "en", None][i], ids=[0, 1, None, None, 4]))
    assert model.languages == ["en"]
    rows = language.identify(odd_docs(spark, [EN, EN], ids=[None, None]), model).collect()
    assert [(r.doc_id, r.held_out, r.lang_pred) for r in rows] == [(None, False, "en")] * 2


def test_op12(spark, sf_dir):
    got = {r.doc_id: r for r in language.op12_languages(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        assert got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)
    held = [d for d in docs if got[d.doc_id].held_out]
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.97 * len(held)


# --- whitening


def plain_whitening(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    a = x - s / n
    values, directions = np.linalg.eigh(a.T @ a / n)
    values, directions = values[::-1], directions[:, ::-1]
    y = a @ directions[:, :k] / np.sqrt(values[:k])
    return y, ((n * x.astype(object) - s.astype(object)) ** 2).sum(1), values[:k] / values.sum()


@pytest.mark.parametrize(("rows_per_block", "dims"), [(4096, 12), (7, 12), (16, 3)])
def test_whitening(spark, rows_per_block, dims):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(100, dims)) @ rng.normal(size=(dims, dims))
    rows = [(i, x.tolist(), i % 3, "a") for i, x in enumerate(v)] + [(200, None, 0, ""), (201, [None] * dims, 0, ""), (202, [float("nan")] * dims, 0, ""), (203, [float("inf")] * dims, 0, "")]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, i int, at string").repartition(5), rows_per_block=rows_per_block).toPandas()
    y, deviation, explained = plain_whitening(v)
    k = min(8, dims)
    assert len(got) == 100 * k and set(got.n) == {100} and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    p = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    np.testing.assert_allclose(p * np.sign((p * y).sum(0)), y, atol=1e-8)
    one = got[got.component == 1].sort_values("vec_id")
    assert one.deviation.tolist() == deviation.tolist() == [int(d) for d in one.deviation_exact]
    np.testing.assert_allclose(got[got.vec_id == 0].sort_values("component").explained, explained, rtol=1e-9)


def test_whitening_of_odd_tables(spark):
    v = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 1.0]), (4, []), (5, [1e300, -1e300]), (9, [1.0, 2.0, 3.0])]
    got = whitening.whiten(spark.createDataFrame(v, "vec_id long, embedding array<double>")).toPandas()
    assert sorted(got.vec_id.fillna(-1).astype(int)) == [-1, -1, 1, 1, 1, 1, 5, 5, 9, 9, 9]
    # a sum of squares that 64 bits can't hold is exact all the same
    x = [[1024 + 100_000, 2048 + 100_000]] * 2 + [[3072 + 100_000, 1024 + 100_000], [(1 << 40) + 100_000, -(1 << 40) + 100_000]]
    s = [sum(c) for c in zip(*x)]
    want = sum((4 * a - b) ** 2 for a, b in zip(x[3], s))
    row = got[(got.vec_id == 5) & (got.component == 1)].iloc[0]
    assert int(row.deviation_exact) == want and np.isnan(float(row.deviation))
    alone = got[got.vec_id == 9]
    assert alone.whitened.isna().all() and (alone.explained == 0).all() and (alone.deviation == 0).all() and (alone.n == 1).all()
    empty = whitening.whiten(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"))
    assert empty.count() == 0 and empty.columns == got.columns.tolist()


def test_op13(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    got = whitening.op13_whitened_vectors(spark, sf_dir).toPandas()
    y, deviation, _ = plain_whitening(np.stack(vectors.embedding))
    p = got.pivot(index="vec_id", columns="component", values="whitened").loc[vectors.vec_id].to_numpy()
    np.testing.assert_allclose(p * np.sign((p * y).sum(0)), y, atol=1e-8)
    assert got[got.component == 1].set_index("vec_id").deviation.loc[vectors.vec_id].tolist() == deviation.tolist()
