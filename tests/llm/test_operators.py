"""Each operator against a plain version of itself, on small tables with nulls, ties, repeated rows and odd columns."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard, mixing, packing, passages, pii, quality, token_counts, token_output, vectors
from tidemark.llm.shared import connected_components
from tidemark.llm.tokens import byte_bpe, library

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, label string, part int"
TEXTS = [None, "", " \n", "one", "It's <|endoftext|> we're 'rx", "a b c d e f g", "A B c d e f g", "naïve Straße ½ ²", "日本語 text", "é combining", "x" * 30_000, "word " * 5000, "mail a@b.co, 1.2.3.4"]


def words(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))


def frame(spark, texts, source=lambda i: "s"):
    return spark.createDataFrame([(i, t, "en", source(i), None, i, "x", 0) for i, t in enumerate(texts)], DOCS)


def roots(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_connected_components(spark):
    random.seed(1)
    links = [(random.randrange(60), random.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7), (59, 59)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(130, links)
    assert got == {i: want[i] for i in {x for p in links for x in p}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies(count, seed, size=60, edits=2):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(count):
        t = list(base)
        for _ in range(r.randrange(edits + 1)):
            t[r.randrange(size)] = f"w{r.randrange(10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("crowd", "max_common"), [(2, 10**6), (16, 10**6), (2, 3)])
def test_jaccard_components(spark, crowd, max_common):
    shared = " ".join(f"p{i}" for i in range(40))
    texts = TEXTS + near_copies(25, 1) + near_copies(3, 2) + [shared + " " + " ".join(f"u{i}x{j}" for j in range(5 + i)) for i in range(20)] + ["a b c d e f g"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, texts), crowd=crowd, max_common=max_common).collect()}
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = roots(len(sets), links)
    assert len(links) > 60
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}


def test_cells_of_huge_sets():
    """A cell with more than 65,535 elements counts them all."""
    own = np.arange(0, 256 * 70_000, 256, dtype=np.uint64)
    prefix, rare, rest = jaccard.cut_row(own, np.array([5], np.uint64), (0, 1))
    assert rare == 70_000 and len(prefix) == 70_001 and np.frombuffer(rest, "<u4")[0] == 70_000


def test_keep_one(spark):
    docs = frame(spark, ["a b c d e f g h", "x y", "A b c d e f g h", None]).union(frame(spark, ["a b c d e f g h"]))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 3]
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_mixing(spark):
    docs = frame(spark, ["w " * (i % 40) for i in range(400)] + [None], lambda i: [None, "a", "b", "c", "d"][min(i // 30, 4)])
    rows = mixing.mixed_sizes(docs).collect()
    assert len(rows) == 401
    sizes, target = {}, {}
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        sizes[source[r.doc_id]] = sizes.get(source[r.doc_id], 0) + r.size
        target[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, capped = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()), set()
    while True:  # share, stop at the caps, share the rest again
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        want = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if want[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    want |= {s: 3 * sizes[s] for s in capped}
    assert capped and {s: pytest.approx(v) for s, v in want.items()} == target
    taken = docs.join(mixing.mixed_sizes(docs).select("doc_id", "taken"), "doc_id").agg(F.sum("taken")).first()[0]
    mixed = mixing.mix_sources(docs)
    odd = mixing.mix_sources(docs.withColumns({c: F.lit(1) for c in ("__mix_rate", "rate", "target", "size", "copies", "_source")}))
    assert odd.count() == mixed.count() and odd.columns[-1] == "_source"
    assert mixed.columns == docs.columns and sum(len(words(r.text)) for r in mixed.collect()) == taken
    assert mixing.mixed_sizes(docs.limit(0)).count() == 0


def ids_of(text, name="byte_bpe_50k.json"):
    return library(name).encode(text or "", add_special_tokens=False).ids


def test_packing(spark):
    random.seed(3)
    texts = TEXTS + [" ".join(random.choice(["the", "zq", "Haus", "17"]) for _ in range(random.randrange(1500))) for _ in range(60)]
    rows = packing.pack_documents(frame(spark, texts), window=16, with_ids=True).collect()
    found, sequences = {}, {}
    for r in rows:
        found.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4
    for i, t in enumerate(texts):
        want, at = ids_of(t) + [0], 0
        for start, ids in sorted(found[i]):
            assert start == at and ids == want[at : at + len(ids)]
            at += len(ids)
        assert at == len(want)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack_documents(frame(spark, []).limit(0)).count() == 0


def test_fullest_is_the_best_sum():
    random.seed(5)
    for _ in range(200):
        counts = {random.randrange(1, 30): random.randrange(1, 4) for _ in range(random.randrange(5))}
        room = random.randrange(1, 60)
        sums = {0}
        for length, times in counts.items():
            sums = {s + length * t for s in sums for t in range(times + 1) if s + length * t <= room}
        chosen = packing.fullest(counts, room)
        assert sum(k * v for k, v in chosen.items()) == max(sums)
        assert all(v <= counts[k] for k, v in chosen.items())


def test_byte_bpe_equals_the_library():
    for t in TEXTS:
        assert byte_bpe("byte_bpe_50k.json").ids(t).tolist() == ids_of(t)


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 4097])
def test_feistel_is_a_permutation(n):
    assert sorted(token_output.feistel(np.arange(n), n, 99).tolist()) == list(range(n))


def test_token_shards(spark, tmp_path):
    shards = token_output.token_shards(frame(spark, TEXTS * 3), length=64, shard_slots=8)
    rows = shards.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    by = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert len(ids) == 64 and r.shard == r.slot // 8 and r.byte_offset == r.slot % 8 * 128 and r.ids_crc32 == zlib.crc32(r.ids)
        assert r.n_tokens == 64 or ids[r.n_tokens :] == [50256] * (64 - r.n_tokens)
    assert sum(r.n_tokens for r in rows) == 3 * sum(len(ids_of(t)) + 1 for t in TEXTS)
    written = {r.shard: r for r in token_output.write_token_shards(shards, f"file://{tmp_path}").collect()}
    for r in rows:
        by.setdefault(r.shard, []).append((r.slot, r.ids))
    for shard, pieces in by.items():
        assert b"".join(p[1] for p in sorted(pieces)) == open(written[shard].path, "rb").read()
        later = list(token_output.read_token_shard(f"file://{tmp_path}", shard, 64, 3))
        assert [x.tobytes() for x in later] == [p[1] for p in sorted(pieces)[3:]]
    # one task reads the rows in order: its stream is the library's ids, cut every 64
    own = {r.slot: r for r in token_output.token_shards(frame(spark, TEXTS).coalesce(1), length=64, shard_slots=8).collect()}
    order = token_output.feistel(np.arange(len(own)), len(own), 20240607).tolist()
    stream = [x for slot in order for x in np.frombuffer(own[slot].ids, "<u2")[: own[slot].n_tokens].tolist()]
    assert stream == [x for t in TEXTS for x in [*ids_of(t), 50256]]
    assert token_output.token_shards(frame(spark, []).limit(0)).count() == 0


def test_token_counts(spark):
    odd = ["it's we're they've I'll 'rx 'v' ''s 'l l'l can't''re 'ree 'r'e 'v 've!'s 12'3 '", "a'b'c'", "'re", "'r", "ÀÉ ßßß"]
    texts = TEXTS + odd + ["".join(random.Random(i).choice("'srevltmda1 !é\n") for _ in range(300)) for i in range(40)]
    texts += ["Привет, МИР! ёж и й й", "ΟΔΥΣΣΕΥΣ ς ΣΑΣ Σ", "漢字かな交じり文 " * 300, "한국어 각 각", "e\u0301\u0323 a\u030a ﬁ Ǆ İI", "שלום ١٢٣ हिन्दी", "\x1c\x1d \x85\u2003\u3000x\u200b", "🙂🙂🏽 <|startoftext|><|endoftext|>x", "\u0301a", "\x00\x01a"]
    rows = token_counts.token_counts(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        n = len(library("word_bpe_49k.json").encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 2048)


def test_token_counts_of_any_words():
    r = random.Random(5)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "aeab", "!.-=*", "".join(map(chr, [*range(0x400, 0x460), *range(0x4E00, 0x4F00), *range(0x300, 0x320), *range(0x370, 0x3D0), *range(0x1F600, 0x1F640)]))]
    texts = ["".join(r.choice(kinds[i % 4]) for _ in range(r.randrange(1, 50))) for i in range(4000)]
    want = [len(e.ids) for e in library("word_bpe_49k.json").encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_tokens(texts, "word_bpe_49k.json").tolist() == want
    small = token_counts.Compiled("word_bpe_49k.json", most=50)  # forgets in the midst of words
    assert small.counts([t.encode() for t in texts if " " not in t and t.islower()][:300]).sum() > 0
    assert [small.count(t.encode()) for t in texts[:4000:4]] == [len(library("word_bpe_49k.json").encode(t, add_special_tokens=False).ids) for t in texts[:4000:4]]


def test_token_counts_of_a_very_long_text():
    text = "".join(random.Random(6).choice(["naïve ", "Слово", "x", "字", " \n", "it's", "7", "?!"]) for _ in range(1_200_000))
    assert len(text) > 3_000_000
    assert token_counts.count_tokens([text], "word_bpe_49k.json").tolist() == [len(library("word_bpe_49k.json").encode(text, add_special_tokens=False).ids)]


def test_quality(spark):
    r = random.Random(2)
    good = [" ".join(r.choice(["the", "of", "river", "house", "morning", "walked"]) for _ in range(r.randrange(1, 200))) for _ in range(200)]
    bad = [" ".join(r.choice(["BUY!!", "NOW$$", "CLICK%%", "FREE**"]) for _ in range(r.randrange(3, 200))) for _ in range(100)]
    docs = frame(spark, good + bad + [None, ""])
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(300)] + [(7, 1), (8, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.score_quality(docs, model).collect()
    held = [x for x in rows if x.held_out and x.doc_id < 300]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in rows)
    assert np.mean([x.predicted == (x.doc_id < 200) for x in held]) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in rows)
    import zstandard

    def compressed(content, text):  # the definition, without the operator's own functions
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(text[i : i + 2048])) for i in range(0, len(text), 2048))

    for x in rows[::25] + rows[-2:]:
        t = ((good + bad + ["", ""])[x.doc_id] or "").encode()
        d = (compressed(model.bad, t) - compressed(model.good, t)) / (len(t) + 64)
        assert x.score == pytest.approx(1 / (1 + np.exp(-(model.slope * d + model.short * 64 / (len(t) + 64) + model.intercept))))
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {x.doc_id for x in rows if x.predicted}
    none = quality.train(docs, labels.limit(0))
    assert {x.predicted for x in quality.score_quality(docs, none).collect()} == {1}
    assert quality.score_quality(docs.limit(0), none).count() == 0


def plain_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    r = random.Random(4)
    for _ in range(3000):
        t = "".join(r.choice("a.@-+1 2.3(45)é%") for _ in range(r.randrange(40)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("4111 1111-11111111 x") == [("card", 0, 18)]
    assert pii.base_spans("1" * 200_000 + "@") == [] and pii.base_spans("a" * 300_000 + "@") == []


def test_pii(spark):
    card, other = "4111111111111111", "4111111111111111 23"
    texts = [f"pay {card} now, {card}; again {other} or mail x.y@z.org", "clean text 12 and 13", None, "", "ip 1.2.3.4 and 999.1.1.1"] + [f"card {card} for {i}" for i in range(30)]
    docs = frame(spark, texts)
    rows = {r.doc_id: r for r in pii.find_pii(docs, pii.train(docs)).collect()}
    assert (rows[0].n_card, rows[0].n_email, rows[4].n_ip) == (2, 1, 1)
    for i, t in enumerate(texts):
        base = pii.joined(plain_spans(t or ""))
        assert set(base.split(",")) <= set(rows[i].spans.split(","))
    assert rows[1].spans == "" and rows[2].spans == ""
    assert rows[0].spans.count("card") == 3  # the copy that the pattern misses gets its label from the others
    red = {r.doc_id: r for r in pii.redact_pii(docs, pii.train(docs)).collect()}
    assert card not in red[0].text and "[EMAIL]" in red[0].text and red[1].text == texts[1] and red[2].text is None
    assert red[4].n_chars == len(red[4].text)


def pii_field():
    r = random.Random(11)
    cards = [c for c in (str(r.randrange(10**15, 10**16)) for _ in range(4000)) if pii.luhn(c)][:150]
    texts = [f"pay {c} by noon" for c in cards] + [f"call +1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)} now" for _ in range(100)]
    texts += [f"mail n{r.randrange(999)}.x@host{r.randrange(9)}.example.org please" for _ in range(100)] + [f"from 10.{r.randrange(255)}.{r.randrange(255)}.{r.randrange(255)} on" for _ in range(100)]
    texts += [f"in {r.randrange(1900, 2100)} there were {r.randrange(99999)} of them, no {r.randrange(10**15, 10**16) * 2 + 1}" for _ in range(150)]
    return pii.fit(texts), cards


def test_field_finds_what_the_patterns_miss():
    field, cards = pii_field()
    added = lambda text: [(k, text[a:b]) for k, a, b in pii.find(text, field)[1]]
    a, b = cards[:2]
    assert added(f"cards {a} {b} here, and {a} again") == [("card", a), ("card", b)]  # two together are no card to the pattern
    assert added("write jane.roe@firm.example or jane.roe (at) firm (dot) example") == [("email", "jane.roe (at) firm (dot) example")]
    assert added("write to jane.roe [at] firm.example") == [("email", "jane.roe [at] firm.example")]
    assert [k for k, _ in added("call +1 (212) 555-1234 or 1 (212) 555-1234")] == ["phone"]
    for long in ("1" * 100_000, "a" * 100_000 + " (at) x", "1 " * 50_000, "(" * 100_000 + "1", "a@b.co " * 5_000 + "b.co " * 5_000):
        pii.find(long, field)  # in time that grows with the text
    for clean in ("in 1984 there were 12 of them", "version 12 of 2020-01-02", "no digits here", "", "number 1234567890123456 only"):
        assert added(clean) == []


def test_marginals():
    """Exact on a chain, and near the truth on a circle, by all labellings of four words."""
    field, _ = pii_field()
    none = np.empty((0, 2), np.int64)
    pairs = lambda *p: np.array(p, np.int64).reshape(-1, 2)
    active = [pii.features(w) for w in ("4111111111111112", "jane", "10.1.2.3", "x@y")]
    for links, most in (((pairs((0, 1), (1, 2)), pairs((2, 3)), none), 1e-5), ((pairs((0, 1), (1, 2), (2, 3)), pairs((0, 3)), pairs((0, 2))), 0.1)):
        for observed in ([0, 0, 0, 0], [0, 2, 0, 0]):
            g = pii.Graph([(0, 1)] * 4, active, np.array(observed), links)
            own, want = field.scores(g), np.zeros((4, 5))
            for labels in itertools.product(range(5), repeat=4):
                score = sum(own[i, k] for i, k in enumerate(labels)) + sum(t[labels[i], labels[j]] for t, x in zip(field.tables, links) for i, j in x.tolist())
                for i, k in enumerate(labels):
                    want[i, k] += np.exp(score)
            want /= want.sum(1, keepdims=True)
            assert abs(field.marginals(g) - want).max() < most


def test_passages(spark):
    r = random.Random(6)
    new = lambda n: [f"v{r.randrange(10**7)}" for _ in range(n)]
    passage, texts = new(60), []
    for i in range(30):
        p = list(passage)
        if i % 3 == 1:
            p[20] = "changed"
        texts.append(" ".join(new(i * 3) + p + new(10)))
    texts += [" ".join(passage[:30] + new(50)), " ".join(new(200)), None, "", "short"] + [" ".join(new(70))] * 2
    rows = passages.repeated_passages(frame(spark, texts)).collect()
    of = {}
    for x in rows:
        of.setdefault(x.doc_id, []).append((x.start_word, x.end_word))
    for i in range(30):
        assert any(a <= 3 * i + 2 and b >= 3 * i + 58 for a, b in of[i]), i
    assert set(of) == {*range(30), 35, 36} and of[35] == of[36] == [(0, 70)]
    assert passages.repeated_passages(frame(spark, []).limit(0)).count() == 0


def alike_around(a, b, ca, cb, width, low):
    """Whether any two windows through the anchor, of `width` to twice as many tokens, are similar enough."""
    for m, n in itertools.product(range(width, 2 * width + 1), repeat=2):
        for x in range(max(0, ca - m + 1), min(ca, len(a) - m) + 1):
            for y in range(max(0, cb - n + 1), min(cb, len(b) - n) + 1):
                one, two = set(a[x : x + m].tolist()), set(b[y : y + n].tolist())
                if len(one & two) >= low * len(one | two):
                    return True
    return False


def test_passages_with_an_edit_in_each_copy():
    wanted = 0
    for seed in range(60):
        r = random.Random(seed)
        passage, sides = [r.randrange(10**6) for _ in range(16)], []
        for _ in range(2):
            p, at = list(passage), r.randrange(16)
            p[at : at + r.randrange(2)] = [r.randrange(10**6, 10**9)] * r.randrange(3)
            sides.append(np.array([r.randrange(10**6, 10**9) for _ in range(r.randrange(6))] + p + [r.randrange(10**6, 10**9) for _ in range(r.randrange(6))], np.uint32))
        a, b = sides
        ca, cb = r.choice([(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]])
        found = passages.aligned(passages.Index(a), b, [(ca, cb)], 10, 0.8)
        want = alike_around(a, b, ca, cb, 10, 0.8)
        assert found or not want, seed
        wanted += want
        for xa, ya, xb, yb in found:
            assert min(ya - xa, yb - xb) + 1 >= 10
            assert passages.similar(a[xa : ya + 1], b[xb : yb + 1], 0.8)
    assert wanted > 30
    # 50 words with one changed in the middle: 41 of 51 shingles
    a = np.arange(1000, 1246, dtype=np.uint32)
    b = np.concatenate([np.arange(100), a[100:121], np.arange(5000, 5005), a[126:146], np.arange(200, 300)]).astype(np.uint32)
    assert passages.aligned(passages.Index(a), b, [(110, 110)], 46, 0.8) == [(100, 145, 100, 145)]


def test_short_near_passages_are_met(spark):
    r = random.Random(12)
    new = lambda n: [f"v{r.randrange(10**9)}" for _ in range(n)]
    texts = []
    for _ in range(150):
        p = new(50)
        texts += [" ".join(new(30) + p + new(30)), " ".join(new(30) + p[:25] + new(1) + p[26:] + new(30))]
    rows = passages.repeated_passages(frame(spark, texts)).collect()
    met = {x.doc_id for x in rows if x.start_word <= 32 and x.end_word >= 78}
    assert len(met) >= 0.98 * len(texts)
    assert passages.hashes_for(0.8, 0.01) == 5 and 0.2**5 + 5 * 0.8 * 0.2**4 < 0.01 < 0.2**4 + 4 * 0.8 * 0.2**3


def test_passages_at_every_place_of_the_first_document(spark):
    r = random.Random(7)
    new = lambda n: [f"v{r.randrange(10**9)}" for _ in range(n)]
    footer, later = new(60), [new(60) for _ in range(12)]
    texts = [" ".join(new(20) + footer + new(40) + footer + new(30) + footer), " ".join(new(50) + footer)]
    for p in later:  # a fragment too short to count stands before the passage, of which the other has a copy
        texts += [" ".join(p[:40] + new(60) + p), " ".join(new(10) + p)]
    found = {(x.doc_id, x.start_word, x.end_word, x.first_doc_id) for x in passages.repeated_passages(frame(spark, texts)).collect()}
    holds = lambda doc, at: any(d == doc and x <= at and y >= at + 60 for d, x, y, _ in found)
    assert all(holds(0, at) for at in (20, 120, 210)) and holds(1, 50)
    assert all(holds(2 + 2 * i, 100) and holds(3 + 2 * i, 10) for i in range(len(later)))
    p = np.arange(60, dtype=np.uint32)
    a = np.concatenate([p[:40], np.arange(100, 150), p, np.arange(200, 230), p]).astype(np.uint32)
    assert sorted(passages.aligned(passages.Index(a), p, [(5, 5)], 46, 0.8)) == [(90, 149, 0, 59), (180, 239, 0, 59)]


def test_compact_windows():
    rng, width = np.random.default_rng(1), 8
    for _ in range(20):
        first = np.concatenate([[0], np.cumsum(rng.integers(0, 40, 5))])
        tokens = rng.integers(0, 60, first[-1]).astype(np.uint64)
        doc, function, sig, place, low, high, context = passages.compact_windows(tokens, first, width, 2)
        got = set(zip(*(c.tolist() for c in (doc, sig, place, low, high))))
        w = passages.packed(place, function, low, high, width)
        assert all((x == y).all() for x, y in zip(passages.unpacked(w), (place, function, np.maximum(low, place - width + 1), np.minimum(high, place + width - 1))))
        want = set()
        for f, d in itertools.product(range(2), range(5)):
            t = tokens[first[d] : first[d + 1]]
            seed = np.uint64(0x9E3779B97F4A7C15 * (f + 1) % (1 << 64))
            with np.errstate(over="ignore"):
                sig = passages.mix(passages.mix(t) + seed).tolist()
                v = [(x >> 20, i) for i, x in enumerate(passages.mix(t + seed).tolist())]
            for i in range(len(t)):
                for j in range(i + width - 1, len(t)):
                    c = min(v[i : j + 1])[1]
                    low = max([k + 1 for k in range(c) if v[k] < v[c]], default=0)
                    high = min([k - 1 for k in range(c + 1, len(t)) if v[k] < v[c]], default=len(t) - 1)
                    want.add((d, sig[c], c, low, high))
        assert got == want


def test_interval_join(spark):
    r, width, rows = random.Random(3), 10, []
    for a, b in itertools.combinations(range(7), 2):
        for _ in range(r.randrange(7)):
            f, w = r.randrange(3), []
            for _ in range(2):
                place = r.randrange(16)
                w.append((place, f, max(0, place - r.randrange(16)), place + r.randrange(16)))
            rows.append((a, b, *w))
    pack = lambda w: int(passages.packed(*(np.array([x]) for x in w), width)[0])
    table = spark.createDataFrame([(a, b, pack(x), pack(y)) for a, b, x, y in rows], "a long, b long, wa long, wb long")
    got = {(x.a, x.b, p.pa, p.pb) for x in passages.interval_join(table, width).collect() for p in x.anchors}

    def meet(x, y):
        return x[1] != y[1] and any(max(x[2], y[2]) <= i <= min(x[0], y[0]) and max(x[0], y[0]) <= i + width - 1 <= min(x[3], y[3]) for i in range(80))

    assert got == {(x[0], x[1], x[2][0], x[3][0]) for x in rows if any(x[:2] == y[:2] and meet(x[2], y[2]) and meet(x[3], y[3]) for y in rows)}
    assert 5 < len(got) < len(rows)


def test_partners(spark):
    r = random.Random(4)
    rows = [(r.randrange(6), r.randrange(4), r.randrange(9), i) for i in range(300)]
    found = passages.partners(spark.createDataFrame(rows, "sig long, context int, doc_id long, w long").repartition(3)).collect()
    of = {w: (sig, context, doc) for sig, context, doc, w in rows}
    for x in found:  # partners are of one list and of two documents
        assert of[x.w][0] == of[x.other_w][0] and (of[x.w][2], of[x.other_w][2]) == (x.doc_id, x.other) and x.doc_id != x.other
    assert 200 < len(found) <= 2 * 300 + 20
    for sig in range(6):  # the documents of a list are joined to one another
        docs = {doc for s, _, doc in of.values() if s == sig}
        root = roots(9, [(x.doc_id, x.other) for x in found if of[x.w][0] == sig])
        assert len({root[d] for d in docs}) == 1


def test_passages_against_all_windows(spark):
    """Every document of which some 14 words are in another, exactly or with 0.8 of the shingles of both."""
    r = random.Random(8)
    new = lambda n: [f"v{r.randrange(10**9)}" for _ in range(n)]
    bank, texts = [new(18) for _ in range(25)], []
    for i in range(150):
        p = list(bank[r.randrange(25)])
        if i % 2:
            p[r.randrange(1, 17) if i % 4 == 1 else 0] = "z" + str(i)
        cut = r.randrange(9)
        texts.append(new(r.randrange(12)) + p[cut // 3 : len(p) - cut // 2] + new(r.randrange(12)))
    width, sets = 10, []
    for t in texts:
        s = [tuple(t[i : i + 5]) for i in range(len(t) - 4)]
        sets.append([(i, n, frozenset(s[i : i + n])) for n in range(width, width + 5) for i in range(len(s) - n + 1)])
    of = {}
    for d, windows in enumerate(sets):
        for w in windows:
            for token in w[2]:
                of.setdefault(token, set()).add(d)
    want = set()
    for d, windows in enumerate(sets):
        near = set().union(*(of[t] for w in windows for t in w[2])) - {d} if windows else set()
        if any(len(w[2] & v[2]) >= 0.8 * len(w[2] | v[2]) for e in near for w in windows for v in sets[e]):
            want.add(d)
    found = passages.repeated_passages(frame(spark, [" ".join(t) for t in texts]), min_words=14)
    got = {x.doc_id for x in found.collect()}
    assert len(want) > 60 and got <= want and len(got) >= 0.9 * len(want)


def test_long_ids_and_odd_columns(spark):
    big = [2**63 - 1, -(2**63), 2**63 - 2, 4 * 10**18, -(2**62), 5]
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(i, text if k else None, "x", "s", k, 0, "l", 0) for k, i in enumerate(big)], DOCS)
    docs = docs.unionByName(docs).withColumns({"sig": F.lit(1), "place": F.lit(""), "__mix_rate": F.lit(1), "k1": F.lit("k"), "component_id": F.lit(3)})
    rows = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert rows == {i: -(2**63) if i == -(2**63) or k else i for k, i in enumerate(big)}
    assert {(r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in passages.repeated_passages(docs).collect()} == {(i, 0, 80, -(2**63)) for i in big[1:]}
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted([big[0], -(2**63)])


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_are_told_apart(spark, n):
    docs = frame(spark, [thue_morse(n), thue_morse(n, "b", "a"), thue_morse(n)])
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()} == {0: 0, 1: 1, 2: 0}
    want = {i: len(library("word_bpe_49k.json").encode(r.text, add_special_tokens=False).ids) for i, r in enumerate(docs.collect())}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()} == want


def vector_frame(spark, n=300):
    """Vectors of 16 dimensions, and of 3 and 1; rows that can't be used; one id on different vectors; ids near 2^63."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((n, 16)).astype(np.float32).astype(float)
    x[50:90] = x[50] + (0.08 * rng.standard_normal((40, 16))).astype(np.float32)
    x[100:103] = x[100]
    x = x.astype(np.float32).astype(float)
    rows = [(i, v.tolist(), i % 3, "e") for i, v in enumerate(x)]
    rows += [(n + i, v, 0, "e") for i, v in enumerate([[1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [1.0, -2.0, 0.5], [2.0], [3.0], [1.0, 2.0, 3.125]])]
    rows += [(2**63 - 1, x[50].tolist(), 0, "e"), (-(2**63), x[200].tolist(), 0, "e"), (200, x[51].tolist(), 0, "e")]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [], [float("inf")] + [1.0] * 15]
    rows += [(n + 10 + i, v, 0, "e") for i, v in enumerate(odd)] + [(None, x[0].tolist(), 0, "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string").withColumns({"dim": F.lit("d"), "k1": F.lit(1), "leaf": F.lit(2), "component": F.lit(3)})
    return df, rows, n + 10


def unit(v):
    v = np.array(v, float)
    return v / np.linalg.norm(v)


def plain_cosine(a, b):
    return float(unit(a) @ unit(b)) if len(a) == len(b) else -2.0


def test_near_duplicate_vectors(spark):
    df, rows, odd = vector_frame(spark)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, window=16).collect() if r.vec_id is not None)
    good = [r for r in rows if r[0] is not None and not odd <= r[0] < odd + 6]
    links = [(i, j) for i, j in itertools.combinations(range(len(good)), 2) if plain_cosine(good[i][1], good[j][1]) >= 0.95]
    root, least, n = roots(len(good), links), {}, [0] * len(good)
    for i, r in enumerate(root):
        least[r] = min(least.get(r, 2**63), good[i][0])
    for p in links:
        for i in p:
            n[i] += 1
    # the id 200 stands on two different vectors: each keeps its own component
    want = [(r[0], n[i], least[root[i]], r[0] == least[root[i]]) for i, r in enumerate(good)] + [(odd + i, 0, odd + i, True) for i in range(6)]
    assert len(links) > 100 and got == sorted(want)
    assert [(r.n_links, r.component_id) for r in vectors.near_duplicates(df.where("vec_id is null")).collect()] == [(0, None)]
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_passes_find_pairs_in_a_cone(spark):
    """A third of the rows crowd around one direction; pairs planted at the threshold are found among them as elsewhere."""
    rng = np.random.default_rng(2)
    n, dim = 3000, 32
    x = rng.standard_normal((n, dim))
    x[: n // 3] = 3.0 * rng.standard_normal(dim) + 0.5 * x[: n // 3]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.standard_normal((300, dim))
    at = np.concatenate([np.arange(150), np.arange(n // 3, n // 3 + 150)])
    u -= (u * x[at]).sum(1, keepdims=True) * x[at]
    y = 0.953 * x[at] + np.sqrt(1 - 0.953**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, window=32).collect()}
    z = np.concatenate([x, y])
    hit = z @ z.T >= 0.95
    np.fill_diagonal(hit, False)
    want = roots(len(z), np.argwhere(np.triu(hit)).tolist())
    linked = [i for i in range(len(z)) if hit[i].any()]
    assert len(linked) >= 600 and np.mean([got[i][1] == want[i] for i in linked]) >= 0.99
    assert all(got[i][0] == 0 for i in range(len(z)) if not hit[i].any())


def test_nearest(spark):
    df, rows, odd = vector_frame(spark)
    found = vectors.nearest(df, F.col("vec_id") % 10 == 0, leaf_rows=16).collect()
    good = [r for r in rows if r[0] is not None and not odd <= r[0] < odd + 6]
    got, hit, all_ = {}, 0, 0
    for r in found:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in {r[0] for r in good if r[0] % 10 == 0}:
        of, own = {}, [r[1] for r in good if r[0] == q]
        for r in good:
            if r[0] != q:
                c = max(plain_cosine(v, r[1]) for v in own)
                if c > -2:
                    of[r[0]] = max(c, of.get(r[0], -2))
        want = sorted(of, key=lambda i: (-of[i], i))[:5]
        here = sorted(got.get(q, []))
        assert [h[0] for h in here] == list(range(1, len(want) + 1)), q
        assert all(any(abs(h[2] - plain_cosine(v, r[1])) < 1e-12 for v in own for r in good if r[0] == h[1]) for h in here) and [h[2] for h in here] == sorted((h[2] for h in here), reverse=True)
        hit, all_ = hit + len({h[1] for h in here} & set(want)), all_ + len(want)
    assert hit >= 0.9 * all_ and len(got[300]) == 3
    few = vectors.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert [r.rank for r in few] == [1, 2]
    assert vectors.nearest(df.limit(0), F.lit(True)).count() == 0


def test_forest_deepens_and_finds_few_leaves():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((400, 32))
    x = vectors.unit(centres[rng.integers(0, 400, 20000)] + 0.15 * rng.standard_normal((20000, 32)))
    sample = x[:4096]
    forest = vectors.Forest(sample, len(x), 32, 8, 1)
    assert forest.deep > 0 and vectors.Forest(sample, 128 * len(x), 32, 8, 1).deep == forest.deep + 7
    share = forest.calibrate(sample, 5, 0.97)
    leaves = forest.leaves(x)
    seen = hit = 0
    for i in range(0, len(x), 500):
        sims = x @ x[i]
        sims[i] = -2
        true = np.argsort(-sims)[:5]
        order = forest.order(x[i], bound=share * np.sqrt(2 - 2 * sims[true[-1]]))
        have = np.isin(leaves, order)
        seen, hit = seen + have.sum(), hit + have[true].any(1).sum()
    assert hit >= 0.9 * 5 * 40 and seen <= 0.25 * len(x) * 40
    assert forest.order(x[0], most=6) == forest.order(x[0])[:6]
