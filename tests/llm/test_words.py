"""Hashes of words."""

import random

import xxhash

from tidemark.llm import shingles


def test_words_are_told_apart_byte_by_byte():
    r = random.Random(1)
    for most in (9, 17, 40, 300):
        word = lambda: bytes(r.choice(b"\x00ab\xc3") for _ in range(r.choice([1, 2, 3, 7, 8, 9, 16, 17, most])))  # noqa: B023, E731
        texts = [b" ".join(word() for _ in range(r.randrange(200))) for _ in range(5)]
        words = [w for t in texts for w in t.split(b" ") if w]
        data = b" ".join([*words, b""])
        ends = [0]
        for w in words:
            ends.append(ends[-1] + len(w) + 1)
        start, end = (shingles.np.array(x) for x in (ends[:-1], [e - 1 for e in ends[1:]]))
        number, found = shingles.different(data, start, end)
        assert [found[i] for i in number] == words and len(set(found)) == len(found)
        assert shingles.word_hashes(texts)[0].tolist() == [xxhash.xxh3_64_intdigest(w) for w in words]
    assert shingles.word_hashes([])[0].tolist() == shingles.word_hashes([b"", b" "])[0].tolist() == []
