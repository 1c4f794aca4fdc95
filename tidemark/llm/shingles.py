"""Sets of word n-grams, as 64-bit hashes, for whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no bit in its place."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def cut(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each piece data[start:end], the different pieces); pieces are compared byte by byte. They must be in
    order and not overlap."""
    if not len(start):
        return np.empty(0, np.int32), []
    edges = np.empty(2 * len(start), np.int32)
    edges[0::2], edges[1::2] = start, end
    # pieces and what lies between them, by turns
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
    return coded.indices.to_numpy()[::2], coded.dictionary.to_pylist()


def different(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each piece data[start:end], the different pieces), as cut() has them. Pieces are known by a number that
    comes of 8 bytes at a time, and then compared with the first one that has the same number, byte by byte."""
    size = end - start
    if not len(size) or size.max() > 256:
        return cut(data, start, end)
    eights = np.ndarray(len(data), np.dtype("<u8"), data + bytes(8), strides=(1,))
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    part = lambda i, at: eights[start[i] + at] & mask[np.minimum(size[i] - at, 8)]
    every = np.arange(len(size))
    key = part(every, 0) + size.astype(np.uint64) * np.uint64(_ODD[0])
    longer, at = np.flatnonzero(size > 8), 8
    while len(longer):
        key[longer] = mix(key[longer]) + part(longer, at)
        at += 8
        longer = longer[size[longer] > at]
    number = pa.array(key).dictionary_encode().indices.to_numpy()
    first = np.empty(number.max() + 1, np.int64)
    first[number[::-1]] = every[::-1]
    same, at = first[number], 0
    if (size[same] != size).any():
        return cut(data, start, end)
    while len(every):
        if (part(every, at) != part(same[every], at)).any():
            return cut(data, start, end)
        at += 8
        every = every[size[every] > at]
    return number, [data[a:z] for a, z in zip(start[first].tolist(), end[first].tolist())]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit xxHash of every word, first word of every text and the end). Words are `[^\\x20\\x09-\\x0D]+`, A-Z as a-z."""
    joined = b" ".join([*texts, b""]).lower()
    b = np.frombuffer(joined, np.uint8)
    ends_at = np.cumsum([len(t) + 1 for t in texts])
    if not len(b):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    start, end = edge[0::2], edge[1::2]  # every text is followed by a space
    number, words = different(joined, start, end)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[number] if len(words) else np.empty(0, np.uint64)
    return h, np.searchsorted(start, np.concatenate([[0], ends_at]))


def shingles(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """For every text the hashes of its n-word shingles in word order; with fewer words the one of all of them; none
    without words."""
    words, first = word_hashes(texts)
    with np.errstate(over="ignore"):
        def combine(k):
            total = np.full(max(0, len(words) - k + 1), k, np.uint64)
            for i in range(k):
                total += words[i : len(words) - k + 1 + i] * np.uint64(_ODD[i % 8] + 2 * (i // 8))
            return mix(total)

        whole = combine(n)
        shorter: dict[int, np.ndarray] = {}
        for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
            k = z - a
            if k >= n:
                yield whole[a : z - n + 1]
            elif k == 0:
                yield words[:0]
            else:
                if k not in shorter:
                    shorter[k] = combine(k)
                yield shorter[k][a : a + 1]


def chunks(column, most: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) of an Arrow string column, about `most` bytes at a time; null as empty."""
    held, size, first = [], 0, 0
    for i, x in enumerate(column):
        t = x.as_buffer()
        held.append(t.to_pybytes() if t is not None else b"")
        size += len(held[-1])
        if size >= most:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held
