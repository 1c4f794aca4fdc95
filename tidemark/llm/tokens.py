"""Token ids and counts inside tasks, equal to those of the tokenizers library."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

#: Characters on which both libraries surely agree: ASCII, Latin letters and common punctuation. Texts with any other
#: character, and extremely long ones, go to the tokenizers library.
_UNUSUAL = re.compile("[^\\t\\n\\r\\x20-\\x7e¡-įı-ɏ–—‘’“”…€]")
_VERY_LONG = 1_000_000


def usual(text: str) -> bool:
    return len(text) <= _VERY_LONG and _UNUSUAL.search(text) is None


def path(name: str) -> str:
    """A vocabulary file by name, or a path as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(2)
def library(name: str):
    """The tokenizer of the tokenizers library, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path(name))
    t.no_truncation()
    t.no_padding()
    return t


def byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids of a byte-level BPE file; vocabulary order is merge order there."""

    def __init__(self, name: str):
        import tiktoken

        with open(path(name), encoding="utf-8") as f:
            j = json.load(f)
        named = byte_of()
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        ranks = {bytes(named[c] for c in k): v for k, v in j["model"]["vocab"].items() if k not in self.special}
        import public_tokenizers

        self._fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self._allowed = set(self.special)
        self._name = name

    def ids(self, text: str | None) -> np.ndarray:
        """Ids as uint32; none for null or empty text."""
        if not text:
            return np.empty(0, np.uint32)
        if usual(text):
            return np.asarray(self._fast.encode_to_numpy(text, allowed_special=self._allowed), np.uint32)
        return np.asarray(library(self._name).encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(2)
def byte_bpe(name: str) -> ByteBpe:
    return ByteBpe(name)
