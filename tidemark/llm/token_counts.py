"""Token counts by a compiled finite-state tokenizer, without making the tokens."""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches
from .shingles import cut
from .tokens import byte_of, path

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

# Classes of characters. The vocabulary's pattern, over lower-cased text, is
#   's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+
SPACE, LETTER, ONE, R, V, LL, E, NUMBER, QUOTE, OTHER = range(10)
#: White space as the pattern knows it: the Unicode property, without the separators 1C to 1F.
SPACES = ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: Letters, numbers and lower-case forms of Unicode 16 and 17 (fixed values), for where Python's own tables are older.
LATER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
LATER_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
LATER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATER_LOWER |= {i: i + 0x20 for i in range(0x10D50, 0x10D66)} | {i: i + 0x1B for i in range(0x16EA0, 0x16EB9)}
# States: before a word; in letters; in other characters; after a quote that began a word; after 'r, 'v, 'l
FRESH, LETTERS, OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
#: What a transition emits: nothing, a word that begins here, one that began at the character before, or both.
NOTHING, HERE, BEFORE, BOTH = range(4)


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) by state and class: the pattern above as a deterministic transducer.

    After a quote the word's extent is open for up to two characters; a transition that decides against a contraction
    emits, late, the word that began one character before.
    """
    go, out = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)
    start = {SPACE: (FRESH, NOTHING), NUMBER: (FRESH, HERE), QUOTE: (QUOTED, HERE), OTHER: (OTHERS, HERE)} | {c: (LETTERS, HERE) for c in (LETTER, ONE, R, V, LL, E)}
    for state in range(7):
        for c in range(10):
            go[state, c], out[state, c] = start[c]
    for c in (LETTER, ONE, R, V, LL, E):
        go[LETTERS, c], out[LETTERS, c] = LETTERS, NOTHING
    for c in (QUOTE, OTHER):
        go[OTHERS, c], out[OTHERS, c] = OTHERS, NOTHING
        go[QUOTED, c], out[QUOTED, c] = OTHERS, NOTHING
    go[QUOTED, ONE], out[QUOTED, ONE] = FRESH, NOTHING
    for c, state, last in ((R, QUOTED_R, E), (V, QUOTED_V, E), (LL, QUOTED_L, LL)):
        go[QUOTED, c], out[QUOTED, c] = state, NOTHING
        for d in (LETTER, ONE, R, V, LL, E):
            go[state, d], out[state, d] = LETTERS, BEFORE
        go[state, last], out[state, last] = FRESH, NOTHING
        out[state, SPACE] = BEFORE
        for d in (NUMBER, QUOTE, OTHER):
            out[state, d] = BOTH
    return go, out


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    of = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kind = np.array([ord(unicodedata.category(chr(i))[0]) for i in range(len(of))], np.uint8)
    of[kind == ord("L")], of[kind == ord("N")] = LETTER, NUMBER
    for ranges, k in ((LATER_LETTERS, LETTER), (LATER_NUMBERS, NUMBER), (SPACES, SPACE)):
        for a, z in ranges:
            of[a : z + 1] = k
    for chars, k in (("stmd", ONE), ("r", R), ("v", V), ("l", LL), ("e", E), ("'", QUOTE)):
        for c in chars:
            of[ord(c)] = k
    return of


def word_starts(kinds: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Where words begin, as a mask over characters; kinds must end in a space.

    All chunks run at once. First each chunk is turned into its state map, the end state for every state it may begin
    in, by composing the transitions of its characters; then a parallel prefix scan composes the maps of neighbours over
    doubling distances, which gives the true state at the start of each chunk; then each chunk runs again from there and
    its transitions emit.
    """
    go, emit = transducer()
    n = len(kinds)
    rows = -(-n // chunk)
    grid = np.zeros(rows * chunk, np.uint8)
    grid[:n] = kinds
    columns = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    flat, wide = go.ravel(), 10
    maps = np.tile(np.arange(7, dtype=np.uint8), (rows, 1))
    for j in range(chunk):
        maps = flat[maps * np.uint8(wide) + columns[j][:, None]]
    reach = 1
    while reach < rows:
        later = np.take_along_axis(maps[reach:], maps[:-reach], 1)
        maps = np.concatenate([maps[:reach], later])
        reach *= 2
    state = np.concatenate([np.zeros(1, np.uint8), maps[:-1, FRESH]])
    said = np.empty((chunk, rows), np.uint8)
    flat_out = emit.ravel()
    for j in range(chunk):
        at = state * np.uint8(wide) + columns[j]
        said[j] = flat_out[at]
        state = flat[at]
    said = np.ascontiguousarray(said.T).ravel()[:n]
    starts = (said & 1).astype(bool)
    starts[:-1] |= said[1:] >= BEFORE
    return starts


class Compiled:
    """The vocabulary's merges as a deterministic transducer over the bytes of a word.

    Of what has been read, a token sequence by the merges is known for every prefix (its last token and its length), and
    tells all that is to come: a token that ends here, and stands on a prefix whose last token keeps apart from it, is the
    last one here; there is just one. A state is the set of places where a token that is still open may have begun, each
    with its node in the tree of tokens, the last token before it and how many tokens have been emitted since. A
    transition carries the change in the number of tokens, below 0 where bytes join in fewer ones. The last byte of a word
    is a symbol of its own, as the vocabulary has it.
    States and transitions are made as they are met, and thrown away together when there are `most` of them, so memory is
    bounded whatever the corpus holds. Short words run side by side, a symbol of each at a time, through the
    transitions as a hash table of arrays.
    """

    SLOTS, SHORT, LOT = 1 << 20, 64, 1 << 18

    def __init__(self, name: str, most: int = 300_000):
        with open(path(name), encoding="utf-8") as f:
            j = json.load(f)
        self.special = [t["content"] for t in j["added_tokens"]]
        vocab, suffix = j["model"]["vocab"], j["model"]["end_of_word_suffix"]
        symbol = {c: b for c, b in byte_of().items()} | {c + suffix: 256 + b for c, b in byte_of().items()}
        #: By pair: rank and token; by token: left part, right part, rank.
        self.joins: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        spelled = {vocab[c]: (s,) for c, s in symbol.items()}
        self.base = {s: vocab[c] for c, s in symbol.items()}
        for rank, pair in enumerate(j["model"]["merges"]):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[x], vocab[y], vocab[x + y]
            self.joins[x, y], self.parts[z] = (rank, z), (x, y, rank)
            spelled[z] = spelled[x] + spelled[y]
        self.fine: dict[int, bool] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        # the tree of tokens: children by 512 * node + symbol, token by node
        self.children, self.token, nodes = {}, {}, 1
        for token, symbols in spelled.items():
            if not self.keeps(token):
                continue
            at = 0
            for s in symbols:
                to = self.children.get(512 * at + s)
                if to is None:
                    to = self.children[512 * at + s] = nodes
                    nodes += 1
                at = to
            self.token[at] = token
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.states, self.number = [((0, -1, 0),)], {((0, -1, 0),): 0}
        self.go: dict[int, tuple[int, int]] = {}
        self.keys, self.to, self.change = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS, np.int32), np.zeros(self.SLOTS, np.int8)

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """(token, rank of the merge that takes it up) at one end of a token, from the whole to its outermost symbol."""
        out, taken = [], float("inf")
        while True:
            out.append((token, taken))
            if token not in self.parts:
                return out
            taken, token = self.parts[token][2], self.parts[token][side]

    def crosses(self, x: int, y: int, limit: float) -> bool:
        """Whether a merge of a lower rank than the limit joins something across the border of x and y: both sides must
        be there when its turn comes, and of equal merges the left one comes first."""
        for a, a_taken in self.spine(x, 1):
            for b, b_taken in self.spine(y, 0):
                rank = self.joins.get((a, b), (limit,))[0]
                if rank < limit and rank < a_taken and rank <= b_taken:
                    return True
        return False

    def keeps(self, token: int) -> bool:
        """Whether the merges make the token from its own symbols."""
        if token not in self.fine:
            x, y, rank = self.parts.get(token, (None, None, None))
            self.fine[token] = x is None or (self.keeps(x) and self.keeps(y) and not self.crosses(x, y, rank))
        return self.fine[token]

    def stand(self, x: int, y: int) -> bool:
        """Whether x and then y stay two tokens."""
        found = self.apart.get((x, y))
        if found is None:
            if len(self.apart) > self.most:
                self.apart.clear()
            found = self.apart[x, y] = not self.crosses(x, y, float("inf"))
        return found

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """Make a transition: (next state, change in the number of tokens)."""
        open_, last, change = [], -1, 0
        for node, before, since in self.states[state]:
            to = self.children.get(512 * node + symbol)
            if to is None:
                continue
            open_.append((to, before, since))
            token = self.token.get(to)
            if token is not None and (before < 0 or self.stand(before, token)):
                last, change = token, 1 - since
        key = (*((node, before, since + change) for node, before, since in open_), (0, last, 0))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        found = self.go[512 * state + symbol] = to, change
        return found

    def count(self, word: bytes) -> int:
        if len(self.go) > self.most:
            self.forget()
        go, state, n = self.go, 0, 0
        for s in word[:-1]:
            found = go.get(512 * state + s)
            if found is None:
                if len(go) > self.most and state:  # in the midst of a long word: only its state is kept
                    key = self.states[state]
                    self.forget()
                    go, state = self.go, self.number.setdefault(key, 1)
                    self.states.append(key)
                found = self.step(state, s)
            state, change = found
            n += change
        last = 512 * state + 256 + word[-1]
        return n + (go.get(last) or self.step(state, 256 + word[-1]))[1]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where the keys are in the table, or would be."""
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        there = self.keys[slot]
        on = np.flatnonzero((there != keys) & (there >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) % self.SLOTS
            there = self.keys[slot[on]]
            on = on[(there != keys[on]) & (there >= 0)]
        return slot

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Token counts of words, none of them empty."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        for i in np.flatnonzero(size > self.SHORT).tolist():
            out[i] = self.count(words[i])
        short = np.flatnonzero(size <= self.SHORT)
        lot = np.cumsum(size[short]) // self.LOT
        for one in np.split(short, np.flatnonzero(np.diff(lot)) + 1):
            if len(self.go) > self.most:
                self.forget()
            one = one[np.argsort(-size[one], kind="stable")]
            data = np.frombuffer(b"".join([words[i] for i in one.tolist()]), np.uint8)
            n = size[one]
            begin, state, total = np.cumsum(n) - n, np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
            for k in range(int(n[0]) if len(n) else 0):
                live = int(np.searchsorted(-n, -k))  # those with more than k symbols
                key = 512 * state[:live] + data[begin[:live] + k] + 256 * (n[:live] == k + 1)
                slot = self.slots(key)
                new = np.flatnonzero(self.keys[slot] < 0)
                if len(new):
                    for x in np.unique(key[new]).tolist():
                        found = self.go.get(x) or self.step(x // 512, x % 512)
                        at = int(self.slots(np.array([x]))[0])
                        self.keys[at], self.to[at], self.change[at] = x, *found
                    slot[new] = self.slots(key[new])
                state[:live] = self.to[slot]
                total[:live] += self.change[slot]
            out[one] = total
        return out


@functools.lru_cache(1)
def compiled(tokenizer: str) -> Compiled:
    return Compiled(tokenizer)


_LATER = re.compile("[" + "".join(map(chr, LATER_LOWER)) + "]")


def plain(text: str) -> str:
    """The text as the vocabulary's normaliser leaves it, but for white space: composed, and each letter in lower case
    whatever stands next to it."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if _LATER.search(text):
            text = text.translate(LATER_LOWER)
    return text.lower()


def count_tokens(texts: list[str], tokenizer: str) -> np.ndarray:
    """Token counts of texts without special strings, in one go."""
    texts = [plain(t) for t in texts]
    joined = " ".join(texts) + " "
    ends = np.cumsum([len(t) + 1 for t in texts])
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kinds = classes()[code]
    begins = word_starts(kinds)
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(len(texts), np.int64)
    # a word ends where the next begins or at the next space
    edges = np.flatnonzero(begins | (kinds == SPACE))
    end = edges[np.searchsorted(edges, start, side="right")]
    raw = joined.encode()
    if len(raw) > len(code):
        at = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])
        number, words = cut(raw, at[start], at[end])
    else:
        number, words = cut(raw, start, end)
    of, used = np.zeros(len(words), np.int64), np.unique(number)
    of[used] = compiled(tokenizer).counts([words[i] for i in used.tolist()])
    sums = np.concatenate([[0], np.cumsum(of[number])])
    edge = np.searchsorted(start, np.concatenate([[0], ends]))
    return sums[edge[1:]] - sums[edge[:-1]]


def token_counts(docs: DataFrame, limit: int = 2048, tokenizer: str = "word_bpe_49k.json", batch: int = 1 << 18) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each row of documents.

    Counts are those of the tokenizers library with its defaults for special strings inside texts, one token each, and
    without added tokens; that library takes no part. Texts are cut into words by a transducer over characters, whose
    chunks run side by side (word_starts), and each different word of a batch runs through the transducer of the merges
    (Compiled). Null counts as empty: 0 bytes, 0 tokens. Rows with one id, and null ids, are counted each. Nothing is
    shuffled; memory follows the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = re.compile("|".join(map(re.escape, compiled(tokenizer).special)) or "(?!)")
        for b in batches:
            out, held, size = np.zeros(b.num_rows, np.int64), [], 0
            for i, text in enumerate(b.column(1)):
                parts = special.split(text.as_py() or "")
                out[i] = len(parts) - 1
                held += [(i, p) for p in parts if p]
                size += sum(map(len, parts))
                if held and size > batch:
                    np.add.at(out, [x[0] for x in held], count_tokens([x[1] for x in held], tokenizer))
                    held, size = [], 0
            if held:
                np.add.at(out, [x[0] for x in held], count_tokens([x[1] for x in held], tokenizer))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out), pa.array(out > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return of.withColumn("n_bytes", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long"))).mapInArrow(run, SCHEMA)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_counts() of all documents by word_bpe_49k.json, with a limit of 2,048."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
