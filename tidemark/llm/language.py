"""Language identification: scripts narrow the candidates, a Viterbi path over word scores labels spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches
from .shingles import mix

#: Runs of letters and their marks; longer runs (scripts without spaces) are cut.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’]{0,31}")
#: Hash places of each order's n-grams.
PLACES = 1 << 16
ORDERS = 4
#: Weight of the shorter context, in occurrences.
BACKOFF = 4.0
#: What a change of language costs, in nats.
PENALTY = 12.0
#: Of a language's letters, the share in a script from which on it is a candidate for words of that script.
LEAST_SHARE = 0.001
#: Characters of text that are cut into words at a time.
PIECE = 1 << 22

# First code points of ranges and the script of what follows, by Unicode's blocks.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2C00, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x2E80, "han"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0x10000, "other"), (0x1B000, "kana"), (0x1B170, "other"), (0x20000, "han"),
)
_FIRST = np.array([f for f, _ in SCRIPTS])
NAMES = sorted({s for _, s in SCRIPTS})
_OF = np.array([NAMES.index(s) for _, s in SCRIPTS])


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 2 on division by 4. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(number of the word at each place, the different words in lower case, place of each text's first word and the end)."""
    known: dict[str, int] = {}
    numbers, first = [], [0]
    for t in texts:
        found = WORD.findall(t)
        numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in found), np.int32, len(found)))
        first.append(first[-1] + len(found))
    lower: dict[str, int] = {}
    to = np.fromiter((lower.setdefault(w.lower(), len(lower)) for w in known), np.int32, len(known))
    return to[np.concatenate(numbers)] if known else np.empty(0, np.int32), list(lower), np.array(first)


@dataclass
class Grams:
    """The n-grams of words, each with `^` before and `$` behind it, as places in the tables of the orders 1 to ORDERS."""

    words: list[str]
    length: np.ndarray = field(init=False)  # characters, with the end mark
    begin: np.ndarray = field(init=False)
    places: list[np.ndarray] = field(init=False)  # of each order, for every character
    context: list[np.ndarray] = field(init=False)  # places of what stands before it, in the table of the order below
    heads: list[np.ndarray] = field(init=False)  # of each order, for every `^`
    script: np.ndarray = field(init=False)

    def __post_init__(self):
        code = np.frombuffer("".join("^" + w + "$" for w in self.words).encode("utf-32-le"), np.uint32)
        marked = np.fromiter(map(len, self.words), np.int64, len(self.words)) + 2
        self.length = marked - 1
        at = np.cumsum(marked) - marked
        inner = np.ones(len(code), bool)
        inner[at] = False
        here = np.flatnonzero(inner)
        self.begin = np.cumsum(self.length) - self.length
        place = here - np.repeat(at, self.length)  # from 1: how many characters stand before
        h = np.zeros(len(code), np.uint64)
        self.places, self.context, self.heads, before = [], [], [], None
        for order in range(1, ORDERS + 1):
            # the hash of the last `order` characters; at a word's beginning there are fewer
            lag = order - 1
            shifted = np.zeros(len(code), np.uint64)
            shifted[lag:] = code[: len(code) - lag] if lag else code
            far = place >= lag
            value = np.where(far, shifted[here], 0)
            with np.errstate(over="ignore"):
                h[here] = mix(h[here] * np.uint64(0x9E3779B97F4A7C15) + value + np.uint64(1))
                h[at] = mix(h[at] * np.uint64(0x9E3779B97F4A7C15) + (code[at] if order == 1 else np.uint64(0)) + np.uint64(1))
            if order > 1:
                self.context.append(before[here - 1])
            before = (h % np.uint64(PLACES)).astype(np.int64)
            self.places.append(before[here])
            self.heads.append(before[at])
        letter = code[at + 1] if len(self.words) else code
        self.script = _OF[np.searchsorted(_FIRST, letter, side="right") - 1]


@dataclass
class Model:
    """Counts of n-grams by language, in tables of a fixed size, and the candidates of each script."""

    languages: list[str]
    counts: list[np.ndarray]  # for each order, places x languages
    candidates: np.ndarray  # scripts x languages

    def scores(self, words: list[str]) -> np.ndarray:
        """log P(word | language) for every word and language, -inf for languages that are no candidates of its script; all
        0 where no language is one."""
        g = Grams(words)
        p = None
        for order in range(ORDERS):
            n = self.counts[order]
            if order == 0:
                p = (n[g.places[0]] + 0.5) / (n.sum(0) + 0.5 * 256)
            else:
                p = (n[g.places[order]] + BACKOFF * p) / (self.counts[order - 1][g.context[order - 1]] + BACKOFF)
        out = np.add.reduceat(np.log(np.minimum(p, 1.0)), g.begin, axis=0) if len(words) else np.zeros((0, len(self.languages)))
        fits = self.candidates[g.script]
        return np.where(fits.any(1)[:, None], np.where(fits, out, -np.inf), 0.0)


def viterbi(number: np.ndarray, scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word on the best path of each text: the sum of word scores less the penalty for each change.

    Texts go side by side, the longest first, so that a step is one operation on all that are as long.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    n, start = n[order], first[:-1][order]
    steps, width = int(n[0]) if len(n) else 0, scores.shape[1]
    came = np.zeros((len(number), width), bool)  # whether a language was changed to, from the best one before
    best = np.zeros(len(number), np.int16)
    alive = np.searchsorted(-n, -np.arange(steps), side="left")  # texts longer than t
    floor = np.where(np.isneginf(scores), -1e6, scores)
    v = np.full((len(n), width), 0.0)
    for t in range(steps):
        k = alive[t]
        at, of = start[:k] + t, v[:k]
        if t:
            came[at] = of < -penalty
            np.maximum(of, -penalty, out=of)
        of += floor[number[at]]
        top = of.argmax(1)
        best[at] = top
        of -= of[np.arange(k), top][:, None]
    path, state = np.zeros(len(number), np.int16), np.zeros(len(n), np.int64)
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        at = start[:k] + t
        ends = n[:k] == t + 1
        state[:k][ends] = best[at[ends]]
        path[at] = state[:k]
        if t:
            state[:k] = np.where(came[at, state[:k]], best[at - 1], state[:k])
    return path


def of_one_language(number: np.ndarray, scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """For each text the language that is the best path from end to end, where that is sure; else -1.

    A path that leaves the language of the largest sum changes at least as often as it has stretches of other languages.
    So if no stretch of words gains more than the penalty by any one other language, no path is better.
    """
    texts, width = len(first) - 1, scores.shape[1]
    of = np.repeat(np.arange(texts), np.diff(first))
    sums = np.stack([np.bincount(of, np.maximum(scores[:, c], -1e3)[number], texts) for c in range(width)], axis=1)
    best = sums.argmax(1)
    gain = np.zeros(texts)
    for c in range(width):
        # the largest sum over a stretch: each sum up to a word, less the least one before it in the same text
        d = np.maximum((np.maximum(scores[:, c], -1e3)[:, None] - np.maximum(scores, -1e3))[number, best[of]], -1e3)
        after = np.cumsum(d)
        after -= np.repeat(np.concatenate([[0.0], after])[first[:-1]], np.diff(first))
        before = after - d
        step = (before.max() - before.min() + 1.0) * of
        stretch = after - (np.minimum.accumulate(before - step) + step)
        np.maximum.at(gain, of, stretch)
    return np.where(gain <= penalty - 0.01, best, -1)


def best_path(number: np.ndarray, scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """viterbi(), without its steps for texts whose path is sure to stay with one language."""
    if not len(number):
        return np.empty(0, np.int16)
    sure = of_one_language(number, scores, first, penalty)
    path = np.repeat(sure, np.diff(first)).astype(np.int16)
    rest = np.flatnonzero(sure < 0)
    if len(rest):
        n = np.diff(first)[rest]
        at = np.repeat(first[rest] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        path[at] = viterbi(number[at], scores, np.concatenate([[0], np.cumsum(n)]), penalty)
    return path


def _batches(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    held, size, first = [], 0, 0
    for i, x in enumerate(column):
        held.append(x.as_py() or "")
        size += len(held[-1])
        if size >= PIECE:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def train(docs: DataFrame) -> Model:
    """A model from all texts with a language that aren't held out. Tasks add up counts in tables of a fixed size for each
    language and give out what is not 0; one row a language, of ORDERS tables, comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}

        def out():
            for lang, table in tables.items():
                full = np.concatenate([table, scripts[lang]])
                at = np.flatnonzero(full)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(full[at], pa.int64())], ["lang", "place", "n"])

        for b in batches:
            langs = b.column(0).to_pylist()
            for first, texts in _batches(b.column(1)):
                number, words, edge = words_of(texts)
                if not words:
                    continue
                g = Grams(words)
                of = np.repeat(np.arange(len(texts)), np.diff(edge))
                names = np.array(langs[first : first + len(texts)], object)
                for lang in dict.fromkeys(names.tolist()):
                    n = np.bincount(number[(names == lang)[of]], minlength=len(words))
                    per = np.repeat(n, g.length)
                    table = tables.setdefault(lang, np.zeros(ORDERS * PLACES, np.int64))
                    for order in range(ORDERS):
                        of_order = np.bincount(g.places[order], per, PLACES) + np.bincount(g.heads[order], n, PLACES)
                        table[order * PLACES : (order + 1) * PLACES] += of_order.astype(np.int64)
                    seen = scripts.setdefault(lang, np.zeros(len(NAMES), np.int64))
                    seen += np.bincount(g.script, n * (g.length - 1), len(NAMES)).astype(np.int64)
                if len(tables) > 32:
                    yield from out()
                    tables.clear()
                    scripts.clear()
        yield from out()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros(ORDERS * PLACES + len(NAMES), np.float32)
        full[pdf["place"].to_numpy()] = pdf["n"].to_numpy()
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "table": [full.tobytes()]})

    small_batches(docs.sparkSession)
    of = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = of.mapInArrow(count, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    rows = sorted(counts.groupBy("lang").applyInPandas(pack, "lang string, table binary").collect())
    if not rows:
        return Model([], [], np.zeros((len(NAMES), 0), bool))
    tables = np.array([np.frombuffer(r.table, np.float32) for r in rows])
    counted = [np.ascontiguousarray(tables[:, i * PLACES : (i + 1) * PLACES].T) for i in range(ORDERS)]
    letters = tables[:, ORDERS * PLACES :].T
    return Model([r.lang for r in rows], counted, letters > LEAST_SHARE * letters.sum(0))


def label(texts: list[str], model: Model, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language of each text or -1, its score, language of each word, place of each text's first word, the words' lengths)."""
    number, words, first = words_of(texts)
    none = np.full(len(texts), -1), np.zeros(len(texts))
    size = np.fromiter(map(len, words), np.int64, len(words))[number] if words else np.empty(0, np.int64)
    if not words or not model.languages:
        return *none, np.empty(0, np.int16), first, size
    scores = model.scores(words)
    path = best_path(number, scores, first, penalty)
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    letters = np.zeros((len(texts), len(model.languages)))
    np.add.at(letters, (of, path), size)
    chance = np.exp(scores - scores.max(1, keepdims=True))
    chance /= chance.sum(1, keepdims=True)
    share = np.zeros_like(letters)
    for c in range(len(model.languages)):
        share[:, c] = np.bincount(of, chance[number, c] * size, len(texts))
    total = letters.sum(1)
    # of languages with as many letters, the likelier one
    lang = np.where(total > 0, np.where(letters == letters.max(1, keepdims=True), share, -1.0).argmax(1), -1)
    score = np.where(total > 0, share[np.arange(len(texts)), np.maximum(lang, 0)] / np.maximum(total, 1), 0.0)
    return lang, np.clip(score, 0.0, 1.0), path, first, size


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, spans), one for each row of documents.

    Words are runs of letters. Each gets a score for the languages that use its script, and the best path over a text's words,
    with a penalty for each change, labels spans of one language each. lang_pred is the language of most letters, `und` for a
    null or empty text, one without letters, and for any text where nothing was learnt; score is the mean chance of that
    language over the words, weighted by letters. spans holds `lang:start:end` in words, comma-joined. Repeated rows and null
    ids are labelled each. Nothing is shuffled; memory follows the longest text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            langs, scores, spans = [], [], []
            for _, texts in _batches(b.column(2)):
                lang, score, path, first, _ = label(texts, m, penalty)
                langs += ["und" if x < 0 else m.languages[x] for x in lang.tolist()]
                scores.append(score)
                for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
                    cuts = [0, *(1 + np.flatnonzero(np.diff(path[a:z]))).tolist(), z - a] if len(path) and z > a else [0]
                    spans.append(",".join(f"{m.languages[path[a + i]]}:{i}:{j}" for i, j in zip(cuts, cuts[1:])))
            score = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.string())], ["doc_id", "held_out", "lang_pred", "score", "spans"])

    small_batches(docs.sparkSession)
    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return of.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, spans string")


def op12_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify() of all documents, learnt from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
