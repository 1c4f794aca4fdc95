"""Personal data: pattern spans, and more by a skip-chain conditional random field."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
#: (kind, start, end) in code points
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A way to write an address that no harvester reads: name (at) host (dot) net, with or without spaces.
_AT = r"[\[({<]\x20?(?:at|AT)\x20?[\])}>]"
_DOT = r"[\[({<]\x20?(?:dot|DOT)\x20?[\])}>]"
_SPELT = re.compile(rf"(?<![\w.+-])[\w.+-]++\x20?{_AT}\x20?[\w-]++(?:\x20?(?:{_DOT}|\.)\x20?[\w-]++)*+")
# Last parts of hosts that make `name at host dot part` an address.
_ENDS = frozenset("com net org edu gov info io dev app de fr es it nl pl at ch uk eu us ca au in jp cn br".split())
_SAID = re.compile(r"(?<![\w.+-])[\w.+-]++\x20at\x20[\w-]++((?:\x20dot\x20[\w-]++)++)", re.I)
_MARK = re.compile(rf"[0-9@]+|{_AT}|\x20(?:dot|DOT)\x20")
_WORD = re.compile(r"\S+")
_GROUPS = re.compile(r"(?<![0-9().+-])\+?[0-9().-]++(?:\x20[0-9().-]++)++")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from each @, so that long runs without
    one cost nothing."""
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            yield "email", start, end
        at = max(at + 1, end)


def base_spans(text: str) -> list[Span]:
    """The spans of the four patterns, leftmost and not overlapping within a kind, in the order of KINDS.

    Addresses with a part over 255, cards without 13 to 19 digits that pass Luhn's test and phones without 9 to 15
    digits are dropped, and what follows them is searched from their end.
    """
    out = list(emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


# --- the field: nodes are words that might be personal data; labels are none and the four kinds

_STRIP = "\"'.,;:!?()[]{}<>|*&%$#"
N_FEATURES = 29


def parts_of_addresses(text: str, spans: list[Span]) -> set[str]:
    """Names before the @, and hosts, of the text's addresses, in lower case; short ones tell nothing."""
    return {x for k, a, b in spans if k == "email" for x in text[a:b].lower().split("@") if len(x) > 4}


class Taken:
    """Extents that do not overlap, in order."""

    def __init__(self):
        self.spans: list[tuple[int, int]] = []

    def add(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.spans, (a, b))
        if a >= b or i and self.spans[i - 1][1] > a or i < len(self.spans) and self.spans[i][0] < b:
            return False
        self.spans.insert(i, (a, b))
        return True


def said(text: str) -> Iterator[tuple[int, int]]:
    """Extents of `name at host dot com`, to the last part that hosts end in."""
    for m in _SAID.finditer(text):
        end = m.end()
        for part in reversed(re.split(r"\x20dot\x20", m[1], flags=re.I)[1:]):
            if part.lower() in _ENDS:
                yield m.start(), end
                break
            end -= len(part) + 5


def candidates(text: str, spans: list[Span] = ()) -> list[tuple[int, int]]:
    """Extents of what might be personal data: the base spans; addresses spelt with a word for the @, in brackets or not; numbers of
    9 to 15 digits in several short groups; words that hold a digit or an @, without the punctuation around them; and words that are
    the name or the host of an address elsewhere in the text."""
    taken = Taken()
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        taken.add(a, b)
    for m in _SPELT.finditer(text) if "at" in text or "AT" in text else ():
        taken.add(*m.span())
    for a, b in said(text):
        taken.add(a, b)
    edges = [0, *(x for span in taken.spans for x in span), len(text)]
    for lo, hi in zip(edges[::2], edges[1::2]):
        for m in _GROUPS.finditer(text, lo, hi):
            sizes = [sum("0" <= c <= "9" for c in g) for g in m[0].split(" ")]
            if min(sizes) and max(sizes) < 9 <= sum(sizes) <= 15:
                taken.add(m.start(), m.start() + len(m[0].rstrip(" ().-")))
    end = 0
    for m in _MARK.finditer(text):
        if m.start() < end or m[0][0] == " ":
            continue
        a, end = m.start(), m.end()
        while a and not text[a - 1].isspace():
            a -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        b = end
        while a < b and text[a] in _STRIP:
            a += 1
        while b > a and text[b - 1] in _STRIP:
            b -= 1
        taken.add(a, b)
    if parts := parts_of_addresses(text, spans):
        for m in _WORD.finditer(text):
            word = m[0].strip(_STRIP)
            if word.lower() in parts and not _MARK.search(word):
                a = m.start() + m[0].index(word)
                taken.add(a, a + len(word))
    return taken.spans


def features(word: str) -> list[int]:
    """What a word looks like, as the numbers of its active features."""
    digits, letters = sum("0" <= c <= "9" for c in word), sum(c.isalpha() for c in word)
    dots, f = word.count("."), [0]
    f.append(1 + min(digits, 20) // 2)
    f += [12] if "@" in word else []
    f += [13] if word[:1] == "+" else []
    f += [14 + min(dots, 4)]
    f += [19] if letters else []
    f += [20] if digits and digits == len(word) else []
    f += [21] if "-" in word else []
    f += [22] if "(" in word or ")" in word else []
    f += [23] if "@" in word and "." in word.rpartition("@")[2] else []
    f += [24] if dots == 3 and digits + 3 == len(word) else []
    f += [25] if digits >= 13 and not letters else []
    f += [26] if _SPELT.fullmatch(word) or _SAID.fullmatch(word) else []
    f += [27] if not digits and "@" not in word else []
    f += [28] if 13 <= digits <= 19 and not letters and not luhn("".join(c for c in word if "0" <= c <= "9")) else []
    return f


def keys(word: str) -> tuple[set[str], set[str]]:
    """(content, likeness) of a word: what words with the same content have in common, and what similar ones have. Similar
    are numbers of nine digits or more that agree in their first or their last six, addresses of one host or with one name, numbers with three dots
    that agree in the first three parts, and a word that is such a name or host."""
    if _SAID.fullmatch(word):
        word = re.sub(r"\x20dot\x20", ".", re.sub(r"\x20at\x20", "@", word, flags=re.I), flags=re.I)
    low = re.sub(rf"\x20?{_AT}\x20?", "@", word, flags=re.I).lower()
    low = re.sub(rf"\x20?{_DOT}\x20?", ".", low, flags=re.I)
    digits = "".join(c for c in low if "0" <= c <= "9")
    content = {k for k in ("w" + low, "d" + digits) if len(k) > 5}
    likeness = {"f" + digits[:6], "l" + digits[-6:]} if len(digits) >= 9 else set()
    if low.count(".") == 3 and len(digits) + 3 == len(low):
        likeness.add("i" + low.rpartition(".")[0])
    if "@" in low:
        likeness |= {"a" + x for x in low.split("@") if len(x) > 4}
    elif not digits:
        likeness.add("a" + low)
    return content, likeness


@dataclass
class Graph:
    words: list[tuple[int, int]]
    active: list[list[int]]
    observed: np.ndarray  # label of the pattern that covers the word, 0 if none does
    links: tuple[np.ndarray, ...]  # pairs of neighbours, pairs with the same content, pairs of similar words


LINKS = 3


def graph(text: str, spans: list[Span]) -> Graph:
    """The document's nodes and links. A word is linked to the next candidate in the text, and for each of its keys to the
    last word before it that has that key too; so links grow with the words, not with their pairs."""
    words = candidates(text, spans)
    observed, ends = np.zeros(len(words), np.int64), np.array([w[1] for w in words], np.int64)
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        for i in range(int(np.searchsorted(ends, a, side="right")), len(words)):
            if words[i][0] >= b:
                break
            observed[i] = KINDS.index(kind) + 1
    last: dict[str, int] = {}
    found: tuple[set, set] = (set(), set())
    for i, (a, b) in enumerate(words):
        for own, out in zip(keys(text[a:b]), found):
            for k in own:
                if k in last:
                    out.add((last[k], i))
                last[k] = i
    pairs = lambda of: np.array(sorted(of), np.int64).reshape(-1, 2)
    return Graph(words, [features(text[a:b]) for a, b in words], observed, (pairs((i, i + 1) for i in range(len(words) - 1)), pairs(found[0]), pairs(found[1] - found[0])))


@dataclass
class Field:
    unary: np.ndarray  # feature x label
    tables: tuple[np.ndarray, ...]  # label x label, log potentials, one for each sort of links

    def scores(self, g: Graph) -> np.ndarray:
        """Node x label. Words that a pattern covers are held at its label."""
        own = np.array([self.unary[f].sum(0) for f in g.active]).reshape(len(g.words), self.unary.shape[1])
        held = np.flatnonzero(g.observed)
        own[held] = -30.0
        own[held, g.observed[held]] = 0.0
        return own

    def marginals(self, g: Graph, rounds: int = 50) -> np.ndarray:
        """Label probabilities of every node, by loopy belief propagation with all messages sent at once and damped; exact
        where the links make no circle."""
        k, own = self.unary.shape[1], self.scores(g)
        pairs = np.concatenate(g.links)
        if not len(pairs):
            return _softmax(own)
        tables = np.concatenate([np.repeat(t[None], len(x), 0) for t, x in zip(self.tables, g.links)])
        src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        m = len(pairs)
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        sent = np.zeros((2 * m, k))
        for _ in range(rounds):
            belief = own.copy()
            np.add.at(belief, dst, sent)
            out = (belief[src] - sent[back])[:, :, None] + tables
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None]).sum(1))
            new -= new.max(1, keepdims=True)
            if abs(new - sent).max() < 1e-6:
                break
            sent = 0.5 * sent + 0.5 * new
        belief = own.copy()
        np.add.at(belief, dst, sent)
        return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str], steps: int = 1000) -> Field | None:
    """Weights by piecewise training: a multinomial logistic for what words look like, and for each sort of links the
    log ratio of label pairs to what chance would give, smoothed. The patterns' spans are the labels; None without any.

    So that the field knows more than the patterns, each word that a pattern covers is shown twice: as it is, and without
    the marks that the pattern needs: an address with a word for its @, a number without its plus. And where the
    same or similar words have a label, links are counted among the labelled ones, as an uncovered one is what the field is to
    judge, not to learn from."""
    k = len(KINDS) + 1
    x, y, tables = [], [], [np.zeros((k, k)) for _ in range(LINKS)]
    for text in texts:
        g = graph(text, base_spans(text))
        for f, label in zip(g.active, g.observed.tolist()):
            shown = [f]
            if label == 1:
                shown.append([i for i in f if i not in (12, 23)] + [26])
            elif label:
                shown.append([i for i in f if i not in (13,)])
            for one in shown:
                row = np.zeros(N_FEATURES)
                row[one] = 1
                x.append(row)
                y.append(label)
        for n, (pairs, table) in enumerate(zip(g.links, tables)):
            one, two = g.observed[pairs[:, 0]], g.observed[pairs[:, 1]]
            on = ((one > 0) == (two > 0)) if n else np.ones(len(pairs), bool)
            np.add.at(table, (one[on], two[on]), 1)
    if not any(y):
        return None
    a, target = np.array(x), np.eye(k)[y]
    w = np.zeros((N_FEATURES, k))
    speed = np.zeros_like(w)
    for _ in range(steps):
        grad = a.T @ (target - _softmax(a @ w)) / len(a) - 1e-4 * w
        speed = 0.9 * speed + grad
        w += 0.5 * speed

    def ratio(table, prior):
        p = (table + table.T) / 2 + prior
        p /= p.sum()
        return np.clip(np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True))), -6, 6)

    # before anything is counted, words with the same content are taken to have the same label, and similar ones rather so
    same = np.eye(k)
    return Field(w, (ratio(tables[0], 0.1), ratio(tables[1], 0.1 + 2 * same), ratio(tables[2], 0.1 + 0.5 * same)))


def train(docs: DataFrame, rows: int = 2000) -> Field | None:
    """A field from at most that many documents with a digit or an @, by the order of a hash of the text. Null and empty
    texts take no part; equal texts are one; without any labelled word there is no field."""
    of = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    chosen = of.select("h").distinct().orderBy("h").limit(rows).collect()
    if not chosen:
        return None
    # as many hashes as rows at most; copies of a text are one
    hashes = F.broadcast(docs.sparkSession.createDataFrame(chosen, "h long"))
    return fit([r[0] for r in of.join(hashes, "h").groupBy("h").agg(F.min("text").alias("text")).orderBy("h").select("text").collect()])


def possible(kind: str, word: str) -> bool:
    """Whether a word can be what the field takes it for: an address of four numbers has none over 255."""
    return kind != "ip" or all(int(p or 0) <= 255 for p in re.findall(r"[0-9]{1,18}", word))


def find(text: str, field: Field | None, sure: float = 0.9) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans). A word outside the base spans is added if one of the four labels is at least that probable,
    with all that its document's other words tell about it."""
    if not _MARK.search(text):
        return [], []
    base = base_spans(text)
    if field is None:
        return base, []
    g = graph(text, base)
    if not len(g.words) or g.observed.all():
        return base, []
    p = field.marginals(g)
    added = [(KINDS[label - 1], *g.words[i]) for i, label in enumerate(p.argmax(1).tolist()) if label and not g.observed[i] and p[i, label] >= sure]
    return base, [(k, a, b) for k, a, b in added if possible(k, text[a:b])]


def find_pii(docs: DataFrame, field: Field | None) -> DataFrame:
    """One row for each document: doc_id, the numbers of base spans by kind, the digest of the base spans, all spans and
    their number.

    Null text counts as empty: no spans, the digest of the empty string. Repeated rows and null ids give a row each; other
    columns are not looked at. Whole texts, whatever their length; work grows
    with the text, as no pattern can go back over it. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                base, added = find(text.as_py() or "", field)
                said = joined(base)
                rows.append((doc, *(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(said.encode()).hexdigest(), joined(base + added) if added else said, len(base) + len(added)))
            if rows:
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap become the first one's kind."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redact_pii(docs: DataFrame, field: Field | None) -> DataFrame:
    """The documents with personal data replaced in the text; n_chars, where present, is counted anew. Null stays null."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redact(t, sum(find(t, field), [])))

    small_batches(docs.sparkSession)
    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_pii() in all documents, with a field trained on 2,000 of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_pii(docs, train(docs))
