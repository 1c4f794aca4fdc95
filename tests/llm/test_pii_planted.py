"""What the field adds to the patterns, measured on planted data: precision and recall by kind."""

import random

import pytest

from tidemark.llm import pii

PROSE = "the report was read at noon by a few of them and the rest went on to look at the dot on the map near the house".split()


def planted(seed, count):
    """(text, spans planted that no pattern finds, decoys)"""
    r = random.Random(seed)
    name = lambda: "".join(r.choice("abcdefgihlmnorstu") for _ in range(r.randrange(5, 9)))
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    out = []
    for _ in range(count):
        user, host = f"{name()}.{name()}", name()
        hidden = r.choice([
            ("email", f"{user} (at) {host} (dot) com"), ("email", f"{user} [at] {host}.org"), ("email", f"{user} at {host} dot com"), ("email", f"{user} at {host} dot co dot uk"),
            ("phone", f"({number(3)}) {number(3)}-{number(4)}"), ("phone", f"{number(3)}-{number(3)}-{number(4)}"),
        ])
        plain = r.choice([f"{user}@{host}.com", f"+{number(11)}", ""])
        decoy = r.choice(["192.168.1.300", "look at the dot here", "1999", "3.5", "met at noon dot by dot", "v1.2.3", f"{number(3)},000"])
        parts = [" ".join(r.choice(PROSE) for _ in range(8)) for _ in range(4)]
        out.append((f"{parts[0]} {plain} {parts[1]} {hidden[1]} {parts[2]} {decoy} {parts[3]}", hidden, decoy))
    return out


def trained():
    """From texts with what the patterns find, and numbers that are nothing, in any order."""
    r = random.Random(3)
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    makers = [
        lambda: f"user{r.randrange(99)}.x@host{r.randrange(9)}.com", lambda: f"+{number(11)}", lambda: f"+{number(2)} {number(3)} {number(3)} {number(3)}", lambda: f"10.{r.randrange(256)}.{r.randrange(256)}.7",
        lambda: number(r.randrange(1, 5)), lambda: f"{number(1)}.{number(1)}", lambda: f"v{number(1)}.{number(1)}.{number(1)}", lambda: f"{number(3)},000", lambda: f"{number(3)},000", lambda: f"in 20{number(2)}", lambda: f"x{number(2)}",
    ]
    return pii.fit([" and then ".join(r.choice(makers)() for _ in range(r.randrange(1, 8))) for _ in range(400)])


def test_precision_and_recall():
    field = trained()
    hit = {"email": [0, 0], "phone": [0, 0]}
    wrong = 0
    for text, (kind, hidden), decoy in planted(11, 200):
        base, added = pii.find(text, field)
        a = text.index(hidden)
        hit[kind][1] += 1
        hit[kind][0] += any(k == kind and x < a + len(hidden) and y > a for k, x, y in added)
        at = text.index(decoy)
        wrong += any(x < at + len(decoy) and y > at for _, x, y in base + added)
    assert hit["email"][0] >= 0.95 * hit["email"][1] and hit["phone"][0] >= 0.9 * hit["phone"][1]
    assert wrong <= 2


@pytest.mark.parametrize("text", ["see 192.168.1.300 there", "look at the polka dot house", "at noon dot", "he sat at home dot by dot", "x at y", " dot com dot "])
def test_what_is_none(text):
    assert pii.find(text, trained()) == ([], [])


@pytest.mark.parametrize("text", ["a at b dot com " * 20_000, "a at " + "b dot " * 50_000, "x" * 200_000 + " at b dot com", " dot " * 100_000])
def test_long_texts_take_linear_time(text):
    assert isinstance(pii.candidates(text), list)
