"""Notices that stand several times close together."""

import random

import pytest

from citeframe.llm import licenses
from citeframe.llm.words import words


@pytest.mark.parametrize("copies", [2, 3, 5, 9])
def test_repeated_notices(copies):
    s = licenses.Scanner()
    for name, text in licenses.TEMPLATES:
        for between in (" ", " and so on ", " x y z some more words here "):
            found = [f for f in s.scan("x words before it " + between.join([text] * copies) + " and words behind it") if f[0] == name]
            assert len(found) == copies and all(f[1] == 1.0 for f in found), (name, copies, between)


def test_edited_repeated_notices():
    s = licenses.Scanner()
    long = licenses.TEMPLATES[3][1].split()
    once = " ".join(w for i, w in enumerate(long) if i % 9 != 4)
    assert s.scan(f"a b c {once} {once} d e f")[0][0] == "MIT"
    inserted = " ".join(w + (" really" if i % 8 == 5 else "") for i, w in enumerate(long))
    assert s.scan(f"a b c {inserted} {inserted} {inserted} d e f")[0][:2] == ("MIT", 1.0)
    assert s.scan("x All rights reserved. All rights reserved. y") == [("proprietary", 1.0, 1, 4), ("proprietary", 1.0, 4, 7)]


def test_runs_of_key_words_are_cheap():
    assert licenses.Scanner().scan("license the software " * 20_000) == []


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_edited_notices_by_brute_force():
    """Every notice planted with edits is found at its place where a plain common subsequence reaches 0.85 of its template, and every notice found reaches what is said of it."""
    s, r = licenses.Scanner(), random.Random(19)
    templates = [(name, words(t)) for name, t in licenses.TEMPLATES]
    filler = [b"f%d" % i for i in range(40)] + [w for _, t in templates for w in t]
    missed = tried = 0
    for _ in range(400):
        name, own = r.choice(templates)
        rate = r.choice((0, 0.05, 0.1, 0.15))
        edited = []
        for w in own:
            u = r.random()
            edited += [w] if u >= rate else r.choice(([], [r.choice(filler)], [w, r.choice(filler)]))
        before, behind = ([r.choice(filler) for _ in range(r.randint(0, 60))] for _ in "ab")
        text = before + edited + behind
        found = s.scan(b" ".join(text).decode())
        for n, c, a, b in found:
            assert 0 <= a < b <= len(text) and max(plain_lcs(text[a:b], t) / len(t) for m, t in templates if m == n) >= c - 1e-9 >= 0.8 - 1e-9
        if plain_lcs(edited, own) >= 0.85 * len(own):
            tried += 1
            missed += not any(n == name and a < len(before) + len(edited) and b > len(before) for n, _, a, b in found)
    assert tried > 300 and missed <= 0.01 * tried


def test_spread_notices():
    own = licenses.TEMPLATES[3][1].split()
    text = " ".join(w + " x%d" % i for i, w in enumerate(own))
    found = licenses.Scanner().scan(f"u b c {text} d e f")
    assert [f[:2] for f in found] == [("MIT", 1.0)]
