"""Fuzzy string scores and evidence windows: order-dependent logic that runs in Arrow batches, behind candidate limits."""

from __future__ import annotations

import math
import re

import numpy as np

from . import constants as K

_TOKEN = re.compile(K.TOKEN)
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_STOP = frozenset(K.VERIFY_STOP)
_FOLD = {
    **dict.fromkeys(map(ord, K.DASHES), "-"),
    **dict.fromkeys(map(ord, K.APOSTROPHES), "'"),
    **dict.fromkeys(map(ord, K.QUOTES), '"'),
    **dict.fromkeys(map(ord, K.SPACES), " "),
    **dict.fromkeys(map(ord, K.DELETED), ""),
    ord("…"): "...",
}


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, 64 and more characters at a time in one integer."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """100 times twice the common subsequence over both lengths; two empty strings are equal."""
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string against a stretch of the longer that is as long, or cut off by an end."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    m, n = len(short), len(long)
    letters = {c: i + 1 for i, c in enumerate(dict.fromkeys(short))}
    width = -(-m // 64)
    masks = np.zeros((width, len(letters) + 1), np.uint64)  # column 0: no place in the shorter string
    for i, c in enumerate(short):
        masks[i // 64, letters[c]] |= np.uint64(1 << i % 64)
    text = np.zeros(n + 2 * (m - 1), np.int64)
    text[m - 1 : m - 1 + n] = [letters.get(c, 0) for c in long]
    lanes = n + m - 1  # one for each stretch
    v = np.full((width, lanes), np.uint64(2**64 - 1))
    for j in range(m):
        at = text[j : j + lanes]
        carry = np.zeros(lanes, np.uint64)
        for w in range(width):
            met = masks[w][at]
            u = v[w] & met
            part = v[w] + u
            total = part + carry
            carry = ((part < u) | (total < part)).astype(np.uint64)
            v[w] = total | (v[w] & ~met)
    tail = np.uint64((1 << (m - 64 * (width - 1))) - 1) if m % 64 else np.uint64(2**64 - 1)
    v[-1] &= tail
    common = m - sum(np.bitwise_count(v[w]).astype(np.int64) - (64 if w < width - 1 else 0) for w in range(width)) - 64 * (width - 1)
    start = np.arange(lanes) - (m - 1)
    size = np.minimum(start + m, n) - np.maximum(start, 0)
    return float((200.0 * common / (m + size)).max())


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the common words, and the common words with what either side has besides."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if common and (not only_x or not only_y):
        return 100.0
    both = [" ".join(filter(None, (common, only))) for only in (only_x, only_y)]
    best = ratio(*both)
    return max(best, *(ratio(common, s) for s in both)) if common else best


def compare_form(text: str) -> str:
    import unicodedata

    return " ".join(unicodedata.normalize("NFKC", text).translate(_FOLD).lower().split())


def content_terms(text: str) -> list[str]:
    return [t for t in _TOKEN.findall(text.lower()) if t not in _STOP and len(t) > 1]


def numbers(text: str) -> set[str]:
    return {n.replace(",", "").rstrip(".") for n in _NUMBER.findall(text)}


class Claim:
    """A claim with what its scores need; ``support`` scores one evidence text."""

    def __init__(self, text: str):
        self.terms = {t: 1 + math.log1p(len(t)) for t in content_terms(text)}
        self.total = sum(self.terms.values())
        self.form = compare_form(text)
        self.numbers = numbers(text)

    def plain(self, evidence: str) -> tuple[float, float]:
        """Weighted term coverage and the factor for missing numbers; (0, 0) without content terms."""
        there = set(content_terms(evidence))
        if not self.terms or not there:
            return 0.0, 0.0
        factor = 1.0
        if self.numbers:
            factor = 0.45 + 0.55 * len(self.numbers & numbers(evidence)) / len(self.numbers)
        return sum(w for t, w in self.terms.items() if t in there) / self.total, factor

    def bound(self, evidence: str) -> float:
        """What ``support`` cannot exceed, without any fuzzy matching."""
        coverage, factor = self.plain(evidence)
        return round(min(1.0, (0.6 * coverage + 0.4) * factor), 4)

    def support(self, evidence: str) -> float:
        """0.6 of weighted term coverage and 0.4 of fuzzy likeness, scaled down by missing numbers; 0 without content terms."""
        coverage, factor = self.plain(evidence)
        if not factor:
            return 0.0
        other = compare_form(evidence)
        fuzzy = token_set_ratio(self.form, other)
        if fuzzy < 100:
            fuzzy = max(fuzzy, partial_ratio(self.form, other))
        return round(min(1.0, (0.6 * coverage + 0.4 * fuzzy / 100) * factor), 4)


def best_window(claim: str, lines: list[str], most: int = 14, patience: int = 2) -> tuple[float, int, int]:
    """(score, first, last) of the run of lines that best supports ``claim``: from the best single line outwards, towards the neighbour that scores higher (the earlier one in a tie), until ``patience`` steps brought nothing."""
    if not lines:
        return 0.0, -1, -1
    judge = Claim(claim)
    best = (-1.0, 0, 0)
    for most_possible, i in sorted(((judge.bound(line), i) for i, line in enumerate(lines)), key=lambda x: (-x[0], x[1])):
        if most_possible < best[0]:
            break
        score = judge.support(lines[i])
        if (score, -i) > (best[0], -best[1]):
            best = (score, i, i)
    lo = hi = best[1]
    idle = 0
    while hi - lo + 1 < min(most, len(lines)) and idle <= patience and best[0] < 1:
        steps = [(a, b) for a, b in ((lo - 1, hi), (lo, hi + 1)) if a >= 0 and b < len(lines)]
        scored = [(judge.support(" ".join(lines[a : b + 1])), a, b) for a, b in steps]
        top = max(s for s, _, _ in scored)
        _, lo, hi = next(s for s in scored if s[0] == top)
        if top > best[0] + 1e-9:
            best, idle = (top, lo, hi), 0
        else:
            idle += 1
    return best
