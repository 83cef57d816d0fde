"""Awkward rows and plain versions of operators, shared by the tests of this folder."""

import re
from collections import defaultdict

import xxhash

from citeframe.llm import spotsigs

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Nulls everywhere, empty and very long texts, ties and repeated rows, and columns whose names clash with those of operators.
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "the cat sat on the mat and the dog was in the yard", "en", "a", 1),
    (3, "the cat sat on the mat and the dog was in the yard", "en", "a", 1),
    (4, "The  cat sat on the mat\nand the dog was in the yard", "en", None, 1),
    (5, "word " * 60_000, "en", "a", 1),
    (6, "x" * 50_000, None, "a", 1),
    (7, " \t\n", "de", "a", 3),
    (8, "🙂 漢字 ﬁ \u0085\u001c naïve", "fr", "a", 1),
    (None, "no id here", "en", "a", 1),
    (9, "%%% 123 !!!", "en", "a", 1),
]


def plain_signatures(text):
    low = re.sub(r"[^\w]+|_", " ", (text or "").lower()).split()
    common = set(spotsigs.ANCHORS + spotsigs.OTHER_COMMON)
    out, chain = set(), ()
    for w in reversed(low):
        if w in spotsigs.ANCHORS and len(chain) == spotsigs.CHAIN:
            out.add((w, *chain))
        if w not in common:
            chain = (w, *chain)[: spotsigs.CHAIN]
    return out or ({tuple(low)} if low else set())


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                parent[find(b)] = find(a)
    groups = defaultdict(set)
    for n in nodes:
        groups[find(n)].add(n)
    return sorted(map(sorted, groups.values()))
