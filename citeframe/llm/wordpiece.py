"""Token counts by a linear longest-match automaton.

The vocabulary's word-initial and inner pieces form a trie with two roots. The failure link of a node leads to the node for what is left of the node's string once its longest leading pieces are popped, and the number of popped pieces is stored with it. Greedy longest-match word-piece counting then takes one transition for each byte plus one failure move for each popped piece, and no piece is ever built. The distinct words of a slice are moved through the automaton together with numpy.

A word is a run of word characters or a single other character that is not white space. A word that no sequence of pieces covers counts as one unknown piece. Null and empty texts have no words.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashtable import HashTable
from .shared import in_batches, in_slices, kept, table

WORD = re.compile(r"\w+|[^\w\s]")
REMEMBERED = 300_000


class LongestMatch:
    """``initial``: pieces that may start a word; ``inner``: pieces that may continue one."""

    def __init__(self, initial: set[bytes], inner: set[bytes]):
        child: list[dict[int, int]] = [{}, {}]
        piece = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for word in pieces:
                at = root
                for c in word:
                    nxt = child[at].get(c)
                    if nxt is None:
                        nxt = child[at][c] = len(child)
                        child.append({})
                        piece.append(False)
                    at = nxt
                if at > 1:
                    piece[at] = True
        fail, popped = [-1] * len(child), [0] * len(child)
        level = [0, 1]
        while level:
            below = []
            for u in level:
                for c, v in child[u].items():
                    if piece[v]:
                        fail[v], popped[v] = 1, 1
                    else:
                        z, n = fail[u], popped[u]
                        while z != -1 and c not in child[z]:
                            n += popped[z]
                            z = fail[z]
                        if z != -1:
                            fail[v], popped[v] = child[z][c], n
                    below.append(v)
            level = below
        at = np.repeat(np.arange(len(child)), [len(m) for m in child]).astype(np.uint64)
        by = np.array([c for m in child for c in m], np.uint64)
        self.moves = HashTable(at << np.uint64(8) | by, np.array([v for m in child for v in m.values()], np.int32))
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int32)
        self.known: dict[str, int] = {}

    @classmethod
    def from_rank_file(cls, path: str) -> LongestMatch:
        """Tokens with a leading space start a word (as does any single byte); tokens without a space continue one."""
        with open(path, "rb") as lines:
            tokens = [base64.b64decode(line.split()[0]) for line in lines]
        spaced = {t[1:] for t in tokens if t[:1] == b" " and len(t) > 1}
        return cls(spaced | {t for t in tokens if len(t) == 1}, {t for t in tokens if b" " not in t})

    def count(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word; 1 where the vocabulary does not cover it, 0 for an empty word."""
        out = np.zeros(len(words), np.int64)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        start = 0
        while start < len(order):
            end, width = start, 0
            while end < len(order) and (end == start or (end - start + 1) * len(words[order[end]]) <= 1 << 20):
                width = len(words[order[end]])
                end += 1
            part = order[start:end]
            out[part] = self._lanes([words[i] for i in part], width)
            start = end
        return out

    def _lanes(self, words: list[bytes], width: int) -> np.ndarray:
        lengths = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width).T.astype(np.uint64)
        state, count = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        for j in range(width):  # words are in order of length: those still running are the last
            go = np.arange(np.searchsorted(lengths, j, "right"), len(words))
            go = go[state[go] >= 0]
            while len(go):
                nxt = self.moves.lookup(state[go].astype(np.uint64) << np.uint64(8) | raw[j, go])
                hit = nxt >= 0
                state[go[hit]] = nxt[hit]
                go = go[~hit]
                count[go] += self.popped[state[go]]
                state[go] = self.fail[state[go]]
                go = go[state[go] >= 0]
        go = np.flatnonzero((state >= 0) & (state != 1) & (lengths > 0))
        while len(go):
            count[go] += self.popped[state[go]]
            state[go] = self.fail[state[go]]
            go = go[(state[go] >= 0) & (state[go] != 1)]
        return np.where(lengths == 0, 0, np.where(state < 0, 1, count))

    def count_texts(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Words and pieces of each text."""
        cut = [WORD.findall(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if new := list(set().union(*cut).difference(self.known)):
            self.known.update(zip(new, self.count([w.encode("utf-8", "surrogatepass") for w in new]).tolist(), strict=True))
        get = self.known.__getitem__
        return [len(words) for words in cut], [sum(map(get, words)) for words in cut]


def automaton(path: str) -> LongestMatch:
    return kept((LongestMatch, path), lambda: LongestMatch.from_rank_file(path))


def count_tokens(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and n_pieces for each row; no shuffle."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = automaton(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            words, pieces = [], []
            for start, end in in_slices(texts):
                got = match.count_texts(texts[start:end])
                words += got[0]
                pieces += got[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(pieces, pa.int64())], ["doc_id", "n_words", "n_pieces"])

    return in_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_pieces bigint")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
