"""Language identification by cross-parsing.

A suffix automaton of labelled text per language recognises exactly the substrings of that text. A text is parsed left to right into phrases, each the longest match in the automaton; a phrase ends where the automaton has no transition, and a character that the language's text lacks is an empty phrase and itself, so two. With c phrases over n characters against training text of length N, c * log2(N) / n estimates the bits a character costs under that language, and the cheapest language wins.

All texts of a slice are parsed at once: they are cut into blocks of ``BLOCK`` characters, and numpy moves all blocks one character ahead at a time. Every block is first parsed as if a phrase began with it. Then its parse is mended from the state in which the block before really ends, up to the character where both parses are in the same state, after which they cannot differ; a block that ends in another state than assumed mends the next one, until none is left. So phrases of any length cross blocks, and the result is that of one parse from left to right. Transitions of the ``CLASSES`` - 4 commonest letters stand in a dense table, those of all other letters of the samples in a hash table.

Training reads only rows with a text and a language that are not held out (``shared.held_out``), bounded by ``sample_docs`` rows a language, the first ``sample_doc_chars`` characters of each from its first letter on, and ``sample_chars`` characters a language; rows are taken in the order of a hash of their id, those with a letter only. Languages are all that occur. For prediction texts are read whole.

Null texts, and texts without a letter, are ``und`` with score 0, as is everything where no language was learned. Ties go to the language first in code-point order. Repeated rows give repeated output rows, an empty table none; columns other than those named are not looked at.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .hashtable import HashTable
from .shared import held_out, in_batches, in_slices, kept, table, written

BLOCK = 256
CLASSES = 64  # 0 a run of anything but letters and marks, 1 other letters of the samples, 2 letters of no sample, last: padding
RARE = 1
UNDETERMINED = "und"
LETTER = r"\p{L}"


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is a letter, and its lower case (0 unless a letter or mark)."""
    letter, lower = np.zeros(0x110000, bool), np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            letter[c] = kind == "L"
            lower[c] = ord(chr(c).lower()[0])
    return letter, lower


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _lowered(codes: np.ndarray) -> np.ndarray:
    """Lower-case letters, with each run of other characters as one 0."""
    low = _letters()[1][codes]
    if len(low) > 1:
        low = low[np.r_[True, (low[1:] != 0) | (low[:-1] != 0)]]
    return low


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the root and every state accepts a substring."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = clone
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
        last = cur
    return moves


class CrossParser:
    """``samples``: pairs of a language and its training text."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        lowered = [(lang, _lowered(_codes(text))) for lang, text in sorted(samples)]
        seen = Counter()
        for _, low in lowered:
            values, counts = np.unique(low, return_counts=True)
            seen.update(dict(zip(values.tolist(), counts.tolist(), strict=True)))
        seen.pop(0, None)
        common = sorted(seen, key=lambda c: (-seen[c], c))[: CLASSES - 4]
        self.classes = np.full(0x110000, 2, np.uint8)
        self.classes[list(seen)] = RARE
        self.classes[0] = 0
        self.classes[common] = np.arange(3, 3 + len(common))
        self.languages, self.tables, self.others, self.foreign, self.bits = [], [], [], [], []
        for lang, low in lowered:
            if not (low != 0).any():
                continue
            self.languages.append(lang)
            self.bits.append(float(np.log2(max(2, len(low)))))
            dense, others = self._table(suffix_automaton(low.tolist()))
            self.tables.append(dense)
            self.others.append(others)
            foreign = np.ones(0x110001, bool)
            foreign[low] = foreign[0x110000] = False
            self.foreign.append(foreign)

    def _table(self, moves: list[dict[int, int]]) -> tuple[np.ndarray, HashTable]:
        """For state * CLASSES + class: 2 * CLASSES * next state, plus 1 where a phrase ends before the class. The hash table has the next state by state and letter for rare letters."""
        lost = len(moves)  # after a class that starts no substring of the sample: whatever follows starts a phrase
        at = np.repeat(np.arange(lost), [len(m) for m in moves])
        letters = np.array([c for m in moves for c in m], np.int64)
        after = np.array([s for m in moves for s in m.values()], np.int32)
        kind = self.classes[letters]
        root = np.full(CLASSES, lost, np.int32)
        root[kind[at == 0]] = after[at == 0]
        root[RARE] = lost
        out = np.tile(root * 2 * CLASSES + 1, (lost + 1, 1)).astype(np.int32)
        out[0] = root * 2 * CLASSES  # the first phrase ends none
        out[:, CLASSES - 1] = np.arange(lost + 1) * 2 * CLASSES
        dense = kind != RARE
        out[at[dense], kind[dense]] = after[dense] * 2 * CLASSES
        keys = at[~dense].astype(np.uint64) << np.uint64(21) | letters[~dense].astype(np.uint64)
        return out.reshape(-1), HashTable(keys, after[~dense])

    def _step(self, k: int, at: np.ndarray, column: np.ndarray, letters: np.ndarray | None) -> np.ndarray:
        """The table's entries for lanes in states ``at`` and their next classes; ``letters``: the code points if a rare one is among them."""
        step = self.tables[k].take((at >> 1) + column)
        if letters is not None and len(rare := np.flatnonzero(column == RARE)):
            state, letter = (at[rare] // (2 * CLASSES)).astype(np.uint64) << np.uint64(21), letters[rare].astype(np.uint64)
            there, root = self.others[k].lookup(state | letter), self.others[k].lookup(letter)
            lost = len(self.tables[k]) // CLASSES - 1
            step[rare] = np.where(there >= 0, there, np.where(root >= 0, root, lost)) * 2 * CLASSES + ((there < 0) & (state != 0))
        return step

    def _parse(self, k: int, lanes: np.ndarray, letters: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Phrases that end in each block; ``inner``: blocks that continue the one before."""
        size = lanes.shape[1]
        rare = (lanes == RARE).any(axis=1)
        states, counts = np.empty((BLOCK, size), np.int32), np.empty((BLOCK, size), np.int16)
        at, ends = np.zeros(size, np.int32), np.zeros(size, np.int16)
        for j in range(BLOCK):
            step = self._step(k, at, lanes[j], letters[j] if rare[j] else None)
            end = step & 1
            ends += end.astype(np.int16)
            at = step - end
            states[j], counts[j] = at, ends
        total, last = ends.copy(), at.copy()
        todo = np.flatnonzero(inner)
        while len(todo):
            at, ends, live = last[todo - 1], np.zeros(len(todo), np.int16), np.arange(len(todo))
            after = states[-1, todo]
            for j in range(BLOCK):
                lane = todo[live]
                step = self._step(k, at[live], lanes[j, lane], letters[j, lane] if rare[j] else None)
                end = step & 1
                ends[live] += end.astype(np.int16)
                at[live] = now = step - end
                met = now == states[j, lane]
                done = lane[met]
                total[done] = ends[live[met]] + counts[-1, done] - counts[j, done]
                live = live[~met]
                if not len(live):
                    break
            total[todo[live]], after[live] = ends[live], at[live]
            changed = todo[after != last[todo]] + 1
            last[todo] = after
            changed = changed[changed < size]
            todo = changed[inner[changed]]
        return total

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases by language and text, normalised lengths, and whether there is a letter."""
        letter = _letters()[0]
        parts, lengths, has = [], [], []
        for t in texts:
            codes = _codes(t)
            has.append(bool(letter[codes].any()))
            low = _lowered(codes)
            lengths.append(len(low))
            parts.append(low)
            if rest := -len(low) % BLOCK:
                parts.append(np.full(rest, 0x110000, np.uint32))
        lengths = np.array(lengths, np.int64)
        blocks = -(-lengths // BLOCK)
        out = np.zeros((len(self.tables), len(texts)), np.int64)
        if blocks.sum():
            letters = np.ascontiguousarray(np.concatenate(parts).reshape(-1, BLOCK).T)
            lanes = np.append(self.classes, CLASSES - 1)[letters].astype(np.int32)
            owner = np.repeat(np.arange(len(texts)), blocks)
            inner = np.r_[False, owner[1:] == owner[:-1]]
            for k in range(len(self.tables)):
                found = self._parse(k, lanes, letters, inner) + self.foreign[k][letters].sum(axis=0)
                out[k] = np.bincount(owner, found, len(texts)).astype(np.int64) + (lengths > 0)
        return out, lengths, np.array(has, bool)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        counts, lengths, has = self.phrases([t or "" for t in texts])
        cost = counts * np.array(self.bits)[:, None] / np.maximum(lengths, 1)
        best = cost.argmin(axis=0)
        weight = np.exp2(-(cost - cost.min(axis=0)) * np.minimum(lengths, 100))
        score = 1 / weight.sum(axis=0)
        return [self.languages[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)], np.where(has, score, 0.0).tolist()


def parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    return kept(samples, lambda: CrossParser(samples))


def training_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 60, sample_doc_chars: int = 6000, sample_chars: int = 40_000) -> tuple[tuple[str, str], ...]:
    """The bounded sample of labelled text, one text a language.

    Ids are chosen first, from narrow columns; only the chosen rows (``sample_docs`` a language, in a table of known size, which Catalyst broadcasts if it is small) are then joined with their texts.
    """
    lettered = F.col(text_col).rlike(LETTER)
    rows = df.where(~held_out(id_col) & F.col(lang_col).isNotNull() & lettered)
    chosen = rows.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("rank")).distinct()
    salted = Window.partitionBy("lang", "salt").orderBy("rank", "doc_id")
    chosen = chosen.withColumn("salt", F.pmod(F.xxhash64("rank"), F.lit(64))).withColumn("n", F.row_number().over(salted)).where(F.col("n") <= sample_docs)
    order = Window.partitionBy("lang").orderBy("rank", "doc_id")  # of 64 times sample_docs rows a language
    chosen = chosen.select("doc_id", "lang", F.row_number().over(order).alias("n")).where(F.col("n") <= sample_docs)
    slice_ = F.substring(F.regexp_replace(F.col(text_col), rf"\A[^{LETTER}]+", ""), 1, sample_doc_chars)
    texts = df.where(lettered).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), slice_.alias("text"))
    joined = texts.join(written(chosen), ["doc_id", "lang"]).select("lang", "n", "text").dropDuplicates(["lang", "n"])
    held: dict[str, list[str]] = {}
    for row in sorted(joined.collect(), key=lambda r: (r.lang, r.n)):
        got = held.setdefault(row.lang, [])
        if not got or sum(map(len, got)) + len(row.text) <= sample_chars:
            got.append(row.text)
    return tuple((lang, "\n".join(texts)) for lang, texts in sorted(held.items()))


def identify(df: DataFrame, samples: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, lang_pred and score for each row; no shuffle. Only the text is looked at."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"), *keep)
    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cross = parser(samples)
        names = ["doc_id", *keep, "lang_pred", "score"]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores = [], []
            for start, end in in_slices([t or "" for t in texts]):
                got = cross.predict(texts[start:end])
                langs += got[0]
                scores += got[1]
            kept = [batch.column(0), *(batch.column(i) for i in range(2, 2 + len(keep)))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    return in_batches(rows, run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by automata of the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, training_texts(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
