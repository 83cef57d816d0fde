"""Toxicity scores by a factorization machine over hashed terms.

A text is the set of its words and of the first ``PREFIX`` bytes of longer words, hashed to ``BUCKETS`` terms (crc32). The model is second order: a bias, a weight for each term and the inner products of the terms' factors, so pairs of terms (an insult with the mention of a group) carry weight that no sum of single weights has.

Every term of the training rows takes part. A term's weight and factors stay zero until a gradient moves them: its own, where it exceeds ``sigmas`` standard errors (and ``least`` rows), or that of its interactions. For those, power iteration finds the directions in which the residuals' co-occurrence matrix (terms by terms, never built) is strongest, and terms that stand out there by ``pair_sigmas`` and ``pair_least`` begin to move even if they tell nothing alone. The moving terms are then fitted by mini-batch Adam on the logistic loss, and all gradients are looked at again, until no further term moves.

Training reads labels only of rows that are not held out (``shared.held_out``). Its bounds: ``sample_rows`` labelled ids, in the order of a hash of their id, one text of each, and of a text with more than ``sample_terms`` terms those with the lowest hashes. Labels, lang, source and doc_id are never inputs of a score.

Null counts as empty text; a text without any learned term, an empty one too, scores the bias alone. Repeated label rows of a document count once (toxic if any is); null labels are left out. Of several texts of one id the one whose terms come first in order is learned from. Without any training row every score is 0; an empty table of documents gives no rows. Repeated rows give repeated output rows, and columns other than those named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import held_out, in_batches, in_slices, table
from .words import words

BUCKETS = 1 << 20
PREFIX = 5
REMEMBERED = 500_000
TOXIC_AT = 0.7
#: Features that training looks at together.
PART = 500_000


def features(text: str) -> set[bytes]:
    """The distinct words of a text, and the starts of longer ones (marked by a character that no word has)."""
    found = set(words(text))
    return found | {w[:PREFIX] + b"*" for w in found if len(w) > PREFIX}


def terms(text: str) -> np.ndarray:
    """The distinct hashed terms of a text."""
    return np.unique(np.fromiter((crc32(w) & (BUCKETS - 1) for w in features(text)), np.int32))


@dataclass
class FactorizationMachine:
    bias: float
    terms: np.ndarray  # the hashed terms, ascending
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores of rows whose features (positions in ``terms``) stand one after another in ``flat``."""
        ends = np.cumsum(sizes)
        per = np.column_stack([self.weights[flat], (self.factors[flat] ** 2).sum(axis=1), self.factors[flat]])
        total = np.vstack([np.zeros((1, per.shape[1])), np.cumsum(per, axis=0, dtype=np.float64)])
        rows = total[ends] - total[ends - sizes]
        z = self.bias + rows[:, 0] + 0.5 * ((rows[:, 2:] ** 2).sum(axis=1) - rows[:, 1])
        return _all_scores(z)


def _all_scores(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _adam(theta: list[np.ndarray], flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, steps: int, batch: int, rate: float, shrink: float, random: np.random.Generator) -> None:
    """Fits bias, weights and factors in place; ``flat``: the rows' features one after another."""
    moments = [(np.zeros_like(t), np.zeros_like(t)) for t in theta]
    starts, step = np.r_[0, np.cumsum(sizes)], 0
    while step < steps:
        order = random.permutation(len(sizes))
        for start in range(0, len(order), batch):
            take = order[start : start + batch]
            n = sizes[take]
            own = np.repeat(np.arange(len(take)), n)
            at = flat[np.repeat(starts[take] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
            v = theta[2][at]
            sums = np.zeros((len(take), v.shape[1]))
            np.add.at(sums, own, v)
            z = theta[0][0] + np.bincount(own, theta[1][at], len(take)) + 0.5 * ((sums**2).sum(axis=1) - np.bincount(own, (v**2).sum(axis=1), len(take)))
            error = (_all_scores(z) - labels[take]) / len(take)
            grads = [np.array([error.sum()]), np.bincount(at, error[own], len(theta[1])) + shrink * theta[1], shrink * theta[2]]
            np.add.at(grads[2], at, error[own, None] * (sums[own] - v))
            step += 1
            for t, g, (m, s) in zip(theta, grads, moments, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                t -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)


class _Rows:
    """Rows of terms, with the terms numbered; looked at in parts of about ``PART`` features, so that what a pass holds beside the rows is small."""

    def __init__(self, rows: list[np.ndarray]):
        flat = np.concatenate([np.empty(0, np.int32), *rows])
        n = np.bincount(flat, minlength=BUCKETS)
        self.terms = np.flatnonzero(n)
        self.n = n[self.terms].astype(np.float64)
        self.at = (np.cumsum(n > 0) - 1).astype(np.int32)[flat]
        self.sizes = np.array([len(r) for r in rows])
        self.starts = np.r_[0, np.cumsum(self.sizes)]

    def parts(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(rows, their features one after another, the row of each feature within the part)."""
        low = 0
        while low < len(self.sizes):
            high = max(low + 1, int(np.searchsorted(self.starts, self.starts[low] + PART, "right")) - 1)
            yield slice(low, high), self.at[self.starts[low] : self.starts[high]], np.repeat(np.arange(high - low), self.sizes[low:high])
            low = high

    def chosen(self, moving: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features that are moving, numbered among themselves, and how many each row has."""
        place, found, sizes = np.cumsum(moving) - 1, [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for rows, at, owner in self.parts():
            there = moving[at]
            found.append(place[at[there]])
            sizes.append(np.bincount(owner[there], minlength=rows.stop - rows.start))
        return np.concatenate(found), np.concatenate(sizes)

    def gradient(self, error: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.n))
        for rows, at, owner in self.parts():
            out += np.bincount(at, error[rows][owner], len(out))
        return out

    def interacting(self, error: np.ndarray, probes: int, powers: int, sigmas: float, least: float, random: np.random.Generator) -> np.ndarray:
        """Terms that stand out in the strongest directions of X' diag(error) X without its diagonal, X being rows by terms."""
        scale = 1 / np.sqrt(self.n * (error**2).mean() + least)
        own = self.gradient(error)

        def times(u: np.ndarray) -> np.ndarray:
            out = -own * u
            for rows, at, owner in self.parts():
                out += np.bincount(at, (error[rows] * np.bincount(owner, u[at], rows.stop - rows.start))[owner], len(u))
            return out

        directions = random.normal(size=(len(self.n), probes))
        for _ in range(powers):
            directions = np.linalg.qr(np.column_stack([scale * times(scale * u) for u in directions.T]))[0]
        found = np.zeros(len(self.n), bool)
        for u in (scale * d for d in directions.T):
            total, spread = np.zeros(len(u)), np.zeros(len(u))
            for rows, at, owner in self.parts():
                share = (error[rows] * np.bincount(owner, u[at], rows.stop - rows.start))[owner] - error[rows][owner] * u[at]
                total += np.bincount(at, share, len(u))
                spread += np.bincount(at, share**2, len(u))
            found |= (np.abs(total) > least * np.abs(u).max()) & (np.abs(total) > sigmas * np.sqrt(spread))
        return found


def fit(rows: list[np.ndarray], labels: np.ndarray, factors: int = 4, sigmas: float = 4.0, least: float = 4.0, pair_sigmas: float = 6.0, pair_least: float = 10.0, rounds: int = 6, steps: int = 300, batch: int = 512, rate: float = 0.05, shrink: float = 1e-4, seed: int = 7) -> FactorizationMachine:
    """Fits on rows of distinct hashed terms with labels 0 and 1."""
    labels = np.asarray(labels, np.float64)
    if not len(rows):
        return FactorizationMachine(-50.0, np.empty(0, np.int32), np.empty(0), np.empty((0, factors)))
    random = np.random.default_rng(seed)
    base = float(np.clip(labels.mean(), 1e-4, 1 - 1e-4))
    held = _Rows(rows)
    size = len(held.n)
    bias, weights, vectors, moving = np.array([np.log(base / (1 - base))]), np.zeros(size), np.zeros((size, factors)), np.zeros(size, bool)
    for _ in range(rounds if size else 0):
        error = labels - FactorizationMachine(float(bias[0]), held.terms[moving], weights[moving], vectors[moving]).scores(*held.chosen(moving))
        new = np.abs(held.gradient(error)) > sigmas * np.sqrt(held.n * (error**2).mean()) + least
        new = (new | held.interacting(error, 2, 4, pair_sigmas, pair_least, random)) & ~moving
        if not new.any():
            break
        moving |= new
        vectors[new] = random.normal(0, 0.05, (int(new.sum()), factors))
        theta = [bias, weights[moving], vectors[moving]]
        _adam(theta, *held.chosen(moving), labels, steps, batch, rate, shrink, random)
        bias, weights[moving], vectors[moving] = theta
    return FactorizationMachine(float(bias[0]), held.terms[moving].astype(np.int32), weights[moving], vectors[moving])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, sample_terms: int = 4096, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **how) -> FactorizationMachine:
    """Fits on a bounded sample; only the hashed terms of one text of each of its ids reach the driver."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # bounded, so it can be broadcast
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", F.col("label").cast("int").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t or "")[:sample_terms] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([f.tobytes() for f in found], pa.binary())], ["doc_id", "label", "terms"])

    one = in_batches(texts, run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, label int, terms binary").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("terms").alias("terms"))
    got = one.toArrow().sort_by("doc_id")
    return fit([np.frombuffer(t, np.int32) for t in got["terms"].to_pylist()], np.array([x > 0 for x in got["label"].to_pylist()]), **how)


class _Cache(dict):
    """Position of a word's term among the learned terms, or -1; a bounded memory."""

    def __init__(self, model: FactorizationMachine):
        self.place = {int(t): i for i, t in enumerate(model.terms)}

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        at = self[word] = self.place.get(crc32(word) & (BUCKETS - 1), -1)
        return at


def score(df: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", toxic_at: float = TOXIC_AT) -> DataFrame:
    """doc_id, score and predicted for each row; no shuffle. The model is of bounded size (that of the sample)."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shipped.value
        at = _Cache(machine).__getitem__
        for batch in batches:
            texts, out = [t or "" for t in batch.column(1).to_pylist()], []
            for start, end in in_slices(texts):
                flat, sizes = [], []
                for t in texts[start:end]:
                    found = set(map(at, features(t)))
                    found.discard(-1)
                    flat += sorted(found)
                    sizes.append(len(found))
                out.append(machine.scores(np.array(flat, np.int64), np.array(sizes, np.int64)))
            scores = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= toxic_at).astype(np.int32))], ["doc_id", "score", "predicted"])

    return in_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and label of every document, by a model of the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
