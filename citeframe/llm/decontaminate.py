"""Benchmark decontamination by latent semantic retrieval.

The TF-IDF matrix has a row for every passage: the benchmark items, and every document cut into passages of about an item's length (document frequencies come from all documents). Its columns are the items' informative words; beyond ``COLUMNS`` of them, words share columns. A randomised SVD of rank ``RANK`` is computed over all executors: each task multiplies its passages with a random matrix and back, the products are summed over the tasks, and their sum, no larger than ``COLUMNS`` * (``RANK`` + ``EXTRA``) numbers whatever the data, gives the right singular vectors (Nystroem's method). Items weigh as much as all document passages together.

A second reading searches candidates: windows as long as the items of a class (items of similar length and norm) slide over the whole text. A window is kept where its mass (squared IDF of each occurrence) is a quarter or more of the least mass among the items of the class, its latent vector is compared with those of all items of the class, and pairs at ``MIN_COSINE`` or more are candidates. Candidates are verified on words: the longest common subsequence of the item and the text around the window, as a share of the item, and the share of the item's answer (the part after ``answer:``, else its last sentence) that is there. A document contains an item where the subsequence is ``SURE`` or more of it, or, for paraphrases, ``LIKELY`` or more with ``ANSWER`` of the answer.

Words in more documents than ``COMMON`` (a share; and than ``COMMON_LEAST``) are a stop list of the retrieval, unless they are among an item's ``RAREST`` rarest; verification counts all words.

What a task holds is bounded: a pass takes up to ``ITEMS_AT_ONCE`` items and about ``CHARS_AT_ONCE`` characters of them. Nulls count as empty; items and documents without words match nothing, and empty tables give no rows. Repeated documents give repeated rows, repeated items one row each; an item without an id gives rows with a null item_id. Columns other than those named are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import in_batches, in_slices, table
from .words import words

ITEMS_AT_ONCE = 4096
CHARS_AT_ONCE = 500_000
COLUMNS = 1 << 14
RANK = 96
EXTRA = 8
MIN_COSINE = 0.45
#: Least mass of a window, as a share of the least among a class's items.
LEAST_MASS = 0.25
SURE = 0.7
LIKELY = 0.5
ANSWER = 0.8
COMMON = 0.005
COMMON_LEAST = 20
RAREST = 8
#: Columns in one row of a task's sums.
CHUNK = 256


@dataclass
class Index:
    """The items of a pass: their informative words, and their words and answers for verification."""

    ids: list
    texts: list[list[bytes]]
    answers: list[list[bytes]]
    vocabulary: dict[bytes, int]
    idf: np.ndarray  # of each word of the vocabulary
    columns: np.ndarray  # its column
    classes: list[tuple[int, float, np.ndarray]]  # window, least mass, items
    passage: int  # words in a passage of a document
    basis: np.ndarray | None = None  # columns x dimensions
    latent: np.ndarray | None = None  # items x dimensions, of length 1


def answer_words(text: str) -> list[bytes]:
    marked = re.search(r"(?i)\banswer\s*:(.*)\Z", text, re.DOTALL)
    if marked and words(marked[1]):
        return words(marked[1])
    sentences = [w for w in map(words, re.split(r"[.?!]+", text)) if w]
    return sentences[-1] if sentences else []


def build_index(ids: list, texts: list[str], df: dict[bytes, int], n_docs: int) -> Index:
    items = [words(t) for t in texts]
    weight = {w: float(np.log((n_docs + 1) / (df.get(w, 0) + 1)) + 0.1) for item in items for w in item}
    chosen = set()
    for item in items:
        rare = sorted(set(item), key=lambda w: (-weight[w], w))
        chosen.update(rare[:RAREST], (w for w in rare if df.get(w, 0) <= max(COMMON_LEAST, COMMON * n_docs)))
    vocabulary = {w: i for i, w in enumerate(sorted(chosen))}
    idf = np.array([weight[w] for w in vocabulary])
    index = Index(ids, items, [answer_words(t) for t in texts], vocabulary, idf, np.arange(len(vocabulary), dtype=np.int32) % COLUMNS, [], 1)
    lengths = np.array([len(i) for i in items])
    row, word = _cells(index, items)
    cells, count = np.unique(row * np.int64(len(idf) + 1) + word, return_counts=True)
    own, at = cells // (len(idf) + 1), cells % (len(idf) + 1)
    norm = np.sqrt(np.bincount(own, (count * idf[at]) ** 2, len(items)))
    mass = np.bincount(row, idf[word] ** 2, len(items))  # as that of windows: each occurrence counts once, so a repeated word weighs no more in the least mass than in a copy
    kinds: dict[tuple[int, int], list[int]] = {}
    for i in np.flatnonzero((lengths > 0) & (norm > 0)):
        kinds.setdefault((int(np.ceil(np.log2(lengths[i]))), int(np.floor(np.log2(norm[i])))), []).append(int(i))
    index.classes = [(int(max(lengths[at]) * 1.25) + 2, float(LEAST_MASS * mass[at].min()), np.array(at)) for at in kinds.values()]
    index.passage = max(1, int(np.median(lengths)))
    return index


def _cells(index: Index, passages: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Passage and vocabulary position of every informative word, in order."""
    get = index.vocabulary.get
    at = [[p for p in map(get, passage) if p is not None] for passage in passages]
    return np.repeat(np.arange(len(at), dtype=np.int64), [len(a) for a in at]), np.array([p for a in at for p in a], np.int64)


@lru_cache(maxsize=1)
def random_matrix(width: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((COLUMNS, width), np.float32)


def add_products(sums: np.ndarray, index: Index, row: np.ndarray, word: np.ndarray) -> float:
    """Adds to ``sums`` the product A' A R of the passages' TF-IDF rows A (given by ``_cells``) and the random matrix R; returns the squared norm of A."""
    if not len(row):
        return 0.0
    column, value = index.columns[word], index.idf[word].astype(np.float32)
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    sizes = np.diff(np.r_[starts, len(row)])
    products = np.add.reduceat(random_matrix(sums.shape[1])[column] * value[:, None], starts, axis=0)
    order = np.argsort(column, kind="stable")
    back = np.repeat(products, sizes, axis=0)[order] * value[order, None]
    first = np.flatnonzero(np.r_[True, np.diff(column[order]) != 0])
    sums[column[order][first]] += np.add.reduceat(back, first, axis=0)
    cells, at = np.unique(row * np.int64(COLUMNS) + column, return_inverse=True)
    return float((np.bincount(at, value) ** 2).sum())


def singular_vectors(sums: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (columns x dimensions) from A' A R."""
    z = sums.astype(np.float64)
    core = random_matrix(z.shape[1])[: len(z)].astype(np.float64).T @ z
    w, u = np.linalg.eigh((core + core.T) / 2)
    good = w > 1e-7 * max(w.max(), 1e-30)
    v, s, _ = np.linalg.svd(z @ (u[:, good] / np.sqrt(w[good])), full_matrices=False)
    return v[:, :rank][:, s[:rank] > 1e-6 * max(s.max(initial=0), 1e-30)]


def fit(index: Index, docs: DataFrame) -> None:
    """Gives the index its latent space: the randomised SVD over the passages of all ``docs`` (one column, the text) and the items."""
    width, n_columns = RANK + EXTRA, min(COLUMNS, len(index.idf))
    shipped = docs.sparkSession.sparkContext.broadcast(index)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums, energy = shipped.value, np.zeros((n_columns, width), np.float32), 0.0
        for batch in batches:
            read = [t or "" for t in batch.column(0).to_pylist()]
            for start, end in in_slices(read):
                passages = [w[i : i + own.passage] for w in map(words, read[start:end]) for i in range(0, len(w), own.passage)]
                energy += add_products(sums, own, *_cells(own, passages))
        parts = [(k, sums[k : k + CHUNK]) for k in range(0, n_columns, CHUNK)]
        parts = [(k, p.tobytes()) for k, p in parts if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *(k for k, _ in parts)], pa.int32()), pa.array([np.float32(energy).tobytes(), *(p for _, p in parts)], pa.binary())], ["chunk", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(part, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in held.values()], pa.binary())], ["chunk", "sums"])

    partial = in_batches(docs, sketch, "chunk int, sums binary")
    for salt in (F.pmod(F.spark_partition_id(), F.lit(16)), F.lit(0)):  # in two levels, so that no task adds up the sums of all tasks
        dealt = partial.withColumn("salt", salt).repartition("chunk", "salt").select("chunk", "sums")
        partial = in_batches(dealt, total, "chunk int, sums binary")
    found = {r.chunk: np.frombuffer(r.sums, np.float32) for r in partial.collect()}
    own = np.zeros((n_columns, width), np.float32)
    energy = add_products(own, index, *_cells(index, index.texts))
    z = own.astype(np.float64) / max(energy, 1e-12)
    from_docs = float(found.pop(-1, np.zeros(1))[0])
    for k, part in found.items():
        z[k : k + CHUNK] += part.reshape(-1, width) / max(from_docs, 1e-12)
    index.basis = singular_vectors(z).astype(np.float32)
    index.latent = np.zeros((len(index.ids), index.basis.shape[1]), np.float32)
    row, word = _cells(index, index.texts)
    np.add.at(index.latent, row, index.basis[index.columns[word]] * index.idf[word, None].astype(np.float32))
    index.latent /= np.maximum(np.linalg.norm(index.latent, axis=1), 1e-12)[:, None]


def common_subsequence(masks: dict[bytes, int], length: int, text: list[bytes]) -> int:
    """Length of the longest common subsequence; ``masks``: for each word of the one side the bits of its places."""
    full = (1 << length) - 1
    v = full
    for w in text:
        if u := v & masks.get(w, 0):
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def verify(item: list[bytes], answer: list[bytes], text: list[bytes]) -> tuple[float, float]:
    """Share of the item in the common subsequence, and share of the answer's distinct words in ``text``."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    there = set(text)
    wanted = set(answer)
    return common_subsequence(masks, len(item), text) / len(item), len(wanted & there) / len(wanted) if wanted else 1.0


def candidates(index: Index, vectors: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(start, end, item, cosine) of windows over ``at``, the vocabulary positions of consecutive words (-1: none); ``vectors``: the weighted latent vectors of the vocabulary."""
    known = np.flatnonzero(at >= 0)
    if not len(known):
        return
    v = at[known]
    mass = np.r_[0.0, np.cumsum(index.idf[v] ** 2)]
    for window, least, items in index.classes:
        stride = max(1, window // 4)
        start = np.unique(np.maximum(0, (known[:, None] // stride - np.arange(4)[None, :]) * stride))  # windows that hold a known word
        lo, hi = np.searchsorted(known, start), np.searchsorted(known, start + window)
        go = mass[hi] - mass[lo] >= least
        start, lo, hi = start[go], lo[go], hi[go]
        for part in range(0, len(start), 4096):
            a, b = lo[part : part + 4096], hi[part : part + 4096]
            sizes = b - a
            flat = np.repeat(a - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            seen = np.add.reduceat(vectors[v[flat]], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
            cosine = seen @ index.latent[items].T / np.maximum(np.linalg.norm(seen, axis=1), 1e-12)[:, None]
            for row, k in zip(*np.nonzero(cosine >= MIN_COSINE), strict=True):
                yield int(start[part + row]), int(start[part + row]) + window, int(items[k]), float(cosine[row, k])


def contained(index: Index, vectors: np.ndarray, docs: list[list[bytes]]) -> list[tuple[int, int, float, float, float]]:
    """(document, item, cosine, subsequence share, answer share), the best for each pair that passes."""
    gap = max((c[0] for c in index.classes), default=0) + 1
    get = index.vocabulary.get
    starts = np.cumsum([0, *(len(d) + gap for d in docs)])
    at = np.full(starts[-1], -1, np.int32)
    for d, s in zip(docs, starts, strict=False):
        at[s : s + len(d)] = np.fromiter((get(w, -1) for w in d), np.int32, len(d))
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for start, end, item, cosine in candidates(index, vectors, at):
        doc = int(np.searchsorted(starts, start, "right")) - 1
        if start >= starts[doc] + len(docs[doc]):  # begins in the gap before the next document
            doc += 1
        if doc >= len(docs) or best.get((doc, item), (0,))[0] >= 1:
            continue
        reach = len(index.texts[item]) // 2 + 1
        share, answer = verify(index.texts[item], index.answers[item], docs[doc][max(0, start - starts[doc] - reach) : max(0, end - starts[doc] + reach)])
        if share >= SURE or share >= LIKELY and answer >= ANSWER:
            best[doc, item] = max(best.get((doc, item), (0.0, 0.0, 0.0)), (share, answer, cosine))
    return [(d, i, c, s, a) for (d, i), (s, a, c) in sorted(best.items())]


def document_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many of all documents each word of ``vocabulary`` occurs, and the number of documents. ``vocabulary`` is that of a bounded set of items."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, found, n = shipped.value, {}, 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n += len(texts)
            for t in texts:
                for w in wanted.intersection(words(t or "")):
                    found[w] = found.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([None, *found], pa.binary()), pa.array([n, *found.values()], pa.int64())], ["word", "n"])

    rows = in_batches(docs, run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {None if r.word is None else bytes(r.word): r.n for r in rows}
    return counts, counts.pop(None, 0)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, cosine, subsequence, answer: every benchmark item that a document contains. No shuffle of documents."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text")).where("trim(text) <> ''")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id bigint, cosine double, subsequence double, answer double"
    n_items, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    out = docs.sparkSession.createDataFrame([], schema)
    n_passes = max(-(-n_items // ITEMS_AT_ONCE), -(-chars // CHARS_AT_ONCE))
    for k in range(n_passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_passes)) == k)
        found = _pass(rows, part, schema)
        out = found if n_passes == 1 else out.union(found)
    return out


def _pass(rows: DataFrame, items: DataFrame, schema: str) -> DataFrame:
    """For as many items as one broadcast is allowed to hold."""
    texts = sorted(items.collect(), key=lambda r: (r.item_id is None, r.item_id, r.text))
    vocabulary = {w for r in texts for w in words(r.text)}
    index = build_index([r.item_id for r in texts], [r.text for r in texts], *document_frequencies(rows.select("text"), vocabulary))
    if not index.classes:
        return rows.sparkSession.createDataFrame([], schema)
    fit(index, rows.select("text"))
    shipped = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        vectors = own.basis[own.columns] * own.idf[:, None].astype(np.float32)
        for batch in batches:
            read = [t or "" for t in batch.column(0).to_pylist()]
            for start, end in in_slices(read):
                found = contained(own, vectors, [words(t) for t in read[start:end]])
                if found:
                    d, i, cosine, share, answer = zip(*found, strict=True)
                    keys = batch.column(1).take(pa.array([start + x for x in d], pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array([own.ids[x] for x in i], pa.int64()), pa.array(cosine), pa.array(share), pa.array(answer)], ["doc_id", "item_id", "cosine", "subsequence", "answer"])

    return in_batches(rows, run, schema)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item that it contains."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
