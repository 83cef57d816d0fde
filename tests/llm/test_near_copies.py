"""The near-dedup stage against brute-force Jaccard of five-word shingles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citeframe.llm import near_copies
from llm_plain import KIND, classes


def plain_shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def wanted(rows):
    sets = {i: plain_shingles(t) for i, t in rows}

    def near(a, b):
        return not sets[a] | sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])

    return {g[0] for g in classes([i for i, _ in rows], near)}


def near_rows():
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(500)]
    common = " ".join(r.choice(vocab) for _ in range(60))
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(3, 120))) for _ in range(25)]
    texts = []
    for t in base:
        for edits in (0, 1, 2, 3, 5, 9):
            w = t.split()
            for _ in range(edits):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(" ".join(w))
    texts += [f"{common} " + " ".join(r.choice(vocab) for _ in range(r.randint(2, 40))) for _ in range(60)]
    texts += ["Odd  CASE of the text here", "odd case of the text here", "one", "one two", "", " "]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("crowd", "rounds"), [(64, 6), (3, 2), (3, 0)])
def test_groups_by_brute_force(spark, crowd, rounds):
    rows = near_rows()
    docs = corpus_pipeline.keyed(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], KIND))
    keep = near_copies.representatives(docs, crowd, rounds, recall=0.99999)
    assert {r.doc_id for r in docs.join(keep, "row_key").collect()} == wanted(rows)


def test_stage_takes_near_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") < 9000)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert got == wanted(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_recall_of_pairs(spark):
    """Pairs just above 4/5 at the default recall; no group is larger than brute force says."""
    r = random.Random(15)
    texts, pairs = [], 400
    for _ in range(pairs):
        w = [f"w{r.randrange(10**6)}" for _ in range(100)]  # 96 shingles; a changed tail of 10 words leaves 86 of 106
        texts += [" ".join(w), " ".join(w[:90] + [f"x{r.randrange(10**6)}" for _ in range(10)])]
    docs = corpus_pipeline.keyed(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], KIND))
    kept = near_copies.representatives(docs).count()
    assert pairs <= kept <= pairs * 1.1


def test_large_group(spark):
    """A group of thousands of near copies among other texts, through crowded cells."""
    r = random.Random(16)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(2000):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(120)] = f"y{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", 1))
    rows += [(5000 + i, " ".join(f"w{r.randrange(10**6)}" for _ in range(80)), "en", "s", 1) for i in range(500)]
    docs = corpus_pipeline.keyed(spark.createDataFrame(rows, KIND))
    got = {x.doc_id for x in docs.join(near_copies.representatives(docs), "row_key").collect()}
    assert {0, *range(5000, 5500)} <= got and len(got) <= 505


def shuffled(spark):
    """Bytes that the session's tasks have written to shuffles."""
    context = spark._jsparkSession.sparkContext()
    context.listenerBus().waitUntilEmpty()
    found = context.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.fixture
def no_broadcasts(spark):
    """As on tables whose keys are too many to send everywhere."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    yield
    spark.conf.set(limit, before)


def test_texts_stay_in_place(spark, no_broadcasts):
    """The stage shuffles keys, cells and the texts of rows that may go, not the table's texts; every row that is not a near copy is there once."""
    r = random.Random(17)
    texts = [" ".join(f"{r.getrandbits(64):x}" for _ in range(1500)) for _ in range(300)]
    texts += [t + " end" for t in texts[:10]]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(299, texts[299], "en", "s", 1)] * 3
    docs = near_copies.written(corpus_pipeline.keyed(spark.createDataFrame(rows, KIND)).drop("row_key"))
    before = shuffled(spark)
    got = sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == list(range(300))
    assert shuffled(spark) - before < sum(map(len, texts)) / 2


@pytest.mark.parametrize("most", [near_copies.MARKS, 7])
def test_marks_lose_no_key(spark, monkeypatch, most):
    monkeypatch.setattr(near_copies, "MARKS", most)
    keys = spark.range(4000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("row_key"), "id")
    there = near_copies.marked(near_copies.marks(keys.where("id < 1000")))
    assert keys.where(there).where("id < 1000").count() == 1000
    assert most == 7 or keys.where(there).count() < 1100


def test_cells_are_of_bit_counts(spark):
    """Fingerprints that differ in every bit but agree in the bit counts of all segments share every cell, as in op7's grid; one more bit parts them where its segment is drawn."""
    tables = near_copies.plan(10_000)
    one, two = (np.full(near_copies.WORDS, x, np.uint64) for x in (0x5555555555555555, 0xAAAAAAAAAAAAAAAA))
    more = one.copy()
    more[2] |= np.uint64(1 << 11)  # segment 69
    rows = [(i, 1, bytearray(x.tobytes())) for i, x in enumerate((one, two, more))]
    nodes = spark.createDataFrame(rows, "node bigint, n int, print binary")
    cells = {(r.node, r.cell >> 40): r.cell for r in near_copies.placed(nodes, tables).collect()}
    assert len(cells) == 3 * len(tables)
    for k, segments in enumerate(tables):
        assert cells[0, k] == cells[1, k] and (cells[2, k] == cells[0, k]) == (69 not in segments)
    assert any(69 in s for s in tables)
