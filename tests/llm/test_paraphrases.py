"""Decontamination against plain longest common subsequences, its singular vectors against numpy's, and awkward tables."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from citeframe.llm import decontaminate
from llm_plain import AWKWARD, KIND


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_contains(text, item):
    """Whether 0.7 of the item stands in order in a window of twice its length, or half of it with 0.8 of its last sentence."""
    w, v = (re.findall(r"[^\W_]+", t.lower()) for t in (text, item))
    last = {x for x in re.findall(r"[^\W_]+", [p for p in re.split("[.?!]", item.lower()) if p.strip()][-1])}
    for start in range(0, max(1, len(w) - len(v) // 2), max(1, len(v) // 4)):
        part = w[start : start + 2 * len(v)]
        share = plain_lcs(v, part) / len(v)
        if share >= 0.7 or share >= 0.5 and len(last & set(part)) >= 0.8 * len(last):
            return True
    return False


def test_recall_of_paraphrases(spark):
    sf = "/root/testdata/sf0.01"
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    items, texts = [r.text for r in bench.orderBy("item_id").collect()], [r.text for r in docs.where("length(text) between 300 and 3000").orderBy("doc_id").limit(200).collect()]
    ids = [r.item_id for r in bench.orderBy("item_id").collect()]
    r = random.Random(21)
    vocabulary = sorted({w for t in texts for w in t.split()})
    planted, rows = {}, []
    for n, text in enumerate(texts):
        k, rate = r.randrange(len(items)), r.choice((0.1, 0.2, 0.3))
        changed = []
        for w in items[k].split():
            u = r.random()
            if u > rate or n % 3 == 2:
                changed.append(w)
            if u <= rate and n % 3:
                changed.append(r.choice(vocabulary))
        own = text.split()
        at = r.randint(0, len(own))
        rows.append((10**6 + n, " ".join(own[:at] + changed + own[at:])))
        if plain_contains(" ".join(changed), items[k]):
            planted[10**6 + n] = ids[k]
    both = docs.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(both, bench).collect()}
    assert len(planted) > 150 and sum(p in got for p in planted.items()) >= 0.95 * len(planted)
    known = dict(rows)
    item = dict(zip(ids, items, strict=True))
    assert all(plain_contains(known[d], item[i]) for d, i in got if d in known and planted.get(d) != i)


def test_singular_vectors():
    r = np.random.default_rng(3)
    passages = [[b"w%d" % (7 * k + j) for j in r.integers(0, 7, 20)] for k in range(30) for _ in range(4 + k)]
    index = decontaminate.build_index(list(range(len(passages))), [b" ".join(p).decode() for p in passages], {}, 1000)
    sums = np.zeros((len(index.idf), 40 + decontaminate.EXTRA), np.float32)
    row, word = decontaminate._cells(index, passages)
    half = np.searchsorted(row, len(passages) // 2)
    energy = sum(decontaminate.add_products(sums, index, row[part], word[part]) for part in (slice(0, half), slice(half, None)))
    a = np.zeros((len(passages), len(index.idf)))
    np.add.at(a, (row, word), index.idf[word])
    assert np.isclose(energy, (a**2).sum())
    v = decontaminate.singular_vectors(sums, 40)
    best = (np.linalg.svd(a)[1][:40] ** 2).sum()
    assert ((a @ v) ** 2).sum() > 0.95 * best and np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-6)


def test_ids_and_awkward_tables(spark):
    text = "unusual words stand here in a row of their own making for one item only"
    big = 2**60 + 1
    docs = spark.createDataFrame([*AWKWARD, (big, f"before it {text} behind it", "en", "s", 1), (12, "word " * 60_000 + text, "en", "s", 1)], KIND).withColumn("item_id", F.lit("clash")).withColumn("cosine", F.lit("clash")).withColumn("subsequence", F.lit(1))
    bench = spark.createDataFrame([(None, text), (big, text), (big + 2, text), (5, None), (6, "")], "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs, bench).collect()}
    assert got == {(d, i) for d in (big, 12) for i in (None, big, big + 2)}
    assert decontaminate.leaks(docs.where("false"), bench).count() == decontaminate.leaks(docs, bench.where("false")).count() == 0
