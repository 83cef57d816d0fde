"""Benchmark items whose weight sits in a few repeated words."""

import random

from citeframe.llm import decontaminate


def test_items_of_repeated_words(spark):
    r = random.Random(14)
    vocab = [f"w{i}" for i in range(300)]
    items = ["refrain " * 10, "hey ho " * 12, "row " * 30 + "boat"]
    docs = [(d, " ".join(r.choice(vocab) for _ in range(200))) for d in range(30)]
    docs += [(100 + k, f"{docs[k][1]} {item} {docs[k + 5][1]}") for k, item in enumerate(items)]
    ddf, idf = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([*enumerate(items)], "item_id bigint, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.leaks(ddf, idf).collect()} == {(100, 0), (101, 1), (102, 2)}
