"""Rows without an id, or with a shared one, are judged by their own texts."""

import corpus_pipeline
from llm_plain import KIND


def test_rows_are_judged_alone(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    clean = [f"{w} stands here in a text of its own about {w} and nothing else but {w}s" for w in ("apples", "bread", "cloth", "dust", "earth")]
    rows = [(None, clean[0]), (None, clean[1]), (7, clean[2]), (7, clean[3]), (8, clean[4]), (None, item), (7, item + " and more"), (8, clean[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], KIND)

    def texts(df):
        return sorted(r.text for r in df.collect())

    assert texts(corpus_pipeline.decontamination(spark, docs, sf)) == sorted([*clean, clean[4]])
    kept = corpus_pipeline.near_dedup(spark, docs, sf)
    assert texts(kept) == sorted([*clean, item + " and more"])  # the item without an id is a near copy of that of row 7
