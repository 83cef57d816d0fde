"""The pipeline against a brute-force version of every stage."""

import base64
import hashlib
import re

import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers as P
from citeframe.llm import decontaminate, language, secrets
from citeframe.llm.words import words
from llm_plain import AWKWARD, KIND, plain_base
from test_near_copies import wanted as near_representatives


def brute_force(spark, docs, bench):
    samples = language.training_texts(docs)
    parser = language.CrossParser(samples)
    rows = [r.asDict() for r in docs.select(corpus_pipeline.COLUMNS).collect()]
    rows = [r | {"lang": parser.predict([r["text"]])[0][0]} for r in rows if r["text"] and any(c.isalpha() for c in r["text"])]
    keep = near_representatives([(r["doc_id"], r["text"]) for r in rows])
    kept = [r for r in rows if r["doc_id"] in keep]
    items = [(words(b.text), decontaminate.answer_words(b.text)) for b in bench.collect() if words(b.text or "")]

    def leaks(text):
        w = words(text)
        for item, answer in items:
            n = len(item)
            for start in range(0, max(1, len(w) - n // 2), max(1, n // 4)):
                share, there = decontaminate.verify(item, answer, w[start : start + 2 * n])
                if share >= decontaminate.SURE or share >= decontaminate.LIKELY and there >= decontaminate.ANSWER:
                    return True
        return False

    kept = [r for r in kept if not leaks(r["text"])]
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {}
    for r in kept:
        text = r["text"]
        assert secrets.scan(text)[0] == plain_base(text)
        out[r["doc_id"]] = library.encode_ordinary(secrets.redact_text(text))
    return out


def staged(spark, docs, sf):
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf))
    return docs


def test_pipeline(spark, sf):
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    wanted = brute_force(spark, docs.where("length(text) < 9000"), bench)
    short = {r.doc_id for r in docs.where("length(text) < 9000").collect()}
    assert {k: v for k, v in got.items() if k in short} == {k: v for k, v in wanted.items()}


def test_stages_return_documents(spark, sf):
    docs = spark.createDataFrame(AWKWARD + [(20, 'a secret: "hunter2hunter2" here', "en", "s", 1)], KIND).withColumn("fp", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == corpus_pipeline.COLUMNS, name
    rows = {r.doc_id: r for r in docs.collect()}
    assert rows[20].text == "a [REDACTED]\" here" and rows[20].n_chars == len(rows[20].text)
    assert 3 in rows and 4 not in rows and 7 not in rows
    assert staged(spark, docs.where("false"), sf).count() == 0
    assert re.fullmatch("[0-9a-f]{64}", hashlib.sha256(b"").hexdigest())
