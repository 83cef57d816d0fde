"""The whole question-answering plan over DataFrames: retrieve, refuse or compose, cite and verify, for all questions at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeframe.functions import constants as K
from citeframe.functions.text import locator, tokens, without
from citeframe.operators import answer as A
from citeframe.operators import verify as V
from citeframe.operators.chunking import chunks_of
from citeframe.operators.index import bm25_top_k, hash_cosine_top_k
from citeframe.operators.retrieve import candidates, drop_overlaps, fuse, merge_variants, rerank
from citeframe.operators.understand import variants
from citeframe.session import forget, stored
from citeframe.sources.lines import lines_of


@dataclass
class Asked:
    """The tables an ask leaves behind."""

    sources: DataFrame
    gate: DataFrame
    answers: DataFrame
    citations: DataFrame
    verdicts: DataFrame
    result: DataFrame


@dataclass
class Index:
    """Stored tables that retrieval can use instead of the texts."""

    postings: DataFrame
    weights: DataFrame
    vectors: DataFrame


@dataclass
class Parts:
    """What retrieval is made of; any part can be replaced by a function of the same form.

    ``dense`` and ``lexical`` rank units for queries: (queries, units, by=, key=, and the stored tables as ``weights``, ``vectors`` or ``postings_of``) -> by, key, score, rank. ``reranker``: (pool, key) -> pool with score and rerank. ``expand``: queries (query_id, text) -> further variants (query_id, text), a model's for instance.
    """

    dense: Callable[..., DataFrame] = hash_cosine_top_k
    lexical: Callable[..., DataFrame] = bm25_top_k
    reranker: Callable[[DataFrame, str], DataFrame] = rerank
    expand: Callable[[DataFrame], DataFrame] | None = None


def more_variants(asked: DataFrame, further: DataFrame, most: int = K.MAX_VARIANTS) -> DataFrame:
    """``asked`` (query_id, variant_no, text) followed by ``further`` texts (query_id, text) that are not among them, ``most`` more for each question."""
    fresh = further.where("trim(text) <> ''").select("query_id", "text").distinct().join(asked.select("query_id", "text"), ["query_id", "text"], "left_anti")
    last = asked.groupBy("query_id").agg(F.max("variant_no").alias("last"))
    rows = fresh.join(last, "query_id").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("text"))).where(F.col("n") <= most)
    return asked.unionByName(rows.select("query_id", (F.col("last") + F.col("n")).alias("variant_no"), "text"))


def chunk_units(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.concat_ws(" ", "section", "text").alias("text"))


def retrieve(queries: DataFrame, chunks: DataFrame, final: int = K.TOP_FINAL, allowed: DataFrame | None = None, spelling: DataFrame | None = None, index: Index | None = None, parts: Parts | None = None) -> DataFrame:
    """The sources of each question: query_id, question, position, chunk columns, score."""
    asked = variants(queries.select("query_id", F.col("question").alias("text")), spelling)
    parts = parts or Parts()
    if parts.expand is not None:
        asked = stored(more_variants(asked, parts.expand(queries.select("query_id", F.col("question").alias("text")))))
    by = ["query_id", "variant_no"]
    units = chunk_units(chunks)
    dense = parts.dense(asked, units, by=by, key="chunk_id", weights=index and index.weights, vectors=index and index.vectors)
    fused = fuse(dense, parts.lexical(asked, units, by=by, key="chunk_id", postings_of=index and index.postings), by, "chunk_id")
    merged = merge_variants(fused, "chunk_id")
    if allowed is not None:
        merged = merged.join(chunks.select("chunk_id", "doc_id").join(allowed.select("doc_id").distinct(), "doc_id", "left_semi").select("chunk_id"), "chunk_id", "left_semi")
    few = stored(candidates(merged, final, key="chunk_id"))  # small, so that the chunks need not be shuffled to meet it
    held = chunks.join(few.select("chunk_id").distinct(), "chunk_id", "left_semi")
    pool = few.join(held, "chunk_id").join(queries.select("query_id", "question"), "query_id")
    return drop_overlaps(parts.reranker(pool, "chunk_id"), final).select("query_id", "question", "position", "chunk_id", "doc_id", "page_no", "line_start", "line_end", "section", "text", "score")


def ask(queries: DataFrame, docs: DataFrame | None, final: int = K.TOP_FINAL, allowed: DataFrame | None = None, chunks: DataFrame | None = None, lines: DataFrame | None = None, index: Index | None = None, spelling: DataFrame | None = None, parts: Parts | None = None) -> Asked:
    """Answers queries (query_id, question) from documents (doc_id, text)."""
    made = stored(chunks_of(docs)) if chunks is None else None
    sources = stored(retrieve(queries, made if chunks is None else chunks, final, allowed, spelling, index, parts))  # a few rows for each question, read by every later step
    if made is not None:
        forget(made)
    gate = stored(A.refusal(queries, sources))
    open_ = sources.join(gate.where("not refused").select("query_id"), "query_id", "left_semi")
    terms = variants(queries.select("query_id", F.col("question").alias("text"))).select("query_id", F.explode(without(tokens(F.col("text")), K.ANSWER_STOP, 1)).alias("t")).groupBy("query_id").agg(F.sort_array(F.collect_set("t")).alias("expanded"))
    answers = stored(A.compose(A.pick_sentences(A.sentence_scores(open_.join(terms, "query_id", "left")))))
    cited = A.citations(open_, answers)
    places = stored(cited.select("query_id", "position", "doc_id", "page_no", "line_start", "line_end"))
    if lines is None:  # of the cited documents only
        lines = lines_of(docs.join(places.select("doc_id").distinct(), "doc_id", "left_semi"))
    judged = stored(V.verdicts(V.claims(answers), cited, V.source_lines(places, lines)))
    ground = V.groundedness(judged)
    top = sources.where("position = 1").select("query_id", "doc_id", locator(F.col("page_no"), F.col("line_start"), F.col("line_end")).alias("locator"))
    rows = gate.join(answers.select("query_id", "answer"), "query_id", "left").join(ground, "query_id", "left").join(top, "query_id", "left")
    grounded = F.coalesce("groundedness", F.lit(0.0))
    result = rows.select(
        "query_id",
        F.coalesce("answer", F.lit(K.REFUSAL)).alias("answer"),
        "doc_id",
        "locator",
        "best_score",
        grounded.alias("groundedness"),
        F.coalesce("n_claims", F.lit(0)).alias("n_claims"),
        F.coalesce("n_supported", F.lit(0)).alias("n_supported"),
        "refused",
        "weak_evidence",
        V.confidence(F.col("refused"), F.col("weak_evidence"), grounded).alias("confidence"),
    )
    return Asked(sources, gate, answers, cited, judged, result)


def evaluate(queries: DataFrame, docs: DataFrame, gold: DataFrame, **how) -> DataFrame:
    """One case for each question, for the metrics of ``operators.evaluate``; gold: query_id, phrase. A question whose phrase no document contains is out of the corpus."""
    from citeframe.functions.text import contains_phrase
    from citeframe.operators.evaluate import OUT, gold_in_corpus

    asked = ask(queries, docs, **how)
    known = gold_in_corpus(gold.select(F.col("query_id").alias("item_id"), "phrase"), docs).select(F.col("item_id").alias("query_id"), "n_units")
    hits = asked.sources.join(gold, "query_id").select("query_id", "position", contains_phrase(F.col("text"), F.col("phrase")).alias("hit"))
    relevance = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", "hit"))).alias("r")).select("query_id", F.transform("r", lambda x: x["hit"]).alias("relevance"))
    rows = asked.result.join(known, "query_id").join(relevance, "query_id", "left").join(gold, "query_id")
    empty = F.array().cast("array<boolean>")
    return rows.select(
        "query_id",
        F.when(F.col("n_units") > 0, "in_corpus").otherwise(OUT).alias("category"),
        F.coalesce("relevance", empty).alias("relevance"),
        contains_phrase(F.col("answer"), F.substring("phrase", 1, 40)).alias("answer_hit"),
        F.coalesce(F.get("relevance", F.lit(0)), F.lit(False)).alias("citation_correct"),
        "groundedness",
        "refused",
        F.col("weak_evidence").alias("flagged"),
        "best_score",
    )
