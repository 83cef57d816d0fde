"""All queries of the library by name, and DuckDB SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeframe import oracle
from citeframe.oracle import LITERAL_ANSWERS, LITERAL_QUESTIONS
from citeframe.functions import text as X
from citeframe.operators import answer as A
from citeframe.operators import evaluate as E
from citeframe.operators import history as H
from citeframe.operators import index as I
from citeframe.operators import retrieve as R
from citeframe.operators import study as S
from citeframe.operators import understand as U
from citeframe.operators import verify as V
from citeframe.operators.chunking import chunks_of, union_box
from citeframe.plans.ask import ask, evaluate
from citeframe.session import stored, workers_find_package
from citeframe.sources import lines as L
from citeframe.streaming.ingest import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        workers_find_package(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve words of each benchmark passage."""
    first = F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 12), " ")
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), first.alias("question"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).withColumnRenamed("question", "text")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixty normalised characters of each passage."""
    return load(spark, sf_dir, "benchmark").select("item_id", F.trim(F.substring(X.normalise_for_compare(F.col("text")), 1, 60)).alias("phrase"))


def literal(spark: SparkSession, texts: list[str], key: str, value: str) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(i).alias(key), F.lit(t).alias(value)) for i, t in enumerate(texts)))
    return spark.range(1).select(F.inline(rows))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.messages_of(load(spark, sf_dir, "conversations"))


# ------------------------------------------------------------------ sources and chunks
@query
def doc_lines(spark, sf):
    return L.lines_of(units(spark, sf)).withColumn("words", X.word_count(F.col("text")))


@query
def doc_registry(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.size(L.line_array(F.col("text"))).alias("n_lines"))
    first = docs.groupBy("sha256").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
    rows = docs.join(first, "sha256")
    return rows.select("doc_id", X.stable_id(F.col("source"), F.col("sha256")).alias("stable_id"), "sha256", "n_lines", F.ceil(F.col("n_lines") / 40).cast("int").alias("n_pages"), (F.col("doc_id") != F.col("first_doc")).alias("skipped"), "copies")


@query
def doc_rejected(spark, sf):
    docs = units(spark, sf)
    return docs.where(F.size(L.line_array(F.col("text"))) == 0).select("doc_id", F.lit("no extractable text").alias("error"))


@query
def headings(spark, sf):
    return L.lines_of(units(spark, sf)).where(X.is_heading(F.col("text")))


@query
def caps_ratios(spark, sf):
    return L.lines_of(units(spark, sf)).select("doc_id", "page_no", "line_no", F.round(X.caps_ratio(F.col("text")), 6).alias("caps"))


@query
def chunks(spark, sf):
    return chunks_of(units(spark, sf)).drop("text")


@query
def chunk_lines(spark, sf):
    """The lines of each chunk by a range join, counted and hashed; they are the chunk's text."""
    docs = units(spark, sf)
    c = chunks_of(docs).select("chunk_id", "doc_id", "page_no", "line_start", "line_end")
    lines = L.lines_of(docs)
    met = c.join(lines, ["doc_id", "page_no"]).where(F.col("line_no").between(F.col("line_start"), F.col("line_end")))
    return met.groupBy("chunk_id").agg(F.count("*").alias("n_lines"), F.sum(X.word_count(F.col("text"))).alias("n_words"))


@query
def html_lines(spark, sf):
    return L.html_lines(load(spark, sf, "pages"))


@query
def reading_order(spark, sf):
    """Positioned lines: words of a document as objects on a grid."""
    spans = L.lines_of(units(spark, sf)).select("doc_id", "page_no", F.col("line_no").alias("ord"), "text", (F.col("line_no") % 3 * 100.0).alias("x0"), (F.floor(F.col("line_no") / 3) * 12.0 + F.col("line_no") % 2).alias("y0"))
    spans = spans.withColumn("x1", F.col("x0") + 90.0).withColumn("y1", F.col("y0") + 10.0)
    return L.positioned_lines(spans).select("doc_id", "page_no", "ord", "line_no", "row_span")


@query
def highlight_boxes(spark, sf):
    """The box around each chunk's lines, where a line is 12 points high, grouped by page."""
    c = chunks_of(units(spark, sf))
    boxes = F.transform(F.sequence("line_start", "line_end"), lambda n: F.struct(F.lit(64.0).alias("x0"), (12.0 * n).alias("y0"), F.lit(530.0).alias("x1"), (12.0 * n + 11.0).alias("y1")))
    b = c.select("doc_id", "page_no", union_box(boxes).alias("b"))
    return b.groupBy("doc_id", "page_no").agg(F.count("*").alias("n_spans"), F.min("b.y0").alias("top"), F.max("b.y1").alias("bottom"))


# ------------------------------------------------------------------ text functions
@query
def sentences(spark, sf):
    return S.sentences_of(units(spark, sf), "doc_id")


@query
def markers(spark, sf):
    rows = literal(spark, LITERAL_ANSWERS, "id", "text")
    t = F.col("text")
    return rows.select("id", F.array_join(X.parse_markers(t), ",").alias("numbers"), X.strip_markers(t).alias("plain"), X.attach_trailing_markers(t).alias("attached"), A.sanitize(t, F.lit(3)).alias("clean"), F.array_join(A.valid_markers(t, F.lit(3)), ",").alias("valid"))


@query
def number_tokens(spark, sf):
    return units(spark, sf).select("doc_id", F.array_join(F.sort_array(X.numbers(F.col("text"))), ",").alias("numbers"))


@query
def body_texts(spark, sf):
    c = chunks_of(units(spark, sf))
    return c.select("chunk_id", F.length(X.body_text(F.col("text"), F.col("section"))).alias("body_chars"), F.col("locator"))


# ------------------------------------------------------------------ index
@query
def tokens_tf(spark, sf):
    return I.postings(units(spark, sf))


@query
def term_df_idf(spark, sf):
    return I.term_weights(units(spark, sf)).withColumn("idf", F.round("idf", 6))


@query
def index_stats(spark, sf):
    docs = units(spark, sf).select("doc_id", F.size(X.tokens(F.col("text"))).alias("n"), F.size(L.line_array(F.col("text"))).alias("lines"))
    return docs.agg(F.count("*").alias("documents"), F.sum("lines").alias("lines"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 4).alias("avg_len"))


@query
def vocabulary(spark, sf):
    return U.vocabulary(units(spark, sf))


@query
def bm25_topk(spark, sf):
    return I.bm25_top_k(asked(spark, sf), units(spark, sf))


@query
def hash_features(spark, sf):
    return I.hashed(units(spark, sf), ["doc_id"]).select("doc_id", F.inline("terms"))


@query
def hash_idf(spark, sf):
    docs = units(spark, sf)
    return I.hash_idf(I.hashed(docs, ["doc_id"]), docs).withColumn("idf", F.round("idf", 6))


@query
def hash_cosine_topk(spark, sf):
    return I.hash_cosine_top_k(asked(spark, sf), units(spark, sf))


def _vectors(spark, sf):
    e = load(spark, sf, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("q_label")), e


@query
def dense_topk(spark, sf):
    """Every vector whose id is divisible by 50 against all vectors."""
    q, e = _vectors(spark, sf)
    return I.dense_top_k(q.select("query_id", "q"), e)


@query
def dense_precision(spark, sf):
    """Share of each query vector's neighbours that have its label."""
    q, e = _vectors(spark, sf)
    top = I.dense_top_k(q.select("query_id", "q"), e).join(e.select("vec_id", "label"), "vec_id").join(q.select("query_id", "q_label"), "query_id")
    return top.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("q_label")).cast("double")), 4).alias("label_precision"))


# ------------------------------------------------------------------ retrieval
def _rankings(spark, sf, by=None, queries=None):
    q, u = queries if queries is not None else asked(spark, sf), units(spark, sf)
    return I.hash_cosine_top_k(q, u, by=by), I.bm25_top_k(q, u, by=by)


@query
def rrf_fusion(spark, sf):
    d, x = _rankings(spark, sf)
    return R.fuse(d, x, ["query_id"], "doc_id")


@query
def query_variants(spark, sf):
    return U.variants(asked(spark, sf).unionByName(literal(spark, LITERAL_QUESTIONS, "query_id", "text").withColumn("query_id", -1 - F.col("query_id"))))


@query
def multi_query_merge(spark, sf):
    v = U.variants(asked(spark, sf))
    by = ["query_id", "variant_no"]
    d, x = _rankings(spark, sf, by, v)
    return R.merge_variants(R.fuse(d, x, by, "doc_id"), "doc_id")


def _english(spark, sf):
    return load(spark, sf, "documents").where("lang = 'en'").select("doc_id")


@query
def doc_filter_semi(spark, sf):
    d, x = _rankings(spark, sf)
    fused = R.fuse(d, x, ["query_id"], "doc_id")
    return R.candidates(fused, allowed=_english(spark, sf)).select("query_id", "doc_id", "fused", "rank")


def _pool(spark, sf):
    d, x = _rankings(spark, sf)
    c = R.candidates(R.fuse(d, x, ["query_id"], "doc_id"))
    docs = units(spark, sf).withColumn("section", F.lit(""))
    return c.join(docs, "doc_id").join(questions(spark, sf), "query_id")


@query
def rerank_lexical(spark, sf):
    r = R.rerank(_pool(spark, sf))
    return r.select("query_id", "doc_id", *(F.round(c, 6).alias(c) for c in ("coverage", "proximity", "repetition", "phrase", "sufficiency")), F.col("window").cast("int").alias("window"), "score", "rerank")


@query
def overlap_drop(spark, sf):
    """Chunks of each document in order of length, without those that overlap a kept one."""
    c = chunks_of(units(spark, sf)).withColumn("query_id", F.col("doc_id"))
    ranked = c.withColumn("rerank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("text").desc(), "chunk_id")))
    return R.drop_overlaps(ranked.drop("text", "section", "locator")).select("query_id", "chunk_id", "rerank", "position")


@query
def spelling_repair(spark, sf):
    """The second and fifth word of each passage with a letter left out."""
    w = F.slice(F.filter(X.tokens(F.col("text")), lambda t: F.length(t) >= 7), 1, 3)
    q = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.transform(w, lambda t: F.concat(F.substring(t, 1, 3), t.substr(F.lit(5), F.length(t)))), " ").alias("text"))
    return U.repair_spelling(q, U.vocabulary(units(spark, sf)))


@query
def intent_route(spark, sf):
    rows = literal(spark, LITERAL_QUESTIONS, "query_id", "text")
    return U.route(rows).select("query_id", "intent", U.topic_of_interest(F.col("text")).alias("topic"))


# ------------------------------------------------------------------ answers
def _sources(spark, sf):
    r = R.rerank(_pool(spark, sf)).where("rerank <= 5")
    rows = r.select("query_id", "question", F.col("rerank").alias("position"), "doc_id", F.lit(1).alias("page_no"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), "section", "text", "score", F.lit(None).cast("array<string>").alias("expanded"))
    return stored(rows)


@query
def refusal_gate(spark, sf):
    return A.refusal(questions(spark, sf), _sources(spark, sf))


@query
def sentence_scoring(spark, sf):
    return A.sentence_scores(_sources(spark, sf))


@query
def extractive_answer(spark, sf):
    made = A.compose(A.pick_sentences(A.sentence_scores(_sources(spark, sf))))
    return made.select("query_id", "answer", F.array_join("used", ",").alias("used"))


@query
def citations(spark, sf):
    s = _sources(spark, sf)
    made = A.compose(A.pick_sentences(A.sentence_scores(s)))
    return A.citations(s, made).select("query_id", "marker", "doc_id", F.length("quote").alias("quote_chars"), "retrieval_score", "used_in_answer")


@query
def overview(spark, sf):
    return A.overview(_sources(spark, sf))


@query
def support_coverage(spark, sf):
    """Each benchmark passage as a claim against the top sources of its question."""
    s = _sources(spark, sf).select("query_id", "position", "text").join(load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("claim")), "query_id")
    recall = V.number_recall(F.col("claim"), F.col("text"))
    return s.select("query_id", "position", F.round(V.coverage(F.col("claim"), F.col("text")), 6).alias("coverage"), F.round(recall, 6).alias("number_recall"))


def _verdicts(spark, sf):
    return ask(questions(spark, sf), units(spark, sf))


@query
def support_windows(spark, sf):
    v = _verdicts(spark, sf).verdicts
    return v.select("query_id", "sentence_no", "position", "doc_id", "page_no", "first_line", "last_line", "score", "best", "supported")


@query
def narrowed_citations(spark, sf):
    return V.narrowed(_verdicts(spark, sf).verdicts)


@query
def ask_batch(spark, sf):
    return ask(questions(spark, sf), units(spark, sf)).result


# ------------------------------------------------------------------ history
@query
def session_list(spark, sf):
    return H.sessions(messages(spark, sf))


@query
def recent_sessions(spark, sf):
    return H.recent_sessions(H.sessions(messages(spark, sf)))


@query
def sessions_with_empty(spark, sf):
    """All sessions with their number of system messages, which most have none of."""
    m = messages(spark, sf)
    return H.with_empty(m.select("session_id").distinct(), m.where("role = 'system'"))


@query
def citation_paths(spark, sf):
    """Labelled documents with a path: the source where the registry, of English documents, has them."""
    known = load(spark, sf, "documents").where("lang = 'en'").select("doc_id", F.col("source").alias("path"))
    return H.with_paths(load(spark, sf, "labels").select("doc_id"), known, "files")


@query
def located_facts(spark, sf):
    """The lines of each document that best support each of its salient facts."""
    every = units(spark, sf)
    facts = stored(S.salient_facts(every, "doc_id").select(F.col("doc_id").alias("own"), "sentence_no", F.col("sentence").alias("claim")))
    docs = stored(every.join(facts.select(F.col("own").alias("doc_id")).distinct(), "doc_id", "left_semi"))  # few have facts
    chunks = stored(chunks_of(docs))
    held = facts.join(chunks.select(F.col("doc_id").alias("own"), "chunk_id"), "own")
    return S.locate(held, chunks, L.lines_of(docs), "own", "sentence_no").drop("own").withColumn("score", F.round("score", 6))


@query
def history_pairs(spark, sf):
    return H.pairs(messages(spark, sf), 3)


@query
def history_stats(spark, sf):
    return H.stats(messages(spark, sf))


@query
def history_search(spark, sf):
    return H.search(messages(spark, sf), asked(spark, sf))


@query
def history_contains(spark, sf):
    return H.contains(messages(spark, sf), "the").select("session_id", "seq", "role")


@query
def feedback_upsert(spark, sf):
    old = load(spark, sf, "labels").select(F.col("doc_id").alias("message_id"), F.col("quality").alias("rating"), F.lit("quality").alias("note"), (F.col("doc_id") % 3).alias("created_at"))
    new = load(spark, sf, "labels").select(F.col("doc_id").alias("message_id"), F.col("toxic").alias("rating"), F.lit("toxic").alias("note"), (F.col("doc_id") % 2).alias("created_at"))
    return H.upsert_feedback(old, new)


@query
def cascade_delete(spark, sf):
    """Messages left once the sessions with a system message are deleted."""
    m = messages(spark, sf)
    return H.delete_cascade(m.where("role = 'system'"), "session_id", m)[0].select("session_id", "seq", "role")


@query
def history_export(spark, sf):
    return H.export_markdown(messages(spark, sf))


# ------------------------------------------------------------------ study
@query
def topics(spark, sf):
    return S.topics(chunks_of(units(spark, sf)))


@query
def page_topics(spark, sf):
    """Web pages by their first heading."""
    rows = L.html_lines(load(spark, sf, "pages")).groupBy("page_id", "section").agg(F.sum(X.word_count(F.col("text"))).alias("words"))
    return rows.select("page_id", X.topic_name(F.col("section")).alias("topic"), "words")


@query
def key_terms(spark, sf):
    return S.key_terms(units(spark, sf))


@query
def salient_facts(spark, sf):
    return S.salient_facts(units(spark, sf), "doc_id")


@query
def distractors(spark, sf):
    docs = units(spark, sf)
    return S.distractors(S.salient_facts(docs, "doc_id"), S.fact_pool(docs))


@query
def cloze(spark, sf):
    docs = units(spark, sf)
    made = S.cloze(S.salient_facts(docs, "doc_id"), S.fact_pool(docs), "doc_id")
    return made.where(S.well_formed(F.col("question"), F.col("options"), F.col("correct_index"))).withColumn("options", F.array_join("options", " | "))


@query
def short_answers(spark, sf):
    return S.short_answers(units(spark, sf), "doc_id")


@query
def flashcards(spark, sf):
    return S.flashcards(units(spark, sf), "doc_id")


@query
def representative_chunks(spark, sf):
    return S.representative(chunks_of(units(spark, sf))).select("doc_id", "chunk_id", "at")


@query
def suggestions(spark, sf):
    return S.suggestions(S.topics(chunks_of(units(spark, sf))))


# ------------------------------------------------------------------ evaluation
def _cases(spark, sf):
    """Cases made of document-level retrieval: the top sources of each question against its gold phrase."""
    g = gold(spark, sf).withColumnRenamed("item_id", "query_id")
    found = _sources(spark, sf)
    s = found.join(g, "query_id")
    hit = X.contains_phrase(F.col("text"), F.col("phrase"))
    known = E.gold_in_corpus(g.withColumnRenamed("query_id", "item_id"), units(spark, sf))
    per = s.select("query_id", "position", "score", hit.alias("hit")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", "hit"))).alias("r"), F.max("score").alias("best_score"))
    gate = A.refusal(questions(spark, sf), found).select("query_id", "refused", F.col("weak_evidence").alias("flagged"))
    rows = known.withColumnRenamed("item_id", "query_id").join(per, "query_id", "left").join(gate, "query_id")
    relevance = F.coalesce(F.transform("r", lambda x: x["hit"]), F.array().cast("array<boolean>"))
    return rows.select("query_id", F.when(F.col("n_units") > 0, "in_corpus").otherwise(E.OUT).alias("category"), relevance.alias("relevance"), F.coalesce("best_score", F.lit(0.0)).alias("best_score"), "refused", "flagged")


@query
def gold_validation(spark, sf):
    return E.gold_in_corpus(gold(spark, sf), units(spark, sf))


@query
def eval_cases(spark, sf):
    return _cases(spark, sf).withColumn("relevance", F.array_join(F.transform("relevance", lambda r: r.cast("string")), ","))


@query
def ranking_metrics(spark, sf):
    return E.ranking_metrics(_cases(spark, sf))


@query
def answer_metrics(spark, sf):
    """Answer metrics of cases made of the labels."""
    d = F.col("doc_id")
    cases = load(spark, sf, "labels").select(F.when(d % 5 == 0, E.OUT).otherwise("in_corpus").alias("category"), (F.col("quality") == 1).alias("answer_hit"), (F.col("toxic") == 0).alias("citation_correct"), (d % 10 / 10.0).alias("groundedness"), (d % 7 == 0).alias("refused"))
    return E.answer_metrics(cases)


@query
def refusal_metrics(spark, sf):
    return E.refusal_metrics(_cases(spark, sf))


@query
def latency_metrics(spark, sf):
    """Percentiles of a column of counts: characters of messages."""
    return E.latency_metrics(messages(spark, sf).select(F.length("content").alias("latency_ms")))


@query
def threshold_calibration(spark, sf):
    return E.calibration(_cases(spark, sf))


@query
def ask_metrics(spark, sf):
    """Ranking metrics of the whole plan over chunks."""
    g = gold(spark, sf).withColumnRenamed("item_id", "query_id")
    return E.ranking_metrics(evaluate(questions(spark, sf), units(spark, sf), g))


# ------------------------------------------------------------------ streams
@query
def event_windows(spark, sf):
    return windowed_counts(load(spark, sf, "events"))


ORACLE_SQL: dict[str, str] = {k: v for k, v in oracle.SQL.items() if k in QUERIES}
FLAGSHIP = QUERIES["ask_batch"]
