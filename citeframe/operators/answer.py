"""Refusal, extractive composition and citations, for many questions at once."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeframe.functions import constants as K
from citeframe.functions.sentences import split_sentences
from citeframe.functions.text import MARKER, body_text, caps_ratio, parse_markers, strip_leading_noise, tokens, without, word_count


def refusal(queries: DataFrame, sources: DataFrame, least: float = K.MIN_SCORE, low: float = K.LOW_SCORE) -> DataFrame:
    """query_id, n_sources, best_score, refused, weak_evidence.

    A question is refused without sources, below ``least``, or where none of its content terms occurs in the top source (sources: query_id, position, section, text, score).
    """
    best = sources.groupBy("query_id").agg(F.count("*").alias("n_sources"), F.max("score").alias("best_score"), F.min_by(F.concat_ws(" ", "section", "text"), "position").alias("top"))
    rows = queries.select("query_id", "question").join(best, "query_id", "left")
    asked = without(tokens(F.col("question")), K.ANSWER_STOP, 2)
    blank = (F.size(asked) > 0) & (F.size(F.array_intersect(asked, tokens(F.coalesce("top", F.lit(""))))) == 0)
    score = F.coalesce("best_score", F.lit(0.0))
    refused = F.col("n_sources").isNull() | (score < least) | blank
    return rows.select("query_id", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), score.alias("best_score"), refused.alias("refused"), (~refused & (score < low)).alias("weak_evidence"))


def sentence_scores(sources: DataFrame) -> DataFrame:
    """query_id, position, sentence_no, sentence, score for the sentences of sources (query_id, question, position, section, text, and expanded: an array of terms from the question's variants, may be null)."""
    asked = F.array_distinct(without(tokens(F.col("question")), K.ANSWER_STOP, 1))
    rows = sources.withColumn("asked", asked).withColumn("wide", F.array_union("asked", F.coalesce("expanded", F.array().cast("array<string>"))))
    rows = rows.select("query_id", "question", "position", "asked", "wide", F.posexplode(split_sentences(body_text(F.col("text"), F.coalesce("section", F.lit(""))))).alias("sentence_no", "sentence"))
    rows = rows.withColumn("terms", F.array_distinct(tokens(F.col("sentence")))).where(F.size("terms") > 0)
    share = lambda s: F.size(F.array_intersect(s, "terms")) / F.greatest(F.size(s), F.lit(1))
    overlap = F.greatest(share("asked"), 0.85 * share("wide"))
    density = F.size(F.array_intersect("wide", "terms")) / F.sqrt(F.size("terms"))
    question, s, probe = F.lower("question"), F.col("sentence"), strip_leading_noise(F.col("sentence"))
    plus = F.when(question.rlike(K.WANTS_VALUE) & s.rlike("[0-9]"), 0.16).otherwise(0.0) + F.when(question.rlike(K.WANTS_PERSON) & s.rlike(K.OBLIGATION), 0.1).otherwise(0.0)
    score = 0.55 * overlap + 0.28 * density + 0.1 / F.col("position") + plus
    for met, factor in (
        (probe.rlike(K.INSTRUCTION), 0.35),
        (probe.rlike(K.INTERROGATIVE) | probe.rlike(r"\?\s*$"), 0.55),
        (probe.rlike(K.ISSUE_MARKER), 0.7),
        (s.rlike(K.EXAM_MARKS), 0.65),
        (caps_ratio(s) > 0.6, 0.7),
        (F.size("terms") < 5, 0.85),
    ):
        score = score * F.when(met, factor).otherwise(1.0)
    rows = rows.withColumn("overlap", overlap).withColumn("score", F.round(score, 6))
    return rows.where((F.col("overlap") > 0) | (F.col("position") == 1)).select("query_id", "position", "sentence_no", "sentence", "score")


def pick_sentences(scored: DataFrame, most: int = 4, share: float = 0.55, prefix: int = 90) -> DataFrame:
    """The best sentences of each question, no two with the same beginning, none below ``share`` of the best; place counts them."""
    order = [F.col("score").desc(), "position", "sentence_no"]
    rows = scored.withColumn("best", F.max("score").over(Window.partitionBy("query_id")))
    rows = rows.where((F.col("score") >= share * F.col("best")) | (F.col("score") == F.col("best")))
    rows = rows.withColumn("same", F.row_number().over(Window.partitionBy("query_id", F.substring(F.lower("sentence"), 1, prefix)).orderBy(*order))).where("same = 1")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= most).drop("best", "same")


def compose(picked: DataFrame) -> DataFrame:
    """query_id, answer, used: each sentence with its marker, and the sources used."""
    part = F.concat(F.regexp_replace("sentence", r"\.+$", ""), F.lit(". [S"), "position", F.lit("]"))
    rows = picked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", part.alias("part"), "position"))).alias("parts"))  # four at most
    return rows.select("query_id", F.array_join(F.transform("parts", lambda p: p["part"]), " ").alias("answer"), F.array_distinct(F.transform("parts", lambda p: p["position"])).alias("used"))


def citations(sources: DataFrame, composed: DataFrame) -> DataFrame:
    """One citation for each source: marker, place, quote, retrieval score, and whether the answer uses it."""
    rows = sources.join(composed.select("query_id", "used"), "query_id", "left")
    used = F.coalesce(F.array_contains("used", F.col("position")), F.lit(False))
    return rows.select("query_id", F.concat(F.lit("S"), "position").alias("marker"), "position", "doc_id", "page_no", "line_start", "line_end", F.col("text").alias("quote"), F.round("score", 5).alias("retrieval_score"), used.alias("used_in_answer"))


def overview(sources: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """query_id, answer: one line for each source (query_id, position, page_no, section, text) with its longest sentence of five words or more, cut at 260 characters."""
    sentences = split_sentences(body_text(F.col("text"), F.coalesce("section", F.lit(""))))
    long = F.transform(F.filter(sentences, lambda s: word_count(s) >= 5), lambda s, i: F.struct(word_count(s).alias("n"), (-i).alias("first"), s.alias("s")))
    best = F.trim(F.substring(F.coalesce(F.array_max(long)["s"], F.trim("text")), 1, 260))
    label = F.when(F.coalesce("section", F.lit("")) != "", F.regexp_replace(F.trim("section"), r"\.+$", "")).otherwise(F.concat(F.lit("page "), "page_no"))
    line = F.concat(F.lit("- "), label, F.lit(": "), F.regexp_replace(best, r"\.+$", ""), F.lit(". [S"), "position", F.lit("]"))
    rows = sources.withColumn("line", line).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", "line"))).alias("lines"))
    return rows.select("query_id", F.size("lines").alias("n_sources"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("answer"))


def sanitize(text: Column, n_sources: Column) -> Column:
    """``text`` with markers written as [S1][S2], those beyond ``n_sources`` dropped, and spaces tidied; a fold over the stretches between markers."""
    stretches = F.split(text, MARKER)
    groups = F.transform(F.regexp_extract_all(text, F.lit(MARKER), 1), lambda g: F.array_join(F.transform(F.filter(F.regexp_extract_all(g, F.lit(r"\d+"), 0), lambda n: n.cast("int").between(1, n_sources)), lambda n: F.concat(F.lit("[S"), n.cast("int"), F.lit("]"))), ""))
    glued = F.array_join(F.zip_with(stretches, groups, lambda s, g: F.concat(F.coalesce(s, F.lit("")), F.coalesce(g, F.lit("")))), "")
    return F.trim(F.regexp_replace(F.regexp_replace(glued, "[ \t]{2,}", " "), r"\s+([.,;:])", "$1"))


def valid_markers(text: Column, n_sources: Column) -> Column:
    return F.filter(parse_markers(text), lambda n: n.between(1, n_sources))


def with_model(rows: DataFrame, complete: Callable[[str, str], str], system: str, prompt: str = "prompt") -> DataFrame:
    """Adds reply: the answer of a language model, called in Arrow batches. ``complete(system, user)`` may raise; such a row's reply is null and its error is kept."""

    def run(prompts: pd.Series) -> pd.DataFrame:
        out = []
        for p in prompts:
            try:
                out.append((complete(system, p), None))
            except Exception as error:  # any client's error becomes the row's
                out.append((None, f"{type(error).__name__}: {error}"))
        return pd.DataFrame(out, columns=["reply", "error"])

    kind = T.StructType([T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])
    return rows.withColumn("_r", F.pandas_udf(run, kind)(prompt)).select("*", "_r.reply", F.col("_r.error").alias("provider_error")).drop("_r")


def prompts(queries: DataFrame, sources: DataFrame, history: DataFrame | None = None, limit: int = 1200) -> DataFrame:
    """query_id, prompt: the question after its sources, each cut at ``limit`` characters, and up to three earlier turns (query_id, n, user, reply)."""
    block = F.concat(F.lit("[S"), "position", F.lit("] "), F.substring("text", 1, limit))
    text = sources.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", block.alias("block")))).alias("b")).select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("sources"))
    rows = queries.select("query_id", "question").join(text, "query_id", "left")
    earlier = F.lit(None).cast("string")
    if history is not None:
        turn = F.concat(F.lit("User: "), F.substring("user", 1, 300), F.lit("\nAssistant: "), F.substring("reply", 1, 300))
        past = history.where("n <= 3").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), turn.alias("t")))).alias("h"))
        rows = rows.join(past.select("query_id", F.array_join(F.transform("h", lambda x: x["t"]), "\n").alias("earlier")), "query_id", "left")
        earlier = F.col("earlier")
    return rows.select("query_id", F.concat_ws("\n\n", earlier, F.concat(F.lit("Sources:\n"), "sources"), F.concat(F.lit("Question: "), "question")).alias("prompt"))


def finish_model_answer(rows: DataFrame, extractive: DataFrame, refusal_token: str = "NOT_FOUND") -> DataFrame:
    """query_id, answer, refused, provider_error from replies (query_id, reply, provider_error, n_sources): sanitised, with [S1] if nothing is cited; a reply that failed or is empty gives the extractive answer."""
    joined = rows.join(extractive.select("query_id", F.col("answer").alias("extract")), "query_id", "left")
    clean = sanitize(F.coalesce("reply", F.lit("")), F.col("n_sources"))
    cited = F.when(F.size(valid_markers(clean, F.col("n_sources"))) > 0, clean).otherwise(F.concat(clean, F.lit(" [S1]")))
    refused = F.contains(F.coalesce("reply", F.lit("")), F.lit(refusal_token))
    answer = F.when(refused, F.lit(K.REFUSAL)).when(F.coalesce(clean, F.lit("")) == "", F.col("extract")).otherwise(cited)
    return joined.select("query_id", answer.alias("answer"), refused.alias("refused"), "provider_error")


