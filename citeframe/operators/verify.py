"""Verification of cited sentences against the lines of their sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeframe.functions import constants as K
from citeframe.functions.fuzzy import Claim, best_window
from citeframe.functions.sentences import split_sentences
from citeframe.functions.text import attach_trailing_markers, numbers, parse_markers, strip_markers, tokens, without


def content_terms(text: Column) -> Column:
    return without(tokens(text), K.VERIFY_STOP, 1)


def claims(answers: DataFrame) -> DataFrame:
    """query_id, sentence_no, sentence, claim, markers: the sentences of each answer that have two content terms or more besides their markers."""
    rows = answers.select("query_id", F.posexplode(split_sentences(attach_trailing_markers(F.col("answer")))).alias("sentence_no", "sentence"))
    rows = rows.select("*", strip_markers(F.col("sentence")).alias("claim"), parse_markers(F.col("sentence")).alias("markers"))
    return rows.where(F.size(content_terms(F.col("claim"))) >= 2)


def coverage(claim: Column, evidence: Column) -> Column:
    """Share of the claim's distinct content terms in the evidence; longer terms weigh more."""
    weigh = lambda terms: F.aggregate(terms, F.lit(0.0), lambda s, t: s + 1 + F.log1p(F.length(t)))
    asked = F.array_distinct(content_terms(claim))
    return F.when(F.size(asked) > 0, weigh(F.array_intersect(asked, content_terms(evidence))) / weigh(asked)).otherwise(F.lit(0.0))


def number_recall(claim: Column, evidence: Column) -> Column:
    """Share of the claim's numbers in the evidence; null where it has none."""
    asked = numbers(claim)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, numbers(evidence))) / F.size(asked))


@F.pandas_udf(T.DoubleType())
def support_score(claim: pd.Series, evidence: pd.Series) -> pd.Series:
    """Support of claims by evidence, 0 to 1: coverage, fuzzy likeness and number recall."""
    return pd.Series([Claim(c or "").support(e or "") for c, e in zip(claim, evidence, strict=True)], dtype="float64")


@F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
def window_in(claim: pd.Series, lines: pd.Series) -> pd.DataFrame:
    """The run of lines that best supports each claim; places from 0, -1 without lines."""
    return pd.DataFrame([best_window(c or "", [x or "" for x in ls]) for c, ls in zip(claim, lines, strict=True)], columns=["score", "first", "last"])


@F.pandas_udf(T.DoubleType())
def bound_in(claim: pd.Series, lines: pd.Series) -> pd.Series:
    """What the score of ``window_in`` cannot exceed: the bound of all lines together, whose terms and numbers no run of them exceeds."""
    return pd.Series([Claim(c or "").bound(" ".join(x or "" for x in ls)) for c, ls in zip(claim, lines, strict=True)], dtype="float64")


def source_lines(sources: DataFrame, lines: DataFrame) -> DataFrame:
    """query_id, position, lines: the lines of each source, a range join on (doc_id, page_no) with line_no within the source."""
    at = F.col("line_no").between(F.col("line_start"), F.col("line_end"))
    met = sources.select("query_id", "position", "doc_id", "page_no", "line_start", "line_end").join(lines, ["doc_id", "page_no"]).where(at)
    rows = met.groupBy("query_id", "position").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("rows"))  # a page at most
    return rows.select("query_id", "position", F.transform("rows", lambda r: r["text"]).alias("lines"), F.transform("rows", lambda r: r["line_no"]).alias("numbers"))


def verdicts(made: DataFrame, cited: DataFrame, with_lines: DataFrame, grounded: float = K.GROUNDED) -> DataFrame:
    """One row for each claim and source it may rest on, with the source's best window.

    A claim rests on the sources it cites, or on all if none of its markers resolves. ``best`` marks the claim's best row; ``supported`` needs a score of ``grounded`` and a resolved marker. Each citation keeps its own window, so a claim with two markers proves each in its own source.
    """
    have = cited.groupBy("query_id").agg(F.collect_set("position").alias("have"))  # a handful of sources
    rows = made.join(have, "query_id").withColumn("resolved", F.array_intersect("markers", "have"))
    rows = rows.withColumn("position", F.explode(F.when(F.size("resolved") > 0, F.col("resolved")).otherwise(F.col("have"))))
    rows = rows.join(cited.select("query_id", "position", "doc_id", "page_no", "line_start", "quote"), ["query_id", "position"]).join(with_lines, ["query_id", "position"], "left")
    lines = F.when(F.size(F.coalesce("lines", F.array().cast("array<string>"))) > 0, F.col("lines")).otherwise(F.array("quote"))
    rows = rows.withColumn("w", window_in("claim", lines))
    number = lambda i: F.coalesce(F.get("numbers", i), F.col("line_start"))
    rows = rows.select("query_id", "sentence_no", "sentence", "claim", "resolved", "position", "doc_id", "page_no", F.col("w.score").alias("score"), number(F.col("w.first")).alias("first_line"), number(F.col("w.last")).alias("last_line"))
    order = Window.partitionBy("query_id", "sentence_no").orderBy(F.col("score").desc(), "position")
    rows = rows.withColumn("best", F.row_number().over(order) == 1)
    return rows.withColumn("supported", (F.col("score") >= grounded) & (F.size("resolved") > 0))


def narrowed(judged: DataFrame) -> DataFrame:
    """For each citation the strongest window among the claims that cite it."""
    rows = judged.where(F.array_contains("resolved", F.col("position")))
    order = Window.partitionBy("query_id", "position").orderBy(F.col("score").desc(), "sentence_no")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("query_id", "position", "doc_id", "page_no", "first_line", "last_line", "score")


def groundedness(judged: DataFrame) -> DataFrame:
    """query_id, groundedness (scores of the best rows, weighted by content terms), n_claims, n_supported."""
    weight = F.greatest(F.size(content_terms(F.col("sentence"))), F.lit(1))
    return judged.where("best").groupBy("query_id").agg(F.round(F.sum(F.col("score") * weight) / F.sum(weight), 4).alias("groundedness"), F.count("*").alias("n_claims"), F.count_if("supported").alias("n_supported"))


def confidence(refused: Column, weak: Column, grounded: Column) -> Column:
    high, medium = grounded >= 0.75, grounded >= 0.5
    return F.when(refused, "refused").when(high & ~weak, "high").when(medium, "medium").otherwise("low")


def highlights(spans: DataFrame) -> DataFrame:
    """Spans to mark, by document and page."""
    cols = [c for c in spans.columns if c not in ("doc_id", "page_no")]
    return spans.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("spans"))
