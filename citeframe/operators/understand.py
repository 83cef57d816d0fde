"""Query understanding: variants, spelling repair and routing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeframe.functions import constants as K
from citeframe.functions.fuzzy import ratio
from citeframe.functions.text import normalise_query, tokens, without


def keyword_form(text: Column) -> Column:
    return F.array_join(F.array_distinct(without(tokens(text), K.QUERY_STOP + K.QUESTION_WORDS, 1)), " ")


def declarative_form(text: Column) -> Column:
    low = F.lower(normalise_query(text))
    out = F.lit("")
    for pattern, to in reversed(K.DECLARATIVE):
        before, after = to.split("{}")
        out = F.when(low.rlike(pattern), F.trim(F.concat(F.lit(before), F.regexp_extract(low, pattern, 1), F.lit(after)))).otherwise(out)
    return out


def synonym_form(text: Column) -> Column:
    """The question followed by the synonyms of its words; empty without any."""
    table = F.create_map(*(x for k, v in K.SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    found = F.array_distinct(F.flatten(F.transform(tokens(text), lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>")))))
    return F.when(F.size(found) > 0, F.concat_ws(" ", normalise_query(text), F.array_join(found, " "))).otherwise(F.lit(""))


def variants(queries: DataFrame, repaired: DataFrame | None = None, most: int = K.MAX_VARIANTS) -> DataFrame:
    """query_id, variant_no, text: the question, its repaired spelling (query_id, spelling) if given, key words, declarative and synonym forms; distinct, without empty ones."""
    rows = queries if repaired is None else queries.join(repaired.select("query_id", "spelling"), "query_id", "left")
    spelling = F.lit("") if repaired is None else F.coalesce("spelling", F.lit(""))
    base = normalise_query(F.col("text"))
    forms = F.array(base, spelling, keyword_form(base), declarative_form(base), synonym_form(base))
    kept = F.slice(F.array_distinct(F.filter(forms, lambda x: x != "")), 1, most)
    return rows.select("query_id", F.posexplode(F.when(base != "", kept)).alias("at", "text")).select("query_id", (F.col("at") + 1).alias("variant_no"), "text")


def vocabulary(units: DataFrame, least: int = 4) -> DataFrame:
    """The distinct terms of ``least`` characters or more."""
    found = F.filter(F.array_distinct(tokens(F.col("text"))), lambda t: F.length(t) >= least)
    return units.select(F.explode(found).alias("word")).distinct()


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def repair_spelling(queries: DataFrame, vocab: DataFrame, cutoff: float = 82.0) -> DataFrame:
    """query_id, spelling: the question with each unknown word of four letters or more replaced by the most similar known word, where one is similar enough.

    A common subsequence covers each letter of the shorter word at most, so only words of near length can reach ``cutoff``. At 82 the letters outside the subsequence are fewer than the steps inside it, so some two letters are adjacent in both words: words are joined on adjacent pairs.
    """
    words = queries.select("query_id", F.posexplode(tokens(F.col("text"))).alias("at", "word"))
    plain = F.col("word").isin(K.QUERY_STOP + K.QUESTION_WORDS) | (F.length("word") < 4)
    unknown = words.where(~plain).select("word").distinct().join(vocab, "word", "left_anti")
    size = F.length("word")
    grams = F.array_distinct(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))"))
    left = unknown.select("word", size.alias("n"), F.explode(grams).alias("gram"))
    right = vocab.where(size >= 2).select(F.col("word").alias("known"), size.alias("m"), F.explode(grams).alias("gram"))
    near = left.join(right, "gram").where(200.0 * F.least("n", "m") / (F.col("n") + F.col("m")) >= cutoff).select("word", "known").distinct()
    scored = near.withColumn("score", _ratio("word", "known")).where(F.col("score") >= cutoff)
    order = Window.partitionBy("word").orderBy(F.col("score").desc(), "known")
    best = scored.withColumn("n", F.row_number().over(order)).where("n = 1").select("word", "known")
    fixed = words.join(best, "word", "left").groupBy("query_id").agg(F.count("known").alias("changes"), F.sort_array(F.collect_list(F.struct("at", F.coalesce("known", "word").alias("word")))).alias("all"))
    return fixed.select("query_id", F.when(F.col("changes") > 0, F.array_join(F.transform("all", lambda x: x["word"]), " ")).otherwise(F.lit("")).alias("spelling"))


def _near_any(words: list[str], known: list[str], cutoff: float) -> bool:
    return any(len(w) >= 4 and (w in known or any(ratio(w, k) >= cutoff for k in known)) for w in words)


@F.pandas_udf(T.StringType())
def _fuzzy_flags(texts: pd.Series) -> pd.Series:
    """Three digits: a summary word, an expository verb, a word for the document, each allowing for typing errors; then the number of subject words."""
    vocabulary = frozenset(K.INTENT_WORDS)

    def flags(text: str) -> str:
        words = (text or "").split()
        subject = [w for w in words if w not in vocabulary and not (len(w) >= 4 and any(ratio(w, k) >= 80 for k in vocabulary))]
        return "".join("01"[_near_any(words, known, 82)] for known in (K.SUMMARY_WORDS, K.VERB_WORDS, K.DOCUMENT_WORDS)) + f":{len(subject)}"

    return texts.map(flags)


def route(queries: DataFrame) -> DataFrame:
    """Adds intent: lookup, summary (of a whole document) or topics (its sections)."""
    text = F.trim(F.coalesce("text", F.lit("")))
    words = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s;]", " "), r"\s+", " "))
    flags = _fuzzy_flags(words)
    rows = queries.withColumn("_flags", flags)
    flag = lambda i: F.substring("_flags", i, 1) == "1"
    subject = F.split("_flags", ":").getItem(1) != "0"
    verb = text.rlike("(?i)" + K.EXPOSITORY) | flag(2)
    whole = text.rlike("(?i)" + K.WHOLE_DOCUMENT) | flag(3) | text.rlike("(?i)" + K.POINTER)
    bare = words.rlike(r"^(?:this|these|the|that)?\s*(?:whole|entire|full)?\s*(?:doc|document|pdf|file|paper|notes?|it|this)$")
    intent = F.when(text == "", "lookup").when(text.rlike("(?i)" + K.TOPICS_ASKED), "topics").when(text.rlike("(?i)" + K.SUMMARY_ASKED) | flag(1) | bare | (verb & whole & ~subject), "summary").otherwise("lookup")
    return rows.withColumn("intent", intent).drop("_flags")


def topic_of_interest(text: Column) -> Column:
    """What a summary question asks about besides the document; empty if nothing of three characters remains."""
    filler = r"(?i)\b(this|that|these|the|a|an|of|for|in|about|me|please|document|pdf|file|paper|notes?|deed|judgment|judgement|case|material|it|whole|entire|and|to|on|contents?)\b"
    rest = F.coalesce(text, F.lit(""))
    for pattern in ("(?i)" + K.SUMMARY_ASKED, "(?i)" + K.EXPOSITORY, filler, r"(?U)[^\w\s.-]"):
        rest = F.regexp_replace(rest, pattern, " ")
    rest = F.trim(F.regexp_replace(rest, r"\s+", " "))
    return F.when(F.length(rest) >= 3, rest).otherwise(F.lit(""))
