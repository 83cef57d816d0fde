"""Topics, key terms and study questions whose answers are checked against the text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeframe.functions import constants as K
from citeframe.functions.sentences import split_sentences
from citeframe.functions.text import locator, page_range, tokens, topic_name, without, word_count
from citeframe.session import stored

from .verify import bound_in, window_in

BLANK = "______"


def topics(chunks: DataFrame, thin: int = 40, least: int = 12) -> DataFrame:
    """doc_id, topic_no, name, page_start, page_end, n_chunks, word_count, label.

    Chunks are grouped by section ("Introduction" where a chunk has none, or ``Pages N`` where its whole document has none). In order of page and name, topics of fewer than ``thin`` words join the one before; a topic starts an island if it is the first or has ``thin`` words, so this is a running sum. Topics of fewer than ``least`` words go.
    """
    sectioned = F.max((F.col("section") != "").cast("int")).over(Window.partitionBy("doc_id"))
    rows = chunks.select("doc_id", "page_no", "line_start", "section", word_count(F.col("text")).alias("words"), sectioned.alias("sectioned"))
    key = F.when(F.col("sectioned") == 0, F.concat(F.lit("Pages "), "page_no")).when(F.col("section") == "", F.lit("Introduction")).otherwise(topic_name(F.col("section")))
    groups = rows.withColumn("name", key).groupBy("doc_id", "name").agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"), F.count("*").alias("n_chunks"), F.sum("words").alias("word_count"))
    order = Window.partitionBy("doc_id").orderBy("page_start", "name")
    groups = groups.withColumn("rn", F.row_number().over(order)).withColumn("island", F.sum(((F.col("rn") == 1) | (F.col("word_count") >= thin)).cast("int")).over(order))
    merged = groups.groupBy("doc_id", "island").agg(F.min_by("name", "rn").alias("name"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.sum("n_chunks").alias("n_chunks"), F.sum("word_count").alias("word_count")).where(F.col("word_count") >= least)
    merged = merged.withColumn("topic_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("island")))
    return merged.select("doc_id", "topic_no", "name", "page_start", "page_end", "n_chunks", "word_count", page_range(F.col("page_start"), F.col("page_end")).alias("label"))


def key_terms(units: DataFrame, key: str = "doc_id", limit: int = 8) -> DataFrame:
    """key, rank, term, score: frequent, long, non-generic words; ties by first occurrence."""
    rows = units.select(key, F.posexplode(without(tokens(F.col("text")), K.TOPIC_STOP + K.TOPIC_GENERIC, 3)).alias("pos", "term"))
    scored = rows.groupBy(key, "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    scored = scored.withColumn("score", F.round(F.col("n") * (1 + F.log(F.length("term"))), 6))
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "first")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(key, "rank", "term", "score")


def salient(sentence: Column) -> Column:
    """The first fact worth asking for: struct(kind, answer), null if there is none. A pattern is tried only where a sentence has what all its matches have (``K.FACT_SIGNS``)."""
    cases, low = [], F.lower(sentence)
    for kind, pattern in K.FACTS:
        value = F.trim(F.regexp_extract(sentence, pattern, 0))
        signs = [F.contains(low, F.lit(x)) for x in K.FACT_SIGNS[kind]]
        may = reduce(lambda a, b: a | b, signs) if signs else sentence.rlike("[0-9]")
        cases.append(F.when(may & (F.length(value) >= 2), F.struct(F.lit(kind).alias("kind"), value.alias("answer"))))
    return F.coalesce(*cases)


def sentences_of(units: DataFrame, *keys: str) -> DataFrame:
    return units.select(*keys, F.posexplode(split_sentences(F.col("text"))).alias("sentence_no", "sentence"))


def salient_facts(units: DataFrame, *keys: str) -> DataFrame:
    """keys, sentence_no, sentence, kind, answer for the sentences of eight words or more that have a fact."""
    rows = sentences_of(units, *keys).where(word_count(F.col("sentence")) >= 8)
    return rows.withColumn("f", salient(F.col("sentence"))).where("f is not null").select(*keys, "sentence_no", "sentence", "f.kind", "f.answer")


def fact_pool(units: DataFrame, order: str = "doc_id") -> DataFrame:
    """kind, value, at: distinct facts of every kind, with the place of the first."""
    found = reduce(DataFrame.unionByName, [units.select(F.lit(kind).alias("kind"), F.col(order).alias("unit"), F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("pos", "value")) for kind, pattern in K.FACTS])
    rows = found.withColumn("value", F.trim("value")).withColumn("folded", F.lower("value"))
    return rows.groupBy("kind", "folded").agg(F.min_by("value", F.struct("unit", "pos")).alias("value"), F.min(F.struct("unit", "pos")).alias("at")).drop("folded")


def distractors(answers: DataFrame, pool: DataFrame, wanted: int = 3) -> DataFrame:
    """kind, answer, rank, value: for each distinct answer the ``wanted`` other facts of its kind that are nearest in length, then first in the corpus.

    The pool is first reduced to the ``wanted`` + 1 earliest facts of each kind and length, which is all that any answer can take, so an answer meets a few rows whatever the size of the pool.
    """
    size = F.length("value")
    early = pool.withColumn("n", F.row_number().over(Window.partitionBy("kind", size).orderBy("at", "value"))).where(F.col("n") <= wanted + 1)
    asked = answers.select("kind", "answer").distinct()
    met = asked.join(early, "kind").where(F.lower("answer") != F.lower("value"))
    order = Window.partitionBy("kind", "answer").orderBy(F.abs(size - F.length("answer")), "at", "value")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted).select("kind", "answer", "rank", "value")


def cloze(facts: DataFrame, pool: DataFrame, *keys: str, seed: int = 7) -> DataFrame:
    """Fill-in questions: stem, options (in an order fixed by ``seed``), correct_index, difficulty; facts without three distractors give none."""
    few = distractors(facts, pool).groupBy("kind", "answer").agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("d")).where(F.size("d") == 3)
    rows = facts.join(few, ["kind", "answer"])
    at = F.instr("sentence", F.col("answer"))
    stem = F.concat(F.col("sentence").substr(F.lit(1), at - 1), F.lit(BLANK), F.col("sentence").substr(at + F.length("answer"), F.length("sentence")))
    options = F.concat(F.array("answer"), F.transform("d", lambda x: x["value"]))
    shuffled = F.transform(F.sort_array(F.transform(options, lambda o: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), "sentence", o)).alias("h"), o.alias("o")))), lambda x: x["o"])
    rows = rows.withColumn("options", shuffled)
    return rows.select(*keys, "sentence_no", "kind", F.concat(F.lit("Fill in the blank: "), stem).alias("question"), "answer", "options", (F.array_position("options", F.col("answer")) - 1).cast("int").alias("correct_index"), F.when(F.col("kind").isin("money", "percent"), "easy").otherwise("medium").alias("difficulty"))


def well_formed(question: Column, options: Column, correct: Column) -> Column:
    """Not blank, three options or more that differ, a valid index."""
    folded = F.transform(options, lambda o: F.lower(F.trim(o)))
    return (F.trim(question) != "") & (F.size(options) >= 3) & (F.size(F.array_distinct(folded)) == F.size(options)) & correct.between(0, F.size(options) - 1)


def short_answers(units: DataFrame, *keys: str, most: int = 3) -> DataFrame:
    """Questions from defining sentences of eight words or more, ``most`` for each unit."""
    rows = sentences_of(units, *keys).where(word_count(F.col("sentence")) >= 8)
    question = F.lit(None).cast("string")
    for pattern, form in reversed(K.DEFINITIONS):
        before, after = form.split("{}")
        subject = F.regexp_replace(F.trim(F.regexp_extract("sentence", pattern, 1)), ",+$", "")
        question = F.when(F.col("sentence").rlike(pattern), F.concat(F.lit(before), subject, F.lit(after))).otherwise(question)
    rows = rows.withColumn("question", question).where("question is not null")
    order = Window.partitionBy(*keys).orderBy("sentence_no")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select(*keys, "sentence_no", "question", F.col("sentence").alias("answer"), F.lit(2).alias("marks"))


def flashcards(units: DataFrame, *keys: str) -> DataFrame:
    """A card of key terms for each unit, and up to two from its defining sentences."""
    key = keys[0]
    terms = key_terms(units, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("t"))
    cards = terms.select(key, F.lit(0).alias("card_no"), F.lit("Key terms").alias("front"), F.array_join(F.transform("t", lambda x: x["term"]), ", ").alias("back"))
    own = short_answers(units, key, most=2).select(key, F.row_number().over(Window.partitionBy(key).orderBy("sentence_no")).alias("card_no"), F.col("question").alias("front"), F.col("answer").alias("back"))
    return cards.unionByName(own)


def locate(claims: DataFrame, chunks: DataFrame, lines: DataFrame, *keys: str) -> DataFrame:
    """keys, chunk_id, doc_id, page_no, first_line, last_line, score, locator: where each claim (keys, claim, and chunk_id for each chunk that may hold it) is best supported; of equal scores the smallest chunk id.

    Each claim's most promising chunk is searched first; of the others only those whose terms and numbers could score as high, since a window cannot score above its chunk's bound.
    """
    places = chunks.select("chunk_id", "doc_id", "page_no", "line_start", "line_end").join(claims.select("chunk_id").distinct(), "chunk_id", "left_semi")
    met = places.join(lines, ["doc_id", "page_no"]).where(F.col("line_no").between(F.col("line_start"), F.col("line_end")))
    held = stored(met.groupBy("chunk_id", "doc_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("held")))  # a page at most
    texts = F.transform("held", lambda r: r["text"])
    rows = claims.select(*keys, "claim", "chunk_id").join(held, "chunk_id").withColumn("bound", bound_in("claim", texts))
    order = Window.partitionBy(*keys).orderBy(F.col("bound").desc(), "chunk_id")
    bounds = stored(rows.select(*keys, "claim", "chunk_id", "bound").withColumn("n", F.row_number().over(order)))
    number = lambda i: F.get("held", i)["line_no"]

    def searched(pairs: DataFrame) -> DataFrame:
        found = pairs.select(*keys, "claim", "chunk_id").join(held, "chunk_id").withColumn("w", window_in("claim", texts))
        return found.select(*keys, "chunk_id", "doc_id", "page_no", number(F.col("w.first")).alias("first_line"), number(F.col("w.last")).alias("last_line"), F.col("w.score").alias("score"))

    first = stored(searched(bounds.where("n = 1")))
    reached = first.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("score").alias("reached"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    rest = bounds.where("n > 1").join(reached, same).where(F.col("bound") >= F.col("reached") - 1e-4)
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "chunk_id")
    best = first.unionByName(searched(rest)).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    return best.withColumn("locator", locator(F.col("page_no"), F.col("first_line"), F.col("last_line")))


def quota(found: DataFrame, topics_of: DataFrame, count: int, *keys: str) -> DataFrame:
    """``count`` rows in all, spread over topics (topic, word_count): the same share for each, richest topics first."""
    n = topics_of.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    per = Window.partitionBy("topic").orderBy(*keys)
    rows = found.withColumn("in_topic", F.row_number().over(per)).where(F.col("in_topic") <= F.ceil(F.lit(count) / n))
    return rows.join(topics_of.select("topic", "word_count"), "topic").orderBy(F.col("word_count").desc(), "topic", "in_topic").limit(count)


def representative(chunks: DataFrame, budget: int = 14) -> DataFrame:
    """At most ``budget`` chunks of each document: all if they fit, else the first of each section, topped up by an even stride, in document order."""
    order = Window.partitionBy("doc_id").orderBy("page_no", "line_start", "line_end")
    rows = chunks.withColumn("at", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    rows = rows.withColumn("head", F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("at")) == 1)
    stride = F.greatest(F.floor(F.col("n") / budget), F.lit(1))
    rows = rows.withColumn("prio", F.when(F.col("head"), 0).when((F.col("at") - 1) % stride == 0, 1).otherwise(2)).where((F.col("n") <= budget) | (F.col("prio") < 2))
    rows = rows.withColumn("pick", F.row_number().over(Window.partitionBy("doc_id").orderBy("prio", "at"))).where((F.col("n") <= budget) | (F.col("pick") <= budget))
    return rows.drop("n", "head", "prio", "pick")


def suggestions(found: DataFrame, limit: int = 5) -> DataFrame:
    """doc_id, n, prompt: questions that a document's topics can answer."""
    first = found.select("doc_id").distinct().select("doc_id", F.lit(0).alias("n"), F.concat(F.lit("Summarise document "), "doc_id").alias("prompt"))
    named = found.where(F.length("name") >= 4)
    rest = named.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("topic_no")).alias("n"), F.concat(F.lit("What does the section on "), F.regexp_replace("name", r"\.+$", ""), F.lit(" say?")).alias("prompt"))
    return first.unionByName(rest.where(F.col("n") < limit))
