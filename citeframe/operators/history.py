"""Conversation history: sessions, messages, their evidence and feedback as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import bm25_top_k

DEFAULT_TITLE = "New conversation"


def messages_of(conversations: DataFrame) -> DataFrame:
    """session_id, seq, role, content from turns (conv_id, turn, role, text)."""
    return conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def sessions(messages: DataFrame, title_chars: int = 60) -> DataFrame:
    """session_id, title (the first user message, cut), n_messages, last_seq."""
    first = F.min_by("content", F.when(F.col("role") == "user", F.col("seq")))
    title = F.regexp_replace(F.trim(F.coalesce("first", F.lit(""))), r"\s+", " ")
    short = F.when(title == "", F.lit(DEFAULT_TITLE)).when(F.length(title) > title_chars, F.concat(F.rtrim(F.substring(title, 1, title_chars)), F.lit("…"))).otherwise(title)
    rows = messages.groupBy("session_id").agg(first.alias("first"), F.count("*").alias("n_messages"), F.max("seq").alias("last_seq"))
    return rows.select("session_id", short.alias("title"), "n_messages", "last_seq")


def with_empty(known: DataFrame, messages: DataFrame) -> DataFrame:
    """All ``known`` sessions (session_id and others) with n_messages and last_seq, 0 for those without messages."""
    counts = messages.groupBy("session_id").agg(F.count("*").alias("n_messages"), F.max("seq").alias("last_seq"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return known.join(counts, "session_id", "left").select(*known.columns, zero("n_messages"), zero("last_seq"))


def recent_sessions(found: DataFrame, limit: int = 50) -> DataFrame:
    """The sessions touched last."""
    return found.orderBy(F.col("last_seq").desc(), "session_id").limit(limit)


def pairs(messages: DataFrame, last: int | None = None) -> DataFrame:
    """session_id, seq, user, reply: user messages directly followed by another role's; ``last`` keeps the latest of each session, n counts from the latest."""
    order = Window.partitionBy("session_id").orderBy("seq")
    rows = messages.select("session_id", "seq", "role", F.col("content").alias("reply"), F.lag("role").over(order).alias("before"), F.lag("content").over(order).alias("user"))
    rows = rows.where("role <> 'user' and before = 'user'")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("seq").desc())))
    rows = rows if last is None else rows.where(F.col("n") <= last)
    return rows.select("session_id", "seq", "user", "reply", "n")


def stats(messages: DataFrame) -> DataFrame:
    """One row of counts."""
    return messages.agg(
        F.countDistinct("session_id").alias("sessions"),
        F.count("*").alias("messages"),
        F.count_if(F.col("role") == "user").alias("questions"),
        F.count_if(F.col("role") == "assistant").alias("answers"),
        F.count_if(F.col("role") == "system").alias("system_messages"),
        F.round(F.avg(F.when(F.col("role") == "assistant", F.length("content"))), 4).alias("mean_answer_chars"),
    )


def search(messages: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Ranked messages for queries (query_id, text); exact tokens, no stemming."""
    units = messages.select(F.concat_ws("/", "session_id", "seq").alias("message_id"), F.col("content").alias("text"))
    return bm25_top_k(queries, units, k, key="message_id")


def contains(messages: DataFrame, term: str) -> DataFrame:
    """Messages that contain ``term``, the latest first."""
    return messages.where(F.contains(F.lower("content"), F.lower(F.lit(term)))).orderBy(F.col("seq").desc(), "session_id")


def upsert_feedback(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest rating of each message (message_id, rating, note, created_at); of equal times the new one."""
    rows = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    order = Window.partitionBy("message_id").orderBy(F.col("created_at").desc(), F.col("age").desc(), "rating", "note")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "age")


def delete_cascade(gone: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    """``tables`` without the rows whose ``key`` is in ``gone``."""
    return [t.join(gone.select(key).distinct(), key, "left_anti") for t in tables]


def with_paths(cited: DataFrame, registry: DataFrame, folder: str) -> DataFrame:
    """``cited`` with the path of its document: that of ``registry`` (doc_id, path), else a file named by the id in ``folder``."""
    paths = registry.groupBy("doc_id").agg(F.min("path").alias("path"))
    return cited.join(paths, "doc_id", "left").withColumn("path", F.coalesce("path", F.concat(F.lit(folder.rstrip("/") + "/"), F.col("doc_id").cast("string"))))


def with_evidence(messages: DataFrame, cited: DataFrame, judged: DataFrame) -> DataFrame:
    """Messages (message_id) with their citations and verdicts as arrays."""
    c = cited.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct(*[x for x in cited.columns if x != "message_id"]))).alias("citations"))
    v = judged.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct(*[x for x in judged.columns if x != "message_id"]))).alias("verdicts"))
    return messages.join(c, "message_id", "left").join(v, "message_id", "left")


def export_markdown(messages: DataFrame) -> DataFrame:
    """session_id, markdown: a transcript of each session. A session is one document, so its messages meet in one row."""
    line = F.concat(F.lit("**"), F.initcap("role"), F.lit(":** "), "content")
    rows = messages.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))).alias("rows"))
    return rows.select("session_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n\n").alias("markdown"))


def export_json(messages: DataFrame) -> DataFrame:
    rows = messages.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("seq", "role", "content"))).alias("messages"))
    return rows.select("session_id", F.to_json(F.struct("session_id", "messages")).alias("json"))
