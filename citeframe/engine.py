"""A store of documents, their indexes and conversations in one folder, and the questions it can be asked."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeframe.functions import constants as K
from citeframe.functions.text import stable_id
from citeframe.operators import answer as A
from citeframe.operators import history as H
from citeframe.operators import study as S
from citeframe.operators import understand as U
from citeframe.operators.chunking import chunks_of
from citeframe.operators.index import hash_idf, hashed, sized_postings, unit_vectors
from citeframe.plans.ask import Asked, Index, Parts, ask, chunk_units
from citeframe.session import stored, workers_find_package
from citeframe.sources.lines import line_array, lines_of

SCHEMAS = {
    "registry": "doc_id string, name string, sha256 string, n_pages int, n_lines int, ingested_at timestamp",
    "lines": "doc_id string, page_no int, line_no int, text string",
    "chunks": "chunk_id string, doc_id string, page_no int, line_start int, line_end int, section string, text string, locator string",
    "sessions": "session_id string, title string, created_at timestamp, deleted boolean",
    "messages": "message_id string, session_id string, seq bigint, role string, content string, created_at timestamp, refused boolean, groundedness double, confidence string",
    "citations": "message_id string, marker string, doc_id string, page_no int, line_start int, line_end int, quote string, used_in_answer boolean",
    "verdicts": "message_id string, sentence string, score double, supported boolean, doc_id string, page_no int, first_line int, last_line int",
    "feedback": "message_id string, rating int, note string, created_at timestamp",
}


#: Questions that ``Engine.explain`` asks, by level.
EXPLAIN = {"beginner": "Explain {} in simple words", "exam": "Explain {} as needed for an exam"}


class Engine:
    """``home``: a folder that driver and executors share. Tables are appended to; the index is written anew under a fresh name by ``refresh`` and replaces the old one only when it is complete."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")
        workers_find_package(spark)
        for name, schema in SCHEMAS.items():
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.home}/{name}")
        spark.createDataFrame([], "name string, at timestamp").write.mode("ignore").parquet(f"{self.home}/current")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.home}/{name}")

    def _append(self, name: str, rows: DataFrame) -> None:
        kinds = self.spark.createDataFrame([], SCHEMAS[name]).schema
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds)).write.mode("append").parquet(f"{self.home}/{name}")

    def _replace(self, name: str, rows: DataFrame) -> None:
        """Overwrites a table with rows made from it."""
        stored(rows.select(*self.table(name).columns)).write.mode("overwrite").parquet(f"{self.home}/{name}")

    # ------------------------------------------------------------ documents
    def ingest(self, files: DataFrame) -> DataFrame:
        """Adds documents (name, text; an ``error`` column may be there) and returns one report row for each: name, doc_id, n_lines, skipped, error. A content that is already there, or comes twice, is skipped whatever its name; a document without text is an error, not a failure."""
        error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
        rows = files.select("name", F.coalesce("text", F.lit("")).alias("text"), error.alias("error")).withColumn("sha256", F.sha2("text", 256))
        rows = rows.withColumn("doc_id", stable_id(F.col("name"), F.col("sha256"))).withColumn("n_lines", F.size(line_array(F.col("text"))))
        rows = rows.withColumn("error", F.coalesce("error", F.when(F.col("n_lines") == 0, "no extractable text")))
        known = self.table("registry").select("sha256", F.lit(True).alias("known")).distinct()
        first = rows.where("error is null").groupBy("sha256").agg(F.min("name").alias("first_name"))
        rows = stored(rows.join(known, "sha256", "left").join(first, "sha256", "left").withColumn("skipped", F.coalesce(F.col("known") | (F.col("name") != F.col("first_name")), F.lit(False)) & F.col("error").isNull()))
        fresh = rows.where("error is null and not skipped").dropDuplicates(["sha256"])
        self._append("lines", lines_of(fresh))
        self._append("chunks", chunks_of(fresh))
        self._append("registry", fresh.select("doc_id", "name", "sha256", F.ceil(F.col("n_lines") / K.PAGE_LINES).alias("n_pages"), "n_lines", F.current_timestamp().alias("ingested_at")))
        return rows.select("name", "doc_id", "n_lines", "skipped", "error")

    def refresh(self) -> Index:
        """Writes postings, bucket weights and vectors of all chunks; a deterministic function of the chunks, so deletions count as well."""
        units = chunk_units(self.table("chunks").dropDuplicates(["chunk_id"]))
        name = f"index-{uuid.uuid4().hex}"
        counted = stored(hashed(units, ["chunk_id"]))
        weights = stored(hash_idf(counted, units))
        for part, rows in (("postings", sized_postings(units, "chunk_id")), ("weights", weights), ("vectors", unit_vectors(counted, weights, ["chunk_id"]))):
            rows.write.parquet(f"{self.home}/{name}/{part}")
        self.spark.createDataFrame([(name,)], "name string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.home}/current")
        return self.index()

    def index(self) -> Index:
        latest = self.spark.read.schema("name string, at timestamp").parquet(f"{self.home}/current").orderBy(F.col("at").desc()).first()
        if latest is None:
            return self.refresh()
        found = Index(*(self.spark.read.parquet(f"{self.home}/{latest['name']}/{part}") for part in ("postings", "weights", "vectors")))
        if found.weights.count() != K.HASH_DIM:
            raise ValueError(f"the stored index has not {K.HASH_DIM} dimensions")
        if found.vectors.count() != self.table("chunks").select("chunk_id").distinct().count():
            return self.refresh()  # documents came since
        return found

    def documents(self) -> DataFrame:
        return self.table("registry").orderBy(F.lower("name"), "doc_id")

    def resolve(self, text: str) -> str:
        """The id of the document with this id, or with a name that alone contains ``text``."""
        found = self.table("registry").where((F.col("doc_id") == text) | F.contains(F.lower("name"), F.lit(text.lower()))).limit(3).collect()
        exact = [r for r in found if r.doc_id == text]
        if len(exact or found) != 1:
            raise ValueError(f"{text!r} names {'no' if not found else 'more than one'} document")
        return (exact or found)[0].doc_id

    def delete(self, doc_id: str) -> None:
        for name in ("registry", "lines", "chunks"):
            self._replace(name, self.table(name).where(F.col("doc_id") != doc_id))
        self.refresh()

    def stats(self) -> dict:
        return {name: self.table(name).count() for name in ("registry", "lines", "chunks", "sessions", "messages")} | {"dim": K.HASH_DIM}

    def reset(self) -> None:
        """Empties all tables; the next question meets a new index."""
        for name in SCHEMAS:
            self.spark.createDataFrame([], SCHEMAS[name]).write.mode("overwrite").parquet(f"{self.home}/{name}")
        self.spark.createDataFrame([], "name string, at timestamp").write.mode("overwrite").parquet(f"{self.home}/current")

    def latest_document(self) -> str | None:
        row = self.table("registry").orderBy(F.col("ingested_at").desc(), F.lower("name"), "doc_id").first()
        return row and row.doc_id

    # ------------------------------------------------------------ questions
    def ask(self, questions: DataFrame, session_id: str | None = None, documents: list[str] | None = None, repair: bool = True, final: int = K.TOP_FINAL, parts: Parts | None = None, intent: str | None = None) -> DataFrame:
        """Answers questions (query_id, question): look-ups from retrieved sources, summaries and topic lists from the documents asked about (``documents``, else the latest), unless ``intent`` says how to take them all. Adds intent; with a session the turn is stored."""
        if questions.where("trim(coalesce(question, '')) = ''").limit(1).count():
            raise ValueError("a question is empty")
        routed = stored(U.route(questions.withColumn("text", F.col("question"))).drop("text").withColumn("intent", F.col("intent") if intent is None else F.lit(intent)))
        chunks, lines = self.table("chunks"), self.table("lines")
        allowed = None if documents is None else self.spark.createDataFrame([(d,) for d in documents], "doc_id string")
        lookups = routed.where("intent = 'lookup'")
        spelling = U.repair_spelling(lookups.select("query_id", F.col("question").alias("text")), U.vocabulary(chunk_units(chunks))) if repair else None
        done = ask(lookups, None, final, allowed=allowed, chunks=chunks, lines=lines, index=self.index(), spelling=spelling, parts=parts)
        rows = done.result.withColumn("intent", F.lit("lookup"))
        target = (documents or [self.latest_document()])[0]
        if target is not None:
            own = chunks.where(F.col("doc_id") == target)
            whole = routed.where("intent <> 'lookup'").select("query_id", "intent")
            picked = stored(S.representative(own))
            sources = whole.where("intent = 'summary'").join(F.broadcast(picked.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")))))  # 14 chunks at most
            told = A.overview(sources).select("query_id", "answer", F.lit("summary").alias("intent"))
            line = F.concat(F.lit("- "), "name", F.lit(" ("), "label", F.lit(")"))
            listed = S.topics(own).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("topic_no", line.alias("l")))), lambda x: x["l"]), "\n").alias("answer"))
            named = whole.where("intent = 'topics'").join(F.broadcast(listed)).select("query_id", "answer", "intent")
            both = told.unionByName(named)
            rows = rows.unionByName(both.select("query_id", "answer", F.lit(target).alias("doc_id"), F.lit(None).cast("string").alias("locator"), F.lit(1.0).alias("best_score"), F.lit(1.0).alias("groundedness"), F.lit(0).cast("bigint").alias("n_claims"), F.lit(0).cast("bigint").alias("n_supported"), F.lit(False).alias("refused"), F.lit(False).alias("weak_evidence"), F.lit("high").alias("confidence"), "intent"))
        rows = stored(rows)
        if session_id is not None:
            self._record(session_id, routed, rows, done)
        return rows

    def explain(self, topics: DataFrame, level: str = "beginner", session_id: str | None = None, documents: list[str] | None = None) -> DataFrame:
        """Answers for topics (query_id, topic), told for a beginner or an exam, from at least six sources."""
        if level not in EXPLAIN:
            raise ValueError(f"level is one of {', '.join(EXPLAIN)}")
        before, after = EXPLAIN[level].split("{}")
        asked = topics.select("query_id", F.when(F.trim("topic") != "", F.concat(F.lit(before), F.trim("topic"), F.lit(after))).alias("question"))
        return self.ask(asked, session_id, documents, final=max(K.TOP_FINAL, 6), intent="lookup")

    def study_pack(self, documents: list[str], count: int = 10) -> dict[str, DataFrame]:
        """Topics, fill-in and short-answer questions whose answers the text supports, with the lines that do, flashcards of some documents, and counts of made, kept and rejected questions by kind."""
        chunks = self.table("chunks").where(F.col("doc_id").isin(documents))
        units = chunks.select("chunk_id", "text")
        facts = stored(S.salient_facts(units, "chunk_id"))
        cloze = S.cloze(facts, S.fact_pool(units, "chunk_id"), "chunk_id").join(facts.select("chunk_id", "sentence_no", F.col("sentence").alias("claim")), ["chunk_id", "sentence_no"])
        made = {"mcqs": cloze, "short_answers": S.short_answers(units, "chunk_id").withColumn("claim", F.col("answer"))}
        out, counts = {"topics": S.topics(chunks), "flashcards": S.flashcards(units, "chunk_id")}, None
        key = ["chunk_id", "sentence_no"]
        for kind, rows in made.items():
            fits = S.well_formed(F.col("question"), F.col("options"), F.col("correct_index")) if kind == "mcqs" else F.lit(True)
            places = S.locate(rows.select("*", F.col("chunk_id").alias("own")).select("own", "sentence_no", "claim", "chunk_id"), chunks, self.table("lines"), "own", "sentence_no").drop("chunk_id").withColumnRenamed("own", "chunk_id")
            checked = stored(rows.join(places, key, "left").withColumn("kept", fits & (F.coalesce("score", F.lit(0.0)) >= K.GROUNDED)).drop("claim"))
            out[kind] = checked.where("kept").drop("kept").orderBy(*key).limit(count)
            n = checked.agg(F.lit(kind).alias("kind"), F.count("*").alias("made"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("rejected"))
            counts = n if counts is None else counts.unionByName(n)
        return out | {"stats": counts}

    # ------------------------------------------------------------ conversations
    def open_session(self, title: str = H.DEFAULT_TITLE) -> str:
        session_id = uuid.uuid4().hex[:12]
        self._append("sessions", self.spark.createDataFrame([(session_id, title, False)], "session_id string, title string, deleted boolean").withColumn("created_at", F.current_timestamp()))
        return session_id

    def rename_session(self, session_id: str, title: str) -> None:
        self._replace("sessions", self.table("sessions").withColumn("title", F.when(F.col("session_id") == session_id, F.lit(title)).otherwise(F.col("title"))))

    def delete_session(self, session_id: str) -> None:
        """Deletes a session with its messages and their evidence and feedback."""
        gone = stored(self.table("messages").where(F.col("session_id") == session_id).select("message_id"))
        for name in ("citations", "verdicts", "feedback", "messages"):
            self._replace(name, H.delete_cascade(gone, "message_id", self.table(name))[0])
        self._replace("sessions", self.table("sessions").where(F.col("session_id") != session_id))

    def delete_message(self, message_id: str) -> None:
        """Deletes a message with its evidence and feedback."""
        gone = self.spark.createDataFrame([(message_id,)], "message_id string")
        for name in ("citations", "verdicts", "feedback", "messages"):
            self._replace(name, H.delete_cascade(gone, "message_id", self.table(name))[0])

    def sessions(self, limit: int = 50) -> DataFrame:
        """Sessions with their number of messages, also those without any, the latest touched first."""
        touched = self.table("messages").groupBy("session_id").agg(F.max("created_at").alias("touched"))
        rows = H.with_empty(self.table("sessions").where("not deleted"), self.table("messages")).join(touched, "session_id", "left")
        return rows.withColumn("touched", F.coalesce("touched", "created_at")).orderBy(F.col("touched").desc(), "session_id").limit(limit)

    def messages(self, session_id: str) -> DataFrame:
        """The messages of a session with citations and verdicts, in order."""
        return H.with_evidence(self.table("messages").where(F.col("session_id") == session_id), self.table("citations"), self.table("verdicts")).orderBy("seq")

    def rate(self, message_id: str, rating: int, note: str = "") -> None:
        new = self.spark.createDataFrame([(message_id, rating, note)], "message_id string, rating int, note string").withColumn("created_at", F.current_timestamp())
        self._replace("feedback", H.upsert_feedback(self.table("feedback"), new.select(*self.table("feedback").columns)))

    def search(self, text: str, k: int = 20) -> DataFrame:
        found = H.search(self.table("messages"), self.spark.createDataFrame([(0, text)], "query_id int, text string"), k)
        return found.drop("query_id")

    def _record(self, session_id: str, questions: DataFrame, rows: DataFrame, done: Asked) -> None:
        last = self.table("messages").where(F.col("session_id") == session_id).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m")).first().m
        both = questions.select("query_id", "question").join(rows, "query_id")
        at = F.row_number().over(Window.orderBy("query_id"))  # the questions of one turn
        ids = stored(both.select("query_id", at.alias("n"), "question", "answer", "refused", "groundedness", "confidence").withColumn("message_id", F.concat_ws("-", F.lit(session_id), (F.lit(last) + 2 * F.col("n")).cast("string"))))
        user = ids.select(F.concat_ws("-", F.lit(session_id), (F.lit(last) + 2 * F.col("n") - 1).cast("string")).alias("message_id"), (F.lit(last) + 2 * F.col("n") - 1).alias("seq"), F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(None).cast("boolean").alias("refused"), F.lit(None).cast("double").alias("groundedness"), F.lit(None).cast("string").alias("confidence"))
        reply = ids.select("message_id", (F.lit(last) + 2 * F.col("n")).alias("seq"), F.lit("assistant").alias("role"), F.col("answer").alias("content"), "refused", "groundedness", "confidence")
        self._append("messages", user.unionByName(reply).withColumn("session_id", F.lit(session_id)).withColumn("created_at", F.current_timestamp()))
        key = ids.select("query_id", "message_id")
        self._append("citations", done.citations.join(key, "query_id"))
        self._append("verdicts", done.verdicts.where("best").join(key, "query_id"))
        first = self.table("messages").where((F.col("session_id") == session_id) & (F.col("role") == "user")).orderBy("seq").first()
        if first is not None:
            title = H.sessions(self.spark.createDataFrame([(session_id, 1, "user", first.content)], "session_id string, seq int, role string, content string")).first().title
            self._replace("sessions", self.table("sessions").withColumn("title", F.when((F.col("session_id") == session_id) & (F.col("title") == H.DEFAULT_TITLE), F.lit(title)).otherwise(F.col("title"))))
