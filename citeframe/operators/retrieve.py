"""Fusion, reranking and selection of candidates; every step takes and gives a DataFrame of many questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeframe.functions import constants as K
from citeframe.functions.text import tokens, without

from .index import idf


def fuse(dense: DataFrame, lexical: DataFrame, by: list[str], key: str, k: int = K.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings; keeps each one's score and rank, null where it has none."""
    d = dense.select(*by, key, F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    x = lexical.select(*by, key, F.col("score").alias("lexical_score"), F.col("rank").alias("lexical_rank"))
    both = d.join(x, [*by, key], "full_outer")
    part = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    both = both.withColumn("fused", F.round(part("dense_rank") + part("lexical_rank"), 8))
    order = Window.partitionBy(*by).orderBy(F.col("fused").desc(), F.col("dense_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last(), key)
    return both.withColumn("rank", F.row_number().over(order))


def merge_variants(fused: DataFrame, key: str, k: int = K.RRF_K) -> DataFrame:
    """One ranking for each question from those of its variants (query_id, variant_no): reciprocal ranks add up, the best scores stay with their ranks."""
    rows = fused.groupBy("query_id", key).agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("fused"),
        F.max("dense_score").alias("dense_score"),
        F.max_by("dense_rank", F.struct("dense_score", -F.col("variant_no"))).alias("dense_rank"),
        F.max("lexical_score").alias("lexical_score"),
        F.max_by("lexical_rank", F.struct("lexical_score", -F.col("variant_no"))).alias("lexical_rank"),
        F.min(F.struct("variant_no", "rank")).alias("first"),
    )
    order = Window.partitionBy("query_id").orderBy(F.col("fused").desc(), "first", key)
    return rows.withColumn("rank", F.row_number().over(order)).drop("first")


def candidates(fused: DataFrame, final: int = K.TOP_FINAL, allowed: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """The first ``max(6 * final, 24)`` rows of each question. ``allowed`` (rows of key) is applied after fusion and before the cut."""
    if allowed is not None:
        fused = fused.join(allowed.select(key).distinct(), key, "left_semi")
    order = Window.partitionBy("query_id").orderBy("rank")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(6 * final, 24))


def rerank(pool: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds the signals and the score of the lexical reranker to ``pool`` (query_id, question, key, section, text, dense_score).

    Signals per question and candidate: coverage (idf of hit terms, idf over the question's candidates), proximity (the smallest window that holds every matched term), repetition, phrase (a run of 4, 3 or 2 question terms occurs in the text) and sufficiency of length. Candidates are few for each question, and all but the candidate idf happens within the row.
    """
    q = without(tokens(F.col("question")), K.RERANK_STOP)
    rows = pool.withColumn("q_terms", q).withColumn("q_set", F.array_distinct(q)).withColumn("t_all", tokens(F.concat_ws(" ", "section", "text")))
    own = rows.select("query_id", key, F.explode(F.array_intersect("q_set", F.array_distinct(tokens(F.col("text"))))).alias("term"))
    df = own.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    sizes = rows.groupBy("query_id").agg(F.count("*").alias("n"))
    known = df.join(sizes, "query_id").groupBy("query_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", idf(F.col("n"), F.col("df")).alias("w"))))).alias("weights"))  # at most the question's terms
    rows = rows.join(known, "query_id", "left").withColumn("weights", F.coalesce("weights", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))))
    most = F.greatest(F.coalesce(F.array_max(F.map_values("weights")), F.lit(0.0)), F.lit(0.0))
    weigh = lambda terms: F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at("weights", t), F.col("most")))
    rows = rows.withColumn("most", most).withColumn("hit", F.array_intersect("q_set", "t_all"))
    total = weigh(F.col("q_set"))
    coverage = F.when(total > 0, weigh(F.col("hit")) / total).otherwise(F.lit(0.0))
    share = F.size("hit") / F.greatest(F.size("q_set"), F.lit(1))
    rows = rows.withColumn("window", _smallest_window())
    proximity = F.when(F.size("hit") == 0, F.lit(0.0)).when(F.size("hit") == 1, share).otherwise(F.size("hit") / F.greatest("window", F.lit(1)) * share)
    times = F.transform("hit", lambda t: F.least(F.size(F.filter("t_all", lambda x: x == t)) - 1, F.lit(3)))
    repetition = F.least(F.aggregate(times, F.lit(0), lambda a, b: a + b) / (2 * F.greatest(F.size("q_set"), F.lit(1))), F.lit(1.0))
    joined = F.array_join("t_all", " ")
    run = lambda n: F.exists(F.sequence(F.lit(1), F.greatest(F.size("q_terms") - n + 1, F.lit(1))), lambda i: (F.size("q_terms") >= n) & F.contains(joined, F.array_join(F.slice("q_terms", i, n), " ")))
    phrase = reduce(lambda other, n: F.when(run(n), F.lit(0.35 * n / 4)).otherwise(other), (2, 3, 4), F.lit(0.0))
    sufficiency = 0.85 + 0.15 * F.least(F.size("t_all") / 60, F.lit(1.0))
    none = (F.size("q_set") == 0) | (F.size("t_all") == 0)
    rows = rows.select("*", coverage.alias("coverage"), proximity.alias("proximity"), repetition.alias("repetition"), phrase.alias("phrase"), sufficiency.alias("sufficiency"))
    lexical = F.when(none, F.lit(0.0)).otherwise((0.55 * F.col("coverage") + 0.2 * F.col("proximity") + 0.12 * F.col("repetition") + F.col("phrase")) * F.col("sufficiency"))
    rows = rows.withColumn("score", F.round(0.85 * lexical + 0.15 * F.greatest(F.coalesce("dense_score", F.lit(0.0)), F.lit(0.0)), 6))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank", key)
    return rows.drop("q_terms", "q_set", "t_all", "weights", "most", "hit").withColumn("rerank", F.row_number().over(order))


def _smallest_window():
    """Length of the shortest stretch of ``t_all`` that holds every term of ``hit``: a fold with the last place of each term."""
    start = F.struct(F.transform("hit", lambda t: F.lit(0)).alias("last"), F.lit(2**30).alias("best"))
    places = F.filter(F.transform("t_all", lambda t, i: F.struct(F.array_position("hit", t).cast("int").alias("k"), (i + 1).cast("int").alias("at"))), lambda p: p["k"] > 0)

    def step(s, p):
        last = F.transform(s["last"], lambda x, i: F.when(i + 1 == p["k"], p["at"]).otherwise(x))
        return F.struct(last.alias("last"), F.when(F.array_min(last) > 0, F.least(s["best"], p["at"] - F.array_min(last) + 1)).otherwise(s["best"]).alias("best"))

    return F.aggregate(places, start, step, lambda s: s["best"])


def drop_overlaps(ranked: DataFrame, final: int = K.TOP_FINAL, ratio: float = K.OVERLAP_RATIO, order_by: str = "rerank") -> DataFrame:
    """The first ``final`` chunks of each question (query_id, doc_id, page_no, line_start, line_end), without those that share ``ratio`` of the shorter one's lines with a kept one; position counts the kept."""
    few = ranked.where(F.col(order_by) <= final)
    row = F.struct(F.col(order_by).alias("at"), F.struct(*few.columns).alias("row"))
    grouped = few.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))  # ``final`` at most
    kind = few.select(F.array(F.struct(*few.columns)).alias("x")).schema["x"].dataType.simpleString()

    def clash(a, b):
        shared = F.least(a["line_end"], b["line_end"]) - F.greatest(a["line_start"], b["line_start"]) + 1
        shorter = F.least(a["line_end"] - a["line_start"], b["line_end"] - b["line_start"]) + 1
        return (a["doc_id"] == b["doc_id"]) & (a["page_no"] == b["page_no"]) & (shared / shorter >= ratio)

    kept = F.aggregate("rows", F.array().cast(kind), lambda done, r: F.when(F.exists(done, lambda d: clash(d, r["row"])), done).otherwise(F.concat(done, F.array(r["row"]))))
    return grouped.select(F.posexplode(kept).alias("at", "r")).select("r.*", (F.col("at") + 1).alias("position"))
