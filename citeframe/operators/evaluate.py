"""Metrics of ranking, answers, refusal and latency over evaluated cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeframe.functions.text import contains_phrase, normalise_for_compare

OUT = "out_of_corpus"


def hit_at(relevance: Column, k: int) -> Column:
    return F.exists(F.slice(relevance, 1, k), lambda r: r)


def reciprocal_rank(relevance: Column) -> Column:
    at = F.array_position(relevance, F.lit(True))
    return F.when(at > 0, 1.0 / F.greatest(at, F.lit(1))).otherwise(F.lit(0.0))


def ndcg_at(relevance: Column, k: int) -> Column:
    gains = F.transform(F.slice(relevance, 1, k), lambda r, i: F.when(r, 1.0 / F.log2(i + 2.0)).otherwise(F.lit(0.0)))
    return F.least(F.lit(1.0), F.aggregate(gains, F.lit(0.0), lambda a, b: a + b))


def precision_at(relevance: Column, k: int) -> Column:
    window = F.slice(relevance, 1, k)
    return F.when(F.size(window) > 0, F.size(F.filter(window, lambda r: r)) / F.greatest(F.size(window), F.lit(1))).otherwise(F.lit(0.0))


def _mean(value: Column, where: Column) -> Column:
    return F.round(F.coalesce(F.avg(F.when(where, value.cast("double"))), F.lit(0.0)), 4)


def ranking_metrics(cases: DataFrame) -> DataFrame:
    """One row; over cases (category, relevance array<boolean>) in the corpus that retrieved anything."""
    r, counts = F.col("relevance"), (F.col("category") != OUT) & (F.size("relevance") > 0)
    wanted = {f"recall_{k}": hit_at(r, k) for k in (1, 3, 5)} | {"mrr": reciprocal_rank(r), "ndcg_5": ndcg_at(r, 5), "precision_5": precision_at(r, 5)}
    return cases.agg(F.count_if(counts).alias("n"), *(_mean(v, counts).alias(k) for k, v in wanted.items()))


def answer_metrics(cases: DataFrame) -> DataFrame:
    """One row of answer accuracy, citation precision and mean groundedness (of answers given)."""
    inside = F.col("category") != OUT
    return cases.agg(_mean(F.col("answer_hit"), inside).alias("answer_accuracy"), _mean(F.col("citation_correct"), inside).alias("citation_precision_1"), _mean(F.col("groundedness"), inside & ~F.col("refused")).alias("mean_groundedness"))


def refusal_metrics(cases: DataFrame) -> DataFrame:
    outside = F.col("category") == OUT
    share = lambda a, b: F.round(F.coalesce(F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)), F.lit(0.0)), 4)
    refused, flagged = F.col("refused"), F.col("refused") | F.col("flagged")
    return cases.agg(
        share(outside & refused, outside).alias("refusal_recall"),
        share(outside & refused, refused).alias("refusal_precision"),
        share(~outside & refused, ~outside).alias("false_refusal_rate"),
        share(outside & flagged, outside).alias("ood_flagged_rate"),
        share(~outside & flagged, ~outside).alias("in_corpus_flagged_rate"),
    )


def latency_metrics(cases: DataFrame) -> DataFrame:
    """Interpolated median, the element at floor(0.95 n) of the sorted list, and the maximum; exact, from counts by value."""
    by = cases.where("latency_ms is not null").groupBy("latency_ms").agg(F.count("*").alias("c"))
    # evaluated cases have few distinct latencies, so the running count is over a short list
    row = by.agg(F.sum("c").alias("n"), F.expr("percentile(latency_ms, 0.5, c)").alias("p50"), F.max("latency_ms").alias("top"), F.sort_array(F.collect_list(F.struct("latency_ms", "c"))).alias("v"))
    rank = F.greatest(F.floor(0.95 * F.col("n")), F.lit(1))
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("at"))
    p95 = F.aggregate("v", start, lambda s, x: F.struct((s["seen"] + x["c"]).alias("seen"), F.coalesce(s["at"], F.when(s["seen"] + x["c"] >= rank, x["latency_ms"].cast("bigint"))).alias("at")), lambda s: s["at"])
    return row.select(F.col("p50").alias("latency_p50"), p95.cast("double").alias("latency_p95"), F.col("top").cast("double").alias("latency_max"))


def calibration(cases: DataFrame) -> DataFrame:
    """How well the best retrieval score separates cases inside and outside the corpus, and the middle as a threshold."""
    inside = F.when(F.col("category") != OUT, F.col("best_score"))
    outside = F.when(F.col("category") == OUT, F.col("best_score"))
    row = cases.agg(F.coalesce(F.min(inside), F.lit(0.0)).alias("low"), F.coalesce(F.percentile(inside, 0.5), F.lit(0.0)).alias("mid"), F.coalesce(F.max(outside), F.lit(0.0)).alias("high"))
    return row.select(F.round("low", 7).alias("in_corpus_min"), F.round("mid", 7).alias("in_corpus_median"), F.round("high", 7).alias("out_of_corpus_max"), F.round(F.col("low") - F.col("high"), 7).alias("separation"), F.round((F.col("low") + F.col("high")) / 2, 7).alias("suggested_threshold"))


def require_gold(found: DataFrame) -> None:
    """Raises ValueError if a phrase of ``gold_in_corpus`` occurs nowhere."""
    broken = [r.item_id for r in found.where("n_units = 0").select("item_id").orderBy("item_id").limit(10).collect()]
    if broken:
        raise ValueError(f"gold phrases that occur nowhere: {', '.join(map(str, broken))}")


def report(cases: DataFrame) -> DataFrame:
    """name, value: ranking, answer and refusal metrics of ``cases``, one row each."""
    out = None
    for part in (ranking_metrics(cases), answer_metrics(cases), refusal_metrics(cases), calibration(cases)):
        rows = part.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in part.columns))))
        out = rows if out is None else out.unionByName(rows)
    return out


def gold_in_corpus(gold: DataFrame, units: DataFrame, batch: int = 500) -> DataFrame:
    """item_id, n_units: in how many units each gold phrase (item_id, phrase) occurs, 0 for broken labels.

    The phrases are the stated query set, in blocks of ``batch``; units are normalised once and each meets one block of phrases at a time.
    """
    n = max(1, -(-gold.count() // batch))
    out = None
    texts = units.select(normalise_for_compare(F.col("text")).alias("t"))
    for i in range(n):
        block = gold.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).select("item_id", normalise_for_compare(F.col("phrase")).alias("p"))
        needles = F.broadcast(block.where("p <> ''"))
        found = texts.join(needles, F.contains("t", F.col("p"))).groupBy("item_id").agg(F.count("*").alias("n_units"))
        rows = block.join(found, "item_id", "left").select("item_id", F.coalesce("n_units", F.lit(0)).alias("n_units"))
        out = rows if out is None else out.unionByName(rows)
    return out


__all__ = ["answer_metrics", "calibration", "contains_phrase", "gold_in_corpus", "hit_at", "latency_metrics", "ndcg_at", "precision_at", "ranking_metrics", "reciprocal_rank", "refusal_metrics", "report", "require_gold"]
