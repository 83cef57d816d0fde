"""The corpus pipeline: five stages, each on all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``documents``. ``run`` writes each stage as Parquet in the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe.llm import byte_bpe, decontaminate, language, near_copies, secrets
from citeframe.llm.shared import forget, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (or null) go; the others get the predicted language, which is undetermined where no language could be learned."""
    samples = language.training_texts(docs)
    kept = language.identify(docs, samples, keep=("text", "source", "n_chars"))
    lettered = F.col("lang_pred") != language.UNDETERMINED if samples else F.col("text").rlike(language.LETTER)
    return kept.where(lettered).withColumnRenamed("lang_pred", "lang").select(COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with row_key, a digest of the whole row: equal for equal rows only, whatever their ids."""
    return docs.select(COLUMNS).withColumn("row_key", F.unhex(F.md5(F.to_json(F.struct(*COLUMNS)))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard of 0.8 or more) the row with the smallest id stays, a null id coming last; ids only choose, so rows that share an id or have none stay unless their texts are near copies."""
    return near_copies.deduplicated(keyed(docs)).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text contains a benchmark item go, whatever ids they share with others."""
    rows = keyed(docs)
    leaks = written(decontaminate.leaks(rows, table(spark, sf_dir, "benchmark"), id_col="row_key").select(F.col("doc_id").alias("row_key")).distinct())
    return rows.join(leaks, "row_key", "left_anti").select(COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; n_chars follows."""
    return secrets.redact(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of their decoding."""
    return byte_bpe.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_level_bpe", byte_level_bpe),
]

#: SQL cannot express the stages; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the table of a stage is deleted once the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        forget(before)
    return docs
