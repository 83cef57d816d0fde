"""Incremental ingestion and stream statistics with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citeframe.operators.chunking import chunks_of


def document_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Documents as their Parquet files arrive."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ingest(docs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the chunks of contents not seen before to ``target``; a content counts once, however often it arrives.

    Each batch is matched with the hashes already stored (an anti-join on the digest column alone) and written under its batch number, so a repeated batch overwrites its own rows.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
        fresh = fresh.join(fresh.groupBy("sha256").agg(F.min("doc_id").alias("doc_id")), ["sha256", "doc_id"], "left_semi").dropDuplicates(["sha256"])
        known = spark.read.schema("sha256 string, batch bigint").parquet(f"{target}/registry").where(F.col("batch") < number).select("sha256")
        fresh = fresh.join(known, "sha256", "left_anti")
        chunks_of(fresh).write.mode("overwrite").parquet(f"{target}/chunks/batch={number}")
        fresh.select("sha256", "doc_id").write.mode("overwrite").parquet(f"{target}/registry/batch={number}")

    docs.sparkSession.createDataFrame([], "sha256 string, doc_id bigint").write.mode("ignore").parquet(f"{target}/registry/batch=-1")
    return docs.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type, with a watermark for late ones; works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
