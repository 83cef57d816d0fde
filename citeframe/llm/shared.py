"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe.session import shared_folder, workers_find_package

#: Rows whose crc32 of the id, modulo this, equals HELD_OUT_REMAINDER are never trained on.
HELD_OUT_MODULUS = 3
HELD_OUT_REMAINDER = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column) -> Column:
    """True where the row belongs to the evaluation part; a null id is held out."""
    crc = F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"))
    return F.coalesce(F.pmod(crc, F.lit(HELD_OUT_MODULUS)) == HELD_OUT_REMAINDER, F.lit(True))


#: Deletes the shuffle files of a statement when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    This cuts the lineage so that a lost executor costs a reread and not a recomputation, and gives Catalyst the true size of the table for its choice between broadcast and shuffle joins. The shuffle files of the write go once it is done: the table takes their place.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/citeframe-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("citeframe-"):
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Bytes of an Arrow batch: about a megabyte on both sides of the worker's pipe whatever the length of texts (a batch holds one row at least).
BATCH_BYTES = 1 << 20


def in_batches(rows: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """``mapInArrow`` with batches of about ``BATCH_BYTES`` at most, in workers that find this package.

    Spark reads the bound from the session when the plan runs, after this function has returned, so it cannot be put back here: the session's bound is lowered where it is higher, and otherwise left.
    """
    spark = rows.sparkSession
    workers_find_package(spark)
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))
    return rows.mapInArrow(partial(_and_trim, run), schema)


def _and_trim(run: Callable[[Iterator], Iterator], batches: Iterator) -> Iterator:
    """``run``, after which the worker, which lives on, gives freed memory back."""
    yield from run(batches)
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library cannot
        ctypes.CDLL(None).malloc_trim(0)


_kept: dict = {}


def kept(key, build: Callable):
    """What ``build`` makes for ``key``; a worker keeps it between tasks, but only the last of all operators."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def in_slices(texts: list, chars: int = 2_000_000):
    """Start and end of consecutive slices that hold about ``chars`` characters each, and one text at least."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > chars:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)
