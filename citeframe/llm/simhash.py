"""SimHash fingerprints and their near-duplicate components.

Fingerprint: A-Z lower-cased, words are runs of characters other than space and U+0009 to U+000D; each shingle of ``WIDTH`` words (repeats included, joined by one space; a shorter text: its whole sequence) is hashed by XXH64 with a seed, and a bit is set where it is set in over half of the hashes. No words: zero.

Candidates: the fingerprint is mapped to its bit counts in 32 segments of two bits, in unary code, so that the Manhattan distance of two such vectors is the number of bits in which their codes differ. It never exceeds the Hamming distance. The segments form six blocks; fingerprints within distance 2 differ in at most two of them, so the grid has 15 tables, one for each choice of four blocks, with the counts of these as the cell: about 30 bits of information, so that a cell holds one other fingerprint on average among 10^9. Within a cell the Manhattan range prunes and the exact Hamming distance verifies.

Equal fingerprints are one node, so copies cost nothing. A cell with more than ``CROWD`` distinct fingerprints is split by the bits of its four blocks, which are equal too for at least one table of every link. If more than ``CROWD`` agree in those 40 or more bits as well, their members are linked exactly through midpoints: fingerprints within distance 2 share a value at distance 1 or 0 from both, and at most 65 fingerprints can share one, which bounds every group whatever the data.

Components come from alternating star rounds over the links. Null texts count as empty; all texts without words share the zero fingerprint and are linked like any others. Repeated rows are kept; a component's id is the smallest id in it, null only if all its ids are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import in_batches, table, written

WIDTH = 3
SEED = 42
REACH = 2
CROWD = 64
#: Bits of the blocks: 6, 6, 5, 5, 5 and 5 segments.
BLOCKS = tuple(((1 << n) - 1) << at for at, n in ((0, 12), (12, 12), (24, 10), (34, 10), (44, 10), (54, 10)))


def fingerprint(text: str, width: int = WIDTH, seed: int = SEED) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: lower() changes A-Z and split() cuts at these six characters only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, width: int = WIDTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer; no shuffle."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t or "", width, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return in_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("bigint")


def embedded(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments in unary code: 0 is 00, 1 is 01, 2 is 11."""
    even = _signed(0x5555555555555555)
    low, high = fp.bitwiseAND(even), F.shiftrightunsigned(fp, 1).bitwiseAND(even)
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of the segments' bit counts, at most the Hamming distance."""
    return F.bit_count(embedded(a).bitwiseXOR(embedded(b)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _placed(fps: DataFrame, code: Column) -> DataFrame:
    """fp once for each table, with its cell there: the parts of ``code`` in the table's blocks."""
    cells = F.array(*(F.struct(F.lit(i).alias("grid"), code.bitwiseAND(_signed(sum(chosen))).alias("cell")) for i, chosen in enumerate(combinations(BLOCKS, len(BLOCKS) - REACH))))
    return fps.select("fp", F.explode(cells).alias("at")).select("fp", "at.grid", "at.cell")


def _paired(placed: DataFrame) -> DataFrame:
    near = (manhattan(F.col("u"), F.col("v")) <= REACH) & (hamming(F.col("u"), F.col("v")) <= REACH)
    two = placed.select("grid", "cell", "fp")
    return two.withColumnRenamed("fp", "u").join(two.withColumnRenamed("fp", "v"), ["grid", "cell"]).where((F.col("u") > F.col("v")) & near).select("u", "v")


def _shared(placed: DataFrame) -> DataFrame:
    """``placed`` with the number of fingerprints in each cell, where there are several."""
    return written(placed.join(placed.groupBy("grid", "cell").agg(F.count("*").alias("members")).where("members > 1"), ["grid", "cell"]))


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints ``fp`` within REACH differing bits; every link is within REACH itself."""
    by_counts = _shared(_placed(fps, embedded(F.col("fp"))))
    paired = _paired(by_counts.where(F.col("members") <= crowd))
    busy = by_counts.where(F.col("members") > crowd).select("fp", "grid")
    if busy.isEmpty():
        return paired.distinct()
    masks = F.element_at(F.array(*(_signed(sum(chosen)) for chosen in combinations(BLOCKS, len(BLOCKS) - REACH))), F.col("grid") + 1)
    by_bits = _shared(busy.select("fp", "grid", F.col("fp").bitwiseAND(masks).alias("cell")))
    paired = paired.union(_paired(by_bits.where(F.col("members") <= crowd)))
    dense = by_bits.where(F.col("members") > crowd).select("fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *(_signed(1 << k) for k in range(64)))
    middle = dense.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    groups = middle.groupBy("middle").agg(F.sort_array(F.collect_list("fp")).alias("near")).where(F.size("near") > 1)  # 65 at most
    through = groups.select(F.element_at("near", 1).alias("v"), F.explode("near").alias("u")).where("u <> v").select("u", "v")
    return paired.union(through).distinct()


def near_duplicates(df: DataFrame, width: int = WIDTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id for each row of ``df``."""
    docs = written(fingerprints(df, width, seed, id_col, text_col))
    fps = written(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(fps.select("fp")))
    member = roots.select(F.col("u").alias("fp"), "root").union(roots.select("root", "root").distinct())
    lowest = member.join(fps, "fp").groupBy("root").agg(F.min("first_id").alias("lowest"))
    linked = member.join(lowest, "root").select("fp", "lowest")
    named = written(fps.join(linked, "fp", "left").select("fp", F.coalesce("lowest", "first_id").alias("component_id")))  # so that both sides of the last join are plain exchanges, which AQE can split where one fingerprint fills a partition
    return docs.join(named, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
