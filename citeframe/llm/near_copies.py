"""SimHash near-dedup at a similarity: groups of texts that a chain of five-word Jaccard similarities of 4/5 or more connects.

Words and shingle hashes are those of ``simhash`` with five words a shingle, but 32 bits of each are kept, so that of 50,000 pairs about one is taken to share a shingle too many; a text of fewer words is one shingle, texts without words are alike. Texts with equal shingle sets are one node, so exact copies cost nothing.

At that similarity the bits of two SimHash fingerprints differ in 15 of 100 places (acos(8/9) / pi), far beyond the two bits of ``simhash``: no four of its six blocks are surely equal, and a cell must hold fewer counts in more tables. The steps are those of ``simhash``. The fingerprints, of ``WORDS`` * 64 bits, are mapped to the bit counts of their two-bit segments, 32 in a word (``counts``), and each table of the grid takes its cell from the counts of some segments, drawn at random. A cell has five bits less of information than log2 of the number of rows, so that it holds some tens of strangers whatever the size of the corpus, and the number of tables follows from ``RECALL``, the chance that a pair at exactly 4/5 meets in one of them; more similar pairs meet more surely (``plan``). Within a cell the Manhattan distance of the segment counts of one fingerprint word, a lower bound, prunes and its exact Hamming distance verifies (``REACH``: three in 10,000 near pairs differ more); the Jaccard similarity of the whole shingle sets decides.

Links need only connect the groups. First each node is compared with its nearest candidate, by the distance of long fingerprints. Then, while the cells hold many pairs between different components and it helps, each node is compared with a node of the main component of one of its cells, so that a large group grows together. The candidate pairs left between components are listed once each and compared, whatever their number. So a large group of near copies costs about as many comparisons as it has members, and no candidate is dropped but pairs whose long fingerprints (``LONG`` * 64 bits, of the nodes that have candidates) differ in over ``REACH_LONG`` bits (one in 1,000 pairs at 4/5).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import forget, in_batches, written
from .simhash import SEED, hamming, manhattan

WIDTH = 5
WORDS = 8
RECALL = 0.95
REACH = 20
#: Words of the fingerprints of nodes that have candidates, and the bits in which near ones differ at most.
LONG = 32
REACH_LONG = 360
#: Rows of a cell that a task holds at once; pairs between the parts of larger cells are found by a join.
CROWD = 4096
ROUNDS = 3
#: Tables whose cells are shuffled at once, and 64-bit words of a filter of row keys at most (8 MB).
PASS = 16
MARKS = 1 << 20
#: Pairs between components in cells, for each row of a cell, that are listed.
LISTED = 4
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingle_set(text: str) -> np.ndarray:
    """The sorted distinct shingle hashes of ``text``, 32 bits of each."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int32)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WIDTH)), strict=False)) if len(words) >= WIDTH else [b" ".join(words)]
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64).astype(np.uint32).view(np.int32))


def _node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays])))


def _word(found: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the shingles for word ``k`` of the fingerprint: the shingle hashes, mixed (splitmix64)."""
    z = found.view(np.uint32).astype(np.uint64) + np.uint64(int(_MIX[0]) * (k + 1) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * _MIX[1]
    z = (z ^ (z >> np.uint64(27))) * _MIX[2]
    return z ^ (z >> np.uint64(31))


def fingerprint(found: np.ndarray, words: int = WORDS) -> bytes:
    """SimHash of ``words`` * 64 bits: those set in over half of the shingles' hashes."""
    counts = np.zeros(words * 64, np.int64)
    for start in range(0, len(found), 1024):
        part = found[start : start + 1024]
        mixed = np.stack([_word(part, k) for k in range(words)], axis=1)
        counts += np.unpackbits(mixed.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(found), bitorder="little").tobytes()


def plan(rows: int, recall: float = RECALL) -> np.ndarray:
    """The segments of each table, one row a table, for a corpus of ``rows`` rows.

    Strangers agree in a segment's count at 3/8. Pairs at 4/5 agree where no bit differs, or both do and were unlike; how many of all bits differ varies from pair to pair.
    """
    size = min(20, round(max(8, math.log2(rows + 1) - 5) / math.log2(8 / 3)))
    differ, n = math.acos(8 / 9) / math.pi, WORDS * 64
    share = np.arange(n + 1) / n
    weight = np.array([math.comb(n, k) * differ**k * (1 - differ) ** (n - k) for k in range(n + 1)])
    apart = 1 - ((1 - share) ** 2 + share**2 / 2) ** size
    tables = 1
    while weight @ apart**tables > 1 - recall:
        tables += 1
    random = np.random.default_rng(SEED)
    return np.array([random.choice(WORDS * 32, size, replace=False) for _ in range(tables)])


def fingerprints(rows: DataFrame) -> DataFrame:
    """row_key, doc_id, node, n and print for each row of row_key, doc_id and text. Shingle sets, as large as the texts, are not kept: ``shingle_sets`` makes those that are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t or "") for t in batch.column(2).to_pylist()]
            arrays = [pa.array([_node(f) for f in sets], pa.int64()), pa.array([len(f) for f in sets], pa.int32()), pa.array([fingerprint(f) for f in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["row_key", "doc_id", "node", "n", "print"])

    return in_batches(rows.select("row_key", "doc_id", "text"), run, f"row_key binary, doc_id {rows.schema['doc_id'].dataType.simpleString()}, node bigint, n int, print binary")


def marks(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the row_keys of ``keys``: 16 bits for each, of which four of one 64-bit word are set, but ``MARKS`` words at most; beyond that more other keys pass, and none of these is lost."""
    hashed = keys.select(F.xxhash64("row_key").alias("h"))
    size = min(MARKS, 1 + hashed.count() // 4)
    bits = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {6 * i}) & 63 as int))") for i in range(4)]
    mask = bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])
    found = hashed.select(F.pmod(F.shiftrightunsigned("h", 24), F.lit(size)).cast("int").alias("at"), mask.alias("mask")).groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["at"].to_numpy()] = found["mask"].to_numpy()
    return out


def marked(marks: np.ndarray) -> Column:
    """Whether row_key is among those of ``marks``, or one of the few others that pass. Only the key's hash goes to Python, and no row is shuffled."""

    def run(h: pa.Array) -> pa.Array:
        h = h.to_numpy(zero_copy_only=False).view(np.uint64)
        mask = np.zeros(len(h), np.uint64)
        for i in range(4):
            mask |= np.uint64(1) << (h >> np.uint64(6 * i) & np.uint64(63))
        return pa.array(marks.view(np.uint64)[(h >> np.uint64(24)) % np.uint64(len(marks))] & mask == mask)

    return F.arrow_udf(run, "boolean")(F.xxhash64("row_key"))


def counts(words: np.ndarray) -> np.ndarray:
    """The bit counts of the two-bit segments of ``words`` in unary code, as ``simhash.embedded``."""
    even = np.uint64(0x5555555555555555)
    low, high = words & even, (words >> np.uint64(1)) & even
    return low | high | ((low & high) << np.uint64(1))


def placed(nodes: DataFrame, tables: np.ndarray, start: int = 0) -> DataFrame:
    """cell, node, n and word (the first of the fingerprint) for each table; ``start``: the number of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(-1, WORDS * 8)
                codes = counts(raw.view(np.uint64))
                cells = np.tile(np.arange(start, start + len(tables), dtype=np.int64) << 40, (len(raw), 1))
                for b in range(tables.shape[1]):
                    segment = tables[:, b]
                    cells |= (codes[:, segment // 32] >> (2 * (segment % 32)).astype(np.uint64) & np.uint64(3)).astype(np.int64) << 2 * b
                word = raw[:, :8].copy().view(np.int64).ravel()
                again = [np.repeat(x, len(tables)) for x in (part.column(0).to_numpy(), part.column(1).to_numpy(), word)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cells.ravel(), *again)], ["cell", "node", "n", "word"])

    return in_batches(nodes.select("node", "n", "print"), run, "cell bigint, node bigint, n int, word bigint")


def whole_cells(batches: Iterator[pa.RecordBatch], crowd: int) -> Iterator[pa.RecordBatch]:
    """From rows in order of their first column, the cell, batches that hold whole cells; a cell of more than ``crowd`` rows comes in parts of about that size, each with no other cell."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        cell = batch.column(0).to_numpy()
        end = int(np.searchsorted(cell, cell[-1], "left"))
        if end:
            yield batch.slice(0, end)
        held = batch.slice(end)
        if held.num_rows > crowd:
            yield held
            held = None
    if held is not None:
        yield held


def _pairs(cell: np.ndarray, n: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, other places, Hamming distances of the words) of rows that share a cell and may be near."""
    word, n = word.view(np.uint64), n.astype(np.int64)
    codes = counts(word)
    left = np.arange(len(cell))
    for d in range(1, len(cell)):
        left = left[left + d < len(cell)]
        left = left[cell[left] == cell[left + d]]
        if not len(left):
            break
        at = left + d
        apart = np.bitwise_count(word[left] ^ word[at])
        near = (5 * np.minimum(n[left], n[at]) >= 4 * np.maximum(n[left], n[at])) & (np.bitwise_count(codes[left] ^ codes[at]) <= REACH) & (apart <= REACH)
        if near.any():
            yield left[near], at[near], apart[near]


def members(cells: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The rows of ``placed`` that may have a near one in their cell (all rows of a crowded cell), with the nearest there. Cells stream by in order, so a task holds about a batch and ``crowd`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_cells(batches, crowd):
            cell, node, n, word = (batch.column(i).to_numpy() for i in range(4))
            least, best = np.full(len(cell), 255, np.uint8), np.zeros(len(cell), np.int64)
            for a, b, apart in _pairs(cell, n, word):
                for one, two in ((a, b), (b, a)):  # no place twice in either
                    closer = apart < least[one]
                    least[one[closer]], best[one[closer]] = apart[closer], node[two[closer]]
            keep = least < 255
            if len(cell) > crowd and cell[0] == cell[-1]:
                keep[:] = True
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, mask=least == 255)], ["cell", "node", "n", "word", "best"])
            yield out.filter(pa.array(keep))

    return in_batches(cells.repartition("cell").sortWithinPartitions("cell"), run, "cell bigint, node bigint, n int, word bigint, best bigint")


def crossing(labelled: DataFrame, prints: DataFrame, tables: np.ndarray, crowd: int = CROWD) -> DataFrame:
    """Pairs (u, v), u > v, with the distance ``far`` of their long fingerprints, of rows of ``members`` with different roots that share a cell and may be near; each pair once, from the first table it meets in."""
    sizes = labelled.groupBy("cell").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("cell", "size")
    open_ = written(labelled.join(sizes, "cell").join(prints, "node").select("cell", "node", "n", "word", "root", "print", "size"))
    masks = np.zeros((len(tables), WORDS), np.uint64)
    for k, segments in enumerate(tables):
        for b in segments.tolist():
            masks[k, b // 32] |= np.uint64(3 << 2 * (b % 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_cells(batches, crowd):
            cell, node, n, word, root = (batch.column(i).to_numpy() for i in range(5))
            long = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, LONG)
            for a, b, _ in _pairs(cell, n, word):
                apart = root[a] != root[b]
                a, b = a[apart], b[apart]
                for start in range(0, len(a), 2048):
                    one, two = a[start : start + 2048], b[start : start + 2048]
                    far = np.bitwise_count(long[one] ^ long[two]).sum(axis=1, dtype=np.int32)
                    near = far <= REACH_LONG
                    one, two, far = one[near], two[near], far[near]
                    differ = counts(long[one, :WORDS]) ^ counts(long[two, :WORDS])
                    meet = ((differ[:, None, :] & masks[None, :, :]) == 0).all(axis=2)
                    first = meet.argmax(axis=1) == cell[one] >> 40
                    u, v = node[one[first]], node[two[first]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v)), pa.array(far[first])], ["u", "v", "far"])

    calm = in_batches(open_.where(F.col("size") <= crowd).drop("size").repartition("cell").sortWithinPartitions("cell"), run, "u bigint, v bigint, far int")
    busy = open_.where(F.col("size") > crowd).select("cell", F.struct("node", "n", "word").alias("a"), "root")
    if busy.isEmpty():
        return calm
    met = busy.join(busy.select("cell", F.col("a").alias("b"), F.col("root").alias("other")), "cell").where((F.col("a.node") > F.col("b.node")) & (F.col("root") != F.col("other")) & _likely("a", "b"))
    return calm.union(distances(met.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")), prints, REACH_LONG)).dropDuplicates(["u", "v"])


def long_prints(rows: DataFrame) -> DataFrame:
    """node and the long fingerprint of each row with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_node(f) for f in sets], pa.int64()), pa.array([fingerprint(f, LONG) for f in sets], pa.binary())], ["node", "print"])

    return in_batches(rows.select("text"), run, "node bigint, print binary")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """node and shingles of each row with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_node(f) for f in sets], pa.int64()), _lists(sets)], ["node", "shingles"])

    return in_batches(rows.select("text"), run, "node bigint, shingles array<int>")


def of_nodes(rows: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose texts the ``wanted`` nodes come from (all of equal rows), and a few others: nothing is shuffled but keys."""
    return rows.where(marked(marks(wanted.join(nodes.select("node", "row_key"), "node"))))


def _likely(a: str, b: str) -> Column:
    """Whether two rows (structs of node, n and word) may be near."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (5 * small >= 4 * large) & (manhattan(F.col(f"{a}.word"), F.col(f"{b}.word")) <= REACH) & (hamming(F.col(f"{a}.word"), F.col(f"{b}.word")) <= REACH)


def _nearest(pairs: DataFrame, one: str = "u", two: str = "v") -> DataFrame:
    """Of the pairs of each ``one``, and of each ``two``, that with the least distance."""
    best = F.min_by(F.struct("u", "v"), F.struct("far", "u", "v")).alias("p")
    return pairs.groupBy(one).agg(best).select("p.u", "p.v").union(pairs.groupBy(two).agg(best).select("p.u", "p.v")).distinct()


def verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the ``pairs`` (u, v) whose Jaccard similarity is 4/5 or more. Shingle sets are made of the pairs' nodes only, and shuffled without being stored."""
    pairs = written(pairs.select("u", "v").distinct())
    if pairs.isEmpty():
        return pairs
    sets = shingle_sets(of_nodes(rows, nodes, pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())).dropDuplicates(["node"])
    met = pairs.join(sets.toDF("u", "su"), "u").join(sets.toDF("v", "sv"), "v")
    found = written(met.where(9 * F.size(F.array_intersect("su", "sv")) >= 4 * (F.size("su") + F.size("sv"))).select("u", "v"))
    forget(pairs)
    return found


def distances(pairs: DataFrame, prints: DataFrame, reach: int) -> DataFrame:
    """u, v and the Hamming distance ``far`` of their fingerprints, for distinct ``pairs`` of which it is ``reach`` at most."""
    met = pairs.distinct().join(prints.toDF("u", "one"), "u").join(prints.toDF("v", "two"), "v").select("u", "v", "one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (2, 3))
            far = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far)], ["u", "v", "far"]).filter(pa.array(far <= reach))

    return in_batches(met, run, "u bigint, v bigint, far int")


def _towards_main(labelled: DataFrame, open_cells: DataFrame, prints: DataFrame, k: int) -> DataFrame:
    """For each node the nearest of the pivots of its cells: one node, another each round, of a cell's main component."""
    open_ = labelled.join(open_cells.select("cell", "main"), "cell").select("cell", F.struct("node", "n", "word").alias("a"), "root", "main")
    pivots = open_.where("root = main").groupBy("cell").agg(F.min_by("a", F.xxhash64("a.node", F.lit(k))).alias("b"))
    met = open_.where("root <> main").join(pivots, "cell").where(_likely("a", "b")).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    return distances(met, prints, REACH_LONG).groupBy("u").agg(F.min_by("v", F.struct("far", "v")).alias("v")).select("u", "v")


def links(rows: DataFrame, nodes: DataFrame, tables: np.ndarray, crowd: int = CROWD, rounds: int = ROUNDS) -> DataFrame:
    """Links (u, v) that connect every group; ``rows``: row_key and text, ``nodes``: node, row_key of one row, n and print."""
    parts = [written(members(placed(nodes, tables[k : k + PASS], k), crowd)) for k in range(0, len(tables), PASS)]
    held = written(reduce(DataFrame.union, parts))
    forget(*parts)
    long = written(long_prints(of_nodes(rows, nodes, held.select("node").distinct())).dropDuplicates(["node"]))
    first = distances(held.where("best is not null").select(F.greatest("node", "best").alias("u"), F.least("node", "best").alias("v")), long, REACH_LONG)
    found = verified(_nearest(first), rows, nodes)
    n_held, before_apart = held.count(), math.inf
    for k in range(rounds + 1):
        labelled = written(held.join(components(found).toDF("node", "root"), "node", "left").select("cell", "node", "n", "word", F.coalesce("root", "node").alias("root")))
        groups = labelled.groupBy("cell", "root").agg(F.count("*").cast("double").alias("c"))
        open_cells = written(groups.groupBy("cell").agg(F.sum("c").alias("every"), F.sum(F.col("c") * F.col("c")).alias("same"), F.max_by("root", F.struct("c", "root")).alias("main")).where("every * every > same"))
        n_apart = open_cells.agg(F.sum((F.col("every") * F.col("every") - F.col("same")) / 2)).first()[0] or 0
        if k == rounds or n_apart <= LISTED * n_held or n_apart > 0.7 * before_apart:
            forget(open_cells)
            break
        more = verified(_towards_main(labelled, open_cells, long, k), rows, nodes)
        before, found = found, written(found.union(more))
        forget(before, more, labelled, open_cells)
        before_apart = n_apart
    more = verified(crossing(labelled, long, tables, crowd), rows, nodes)
    before, found = found, written(found.union(more))
    forget(before, more, labelled, held, long)
    return found


def _representatives(rows: DataFrame, crowd: int, rounds: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """The row_key of one row of every group, and all row_keys with the number of their rows."""
    prints = written(fingerprints(rows))
    keys = written(prints.groupBy("row_key").agg(F.count("*").alias("times")))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    nodes = written(prints.groupBy("node").agg(F.min_by(F.struct("row_key", "doc_id"), order).alias("best"), F.min("n").alias("n"), F.min("print").alias("print")).select("node", "best.row_key", "best.doc_id", "n", "print"))
    tables = plan(prints.count(), recall)
    forget(prints)
    linked = links(rows, nodes, tables, crowd, rounds)
    roots = components(linked).withColumnRenamed("u", "node")
    grouped = nodes.select("node", "row_key", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keep = written(grouped.groupBy("root").agg(F.min_by("row_key", order).alias("row_key")).select("row_key"))
    forget(nodes, linked)
    return keep, keys


def representatives(rows: DataFrame, crowd: int = CROWD, rounds: int = ROUNDS, recall: float = RECALL) -> DataFrame:
    """row_key of one row of every group: that with the smallest id (null last), then the smallest key. ``rows``: row_key (equal only for equal rows), doc_id, text."""
    return _representatives(rows, crowd, rounds, recall)[0]


def deduplicated(rows: DataFrame, crowd: int = CROWD, rounds: int = ROUNDS, recall: float = RECALL) -> DataFrame:
    """One of ``rows`` (row_key, equal only for equal rows, doc_id, text and others) for each of ``representatives``. Rows whose key is surely kept and not repeated stay where they are; the others, most of which go, are grouped by key."""
    keep, keys = _representatives(rows, crowd, rounds, recall)
    doubtful = marked(marks(keys.where("times = 1").join(keep, "row_key", "left_anti").select("row_key").union(keys.where("times > 1").select("row_key"))))
    return rows.where(~doubtful).unionByName(rows.where(doubtful).dropDuplicates(["row_key"]).join(keep, "row_key", "left_semi"))
