"""Document fingerprints from spot signatures.

An anchor is a common word; its signature is the anchor with the chain of the next ``CHAIN`` content words (words that are not common). The fingerprint of a text is the set of its signatures, as sorted 32-bit hashes in hexadecimal. A text with words but without any full chain has one signature, its whole word sequence; a text without words has none, and its fingerprint is the empty string. Null counts as empty.

Likeness is the Jaccard similarity of two fingerprints. Where only pairs above a threshold matter, sets whose sizes differ by more than the threshold allows are pruned before they are compared (``pruned_jaccard``), and ``near_duplicates`` partitions by set length so that only neighbouring partitions meet. Two empty fingerprints are alike (1), an empty and another are not (0).

All of this is DataFrame and SQL functions. Repeated rows are kept; rows that share a doc_id are ordered by their text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written

CHAIN = 2
#: Anchors and the other common words that chains skip: frequent function words of four languages.
ANCHORS = "the is was are that it le la les des est une der die das und ist ein el los las una es del".split()
OTHER_COMMON = "a an and of to in on at by for with from as be this or un du de et en que qui dans pour sur au par den dem des zu von mit auf nicht sich auch im y se no con por para al o".split()
BUCKET = 256


def _likes(words: list[str]) -> str:
    return "|".join(sorted(set(words)))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def signatures(text: Column) -> Column:
    """The sorted array of distinct 32-bit signature hashes.

    The text becomes one line for each content word, with the anchors up to the next content word behind it, so that every step takes time in proportion to the text, however many common words stand in a row.
    """
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    others = [w for w in OTHER_COMMON if w not in ANCHORS]
    lines = F.regexp_replace(F.concat(F.lit("-"), plain), f" (?:{_likes(others)})(?= )", "")
    lines = F.split(F.regexp_replace(lines, f" (?!(?:{_likes(ANCHORS)}) )(?=[^ ])", "\n"), "\n")

    def of_lines(lines: Column) -> Column:
        anchors = F.transform(lines, lambda x: F.when(F.instr(x, " ") > 0, F.array_distinct(F.filter(F.slice(F.split(x, " "), 2, F.length(x)), lambda y: y != ""))).otherwise(F.array().cast("array<string>")))
        return _let(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.substring_index(x, " ", 1)), lambda words: with_words(anchors, words))

    def with_words(anchors: Column, words: Column) -> Column:
        chains = words
        for k in range(1, CHAIN):
            chains = F.zip_with(chains, F.slice(words, F.lit(k + 1), F.size(words)), lambda x, y: F.concat(x, F.lit(" "), y))
        return F.flatten(F.zip_with(anchors, chains, lambda many, chain: F.when(chain.isNotNull(), F.transform(many, lambda x: F.hash(F.concat(x, F.lit(" "), chain)))).otherwise(F.array().cast("array<int>"))))

    found = F.array_distinct(_let(lines, of_lines))
    whole = F.when(F.trim(plain) == "", F.array().cast("array<int>")).otherwise(F.array(F.hash(plain)))
    return _let(found, lambda x: F.sort_array(F.when(F.size(x) > 0, x).otherwise(whole)))


def as_text(spots: Column) -> Column:
    """The fingerprint as text: eight hexadecimal digits a signature, joined by commas."""
    return F.array_join(F.transform(spots, lambda h: F.lpad(F.lower(F.hex(h.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), ",")


def pruned_jaccard(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without comparing them where their sizes rule ``threshold`` out."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    exact = common / (F.size(a) + F.size(b) - common)
    return F.when(large == 0, F.lit(1.0)).when((small == 0) | (small < large * threshold), F.lit(0.0)).otherwise(exact)


def followers(ids: DataFrame, width: int = BUCKET) -> DataFrame:
    """For the non-empty buckets of ``width`` ids: bucket, and as guest the id that follows its lowest in descending order (after the last: the first).

    Ids only; every level is ``width`` times smaller, and only the last, of a few rows, is ordered in one task.
    """
    lows = ids.groupBy(F.floor(F.col("doc_id") / width).alias("bucket")).agg(F.max("doc_id").alias("top"))
    lows = lows.withColumn("upper", F.floor(F.col("bucket") / 4096))
    inner = Window.partitionBy("upper").orderBy(F.col("bucket").desc())
    lows = lows.withColumn("guest", F.lead("top").over(inner))
    tops = lows.groupBy("upper").agg(F.max("top").alias("top"))
    over = Window.orderBy(F.col("upper").desc())
    first = F.first("top").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tops = tops.select("upper", F.coalesce(F.lead("top").over(over), first).alias("next_top"))
    return lows.join(tops, "upper").select("bucket", F.coalesce("guest", "next_top").alias("guest"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = BUCKET) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness; see ``op1_spot_fingerprints``.

    The text moves once, to its bucket of neighbouring ids; the one row that a bucket's last row needs from the next bucket comes as a guest. Rows with a null id count as the lowest id there is.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**62))).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("bucket", F.floor(F.col("doc_id") / width))
    guests = written(followers(base.select("doc_id"), width))
    visits = base.drop("bucket").join(guests.withColumnRenamed("guest", "doc_id"), "doc_id")
    order = Window.partitionBy("doc_id", "bucket").orderBy("text")
    visits = visits.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    rows = base.withColumn("guest", F.lit(0)).unionByName(visits.withColumn("guest", F.lit(1)))
    rows = rows.withColumn("spots", signatures(F.col("text")))
    inside = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc(), "text")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("next", F.lead(F.struct("text", "spots")).over(inside)).where("guest = 0")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), edited.alias("edited"), "spots", F.col("next.spots").alias("next_spots"))
    rows = rows.withColumn("edited_spots", signatures(F.col("edited")))
    return rows.select(
        F.when(F.col("doc_id") > -(2**62), F.col("doc_id")).alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("spots")).alias("fingerprint"),
        as_text(F.col("edited_spots")).alias("edited_fingerprint"),
        pruned_jaccard(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        pruned_jaccard(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


def op1_spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text against itself with its last half replaced by the start of the next document in descending order of ids."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (a, b, likeness) of class representatives with a likeness of ``threshold`` or more, a < b, and each class's size.

    Texts with equal fingerprints form a class, represented by its smallest id, so copies are never paired. Each set is indexed under its rarest signatures only (as many as the threshold requires), together with its length partition; a pair can meet the threshold only in the same or the next partition, since partitions widen by the factor 1 / threshold.
    """
    sets = docs.select(F.col(id_col).alias("id"), signatures(F.col(text_col)).alias("spots"))
    classes = written(sets.groupBy("spots").agg(F.min("id").alias("id"), F.count("*").alias("copies")).where(F.size("spots") > 0))
    spread = classes.select("id", F.size("spots").alias("n"), F.explode("spots").alias("spot"))
    counts = spread.groupBy("spot").agg(F.count("*").alias("df"))
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    ranked = spread.join(counts, "spot").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("df", "spot")))
    part = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9)
    index = ranked.where(F.col("rank") <= keep).select("id", "n", "spot", part.alias("part"))
    left = index.select(F.col("id").alias("a"), F.col("n").alias("na"), "spot", F.explode(F.array(F.col("part") - 1, "part", F.col("part") + 1)).alias("part"))
    right = index.select(F.col("id").alias("b"), F.col("n").alias("nb"), "spot", "part")
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    met = left.join(right, ["spot", "part"]).where((F.col("a") < F.col("b")) & (small >= large * threshold)).select("a", "b").distinct()
    one = classes.select(F.col("id").alias("a"), F.col("spots").alias("spots_a"), F.col("copies").alias("copies_a"))
    two = classes.select(F.col("id").alias("b"), F.col("spots").alias("spots_b"), F.col("copies").alias("copies_b"))
    likeness = pruned_jaccard(F.col("spots_a"), F.col("spots_b"), threshold)
    return met.join(one, "a").join(two, "b").withColumn("likeness", likeness).where(F.col("likeness") >= threshold).select("a", "b", "likeness", "copies_a", "copies_b")
