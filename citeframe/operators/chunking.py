"""Line-aware chunks as a fold over the lines of a page, inside the document's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeframe.functions import constants as K
from citeframe.functions.text import is_heading, locator, stable_id, word_count
from citeframe.sources.lines import line_array, page_arrays

_CHUNK = "struct<line_start:int,line_end:int,section:string,words:int>"


def _page_chunks(lines: Column, target: int, overlap: int, least: int) -> Column:
    """Chunks of one page (an array of at most PAGE_LINES lines).

    The open chunk is lines ``first`` to the current one, ``words`` in all and ``fresh`` of its lines not yet in any chunk. A heading closes it if it holds ``least`` words; reaching ``target`` words closes it and carries ``overlap`` lines over. What is left at the end joins the chunk before if it is short and adjacent; carried lines alone are never a chunk.
    """
    counts = F.transform(lines, word_count)
    rows = F.transform(lines, lambda t, i: F.struct((i + 1).cast("int").alias("no"), t.alias("text"), F.get(counts, i).alias("words"), is_heading(t).alias("heading")))
    empty = F.array().cast(f"array<{_CHUNK}>")
    start = F.struct(empty.alias("done"), F.lit(1).alias("first"), F.lit(0).alias("words"), F.lit(0).alias("fresh"), F.lit("").alias("section"))

    def chunk(first, last, section, words):
        return F.array(F.struct(first.cast("int").alias("line_start"), last.cast("int").alias("line_end"), section.alias("section"), words.cast("int").alias("words")))

    def step(s: Column, r: Column) -> Column:
        closes = r["heading"] & (s["words"] >= least)
        done = F.when(closes & (s["fresh"] > 0), F.concat(s["done"], chunk(s["first"], r["no"] - 1, s["section"], s["words"]))).otherwise(s["done"])
        first = F.when(closes, r["no"]).otherwise(s["first"])
        section = F.when(r["heading"], F.trim(r["text"])).otherwise(s["section"])
        words = F.when(closes, F.lit(0)).otherwise(s["words"]) + r["words"]
        fresh = F.when(closes, F.lit(0)).otherwise(s["fresh"]) + 1
        full = words >= target
        carried_from = F.greatest(first, r["no"] - overlap + 1) if overlap else r["no"] + 1
        carried = F.aggregate(F.slice(counts, carried_from, F.greatest(r["no"] - carried_from + 1, F.lit(0))), F.lit(0), lambda a, b: a + b)
        return F.struct(
            F.when(full, F.concat(done, chunk(first, r["no"], section, words))).otherwise(done).alias("done"),
            F.when(full, carried_from).otherwise(first).cast("int").alias("first"),
            F.when(full, carried).otherwise(words).cast("int").alias("words"),
            F.when(full, F.lit(0)).otherwise(fresh).cast("int").alias("fresh"),
            section.alias("section"),
        )

    def finish(s: Column) -> Column:
        last = F.element_at(s["done"], -1)
        short = (s["words"] < least) & (F.size(s["done"]) > 0)
        joins = short & (F.try_element_at(s["done"], F.lit(-1))["line_end"] >= s["first"] - 1)
        longer = F.struct(last["line_start"].alias("line_start"), F.size(lines).alias("line_end"), F.when(last["section"] != "", last["section"]).otherwise(s["section"]).alias("section"), (last["words"] + s["words"]).alias("words"))
        merged = F.concat(F.slice(s["done"], 1, F.size(s["done"]) - 1), F.array(longer))
        return F.when(s["fresh"] == 0, s["done"]).when(joins, merged).otherwise(F.concat(s["done"], chunk(s["first"], F.size(lines), s["section"], s["words"])))

    return F.aggregate(rows, start, step, finish)


def chunks_of(docs: DataFrame, target_words: int = K.CHUNK_WORDS, overlap_lines: int = K.OVERLAP_LINES, min_words: int = K.MIN_CHUNK_WORDS) -> DataFrame:
    """chunk_id, doc_id, page_no, line_start, line_end, section, text, locator.

    The text of a chunk is exactly its lines. Documents are folded where they are read: no shuffle, and no state beyond one document.
    """
    if target_words < 10 or overlap_lines < 0:
        raise ValueError("target_words must be 10 or more and overlap_lines 0 or more")
    pages = docs.select("doc_id", F.posexplode(page_arrays(line_array(F.col("text")))).alias("page", "lines"))
    found = pages.select("doc_id", (F.col("page") + 1).alias("page_no"), "lines", F.explode(_page_chunks(F.col("lines"), target_words, overlap_lines, min_words)).alias("c"))
    text = F.array_join(F.slice("lines", F.col("c.line_start"), F.col("c.line_end") - F.col("c.line_start") + 1), " ")
    rows = found.select("doc_id", "page_no", "c.line_start", "c.line_end", "c.section", text.alias("text"))
    return rows.select(
        stable_id(F.col("doc_id"), F.col("page_no"), F.col("line_start"), F.col("line_end")).alias("chunk_id"), "*", locator(F.col("page_no"), F.col("line_start"), F.col("line_end")).alias("locator")
    )


def union_box(boxes: Column) -> Column:
    """The smallest box (x0, y0, x1, y1) around an array of boxes."""
    side = lambda name, pick: pick(F.transform(boxes, lambda b: b[name])).alias(name)
    return F.struct(side("x0", F.array_min), side("y0", F.array_min), side("x1", F.array_max), side("y1", F.array_max))


def embedding_text(name: Column, section: Column, text: Column) -> Column:
    return F.concat_ws(" | ", name, F.when(section != "", section), text)
