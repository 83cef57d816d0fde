"""Located lines: the unit that every citation points to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeframe.functions import constants as K
from citeframe.functions.text import normalise_line


def line_array(text: Column) -> Column:
    """The non-empty normalised lines of a text."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), normalise_line), lambda t: t != "")


def page_arrays(lines: Column, page_lines: int = K.PAGE_LINES) -> Column:
    """Consecutive pages of ``page_lines`` lines."""
    pages = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / page_lines).cast("int"))
    return F.when(F.size(lines) > 0, F.transform(pages, lambda p: F.slice(lines, p * page_lines + 1, page_lines))).otherwise(F.array().cast("array<array<string>>"))


def lines_of(docs: DataFrame, page_lines: int = K.PAGE_LINES) -> DataFrame:
    """doc_id, page_no, line_no, text. Numbering happens within the row, so nothing is shuffled."""
    rows = docs.select("doc_id", F.posexplode(line_array(F.col("text"))).alias("at", "text"))
    return rows.select("doc_id", (F.floor(F.col("at") / page_lines) + 1).cast("int").alias("page_no"), (F.col("at") % page_lines + 1).cast("int").alias("line_no"), "text")


def html_text(html: Column) -> Column:
    """Visible text of a page: no scripts, styles, comments or tags; block tags end a line."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    broken = F.regexp_replace(bare, r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|br|tr|table|article|nav|title|head|header|footer|section)[^>]*>", "\n")
    plain = F.regexp_replace(broken, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return plain


def html_lines(pages: DataFrame) -> DataFrame:
    """Lines of HTML pages with the first heading as their section."""
    heading = F.trim(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    rows = pages.select("page_id", heading.alias("section"), F.posexplode(line_array(html_text(F.col("html")))).alias("at", "text"))
    return rows.select("page_id", "section", (F.col("at") + 1).cast("int").alias("line_no"), "text")


def text_files(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """One row for each file below ``folder``: doc_id, name, path, sha256, text, error. A file that cannot be a text gives a row with an error instead of ending the batch."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"[^/]+$", 0)
    digest = F.sha2("content", 256)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    doc_id = F.substring(F.sha2(F.concat_ws("␟", name, digest), 256), 1, 12)
    error = F.when(text.isNull(), F.lit("not a UTF-8 text")).when(F.trim(text) == "", F.lit("no extractable text"))
    return files.select(doc_id.alias("doc_id"), name.alias("name"), "path", digest.alias("sha256"), text.alias("text"), error.alias("error"))


def positioned_lines(spans: DataFrame) -> DataFrame:
    """Lines from positioned text objects (doc_id, page_no, ord, text, x0, y0, x1, y1): reading order, numbering, and row_span, the number of objects on the same baseline."""
    rows = spans.withColumn("text", normalise_line(F.col("text"))).where("text <> ''")
    reading = Window.partitionBy("doc_id", "page_no").orderBy(F.bround(F.col("y0") / 2.5), "x0", "ord")
    baseline = Window.partitionBy("doc_id", "page_no", F.bround(F.col("y1") / 4.0))
    return rows.withColumn("line_no", F.row_number().over(reading)).withColumn("row_span", F.count("*").over(baseline).cast("int"))
