"""Scalar text functions as Column expressions; all stay inside the JVM, but for the comparison of texts that are not ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .unicode import fold_punctuation

MARKER = r"\[\s*[Ss]?\s*(\d+(?:\s*[,;/]\s*[Ss]?\s*\d+)*)\s*\]"
MARKER_GROUP = r"(?:\[\s*[Ss]?\s*\d+(?:\s*[,;/]\s*[Ss]?\s*\d+)*\s*\]\s*)+"


def words_in(words: list[str]) -> Column:
    return F.array(*map(F.lit, dict.fromkeys(words)))


def tokens(text: Column) -> Column:
    """Lower-case word tokens; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(K.TOKEN), 0)


def without(found: Column, stop: list[str], longer_than: int = 0) -> Column:
    kept = F.filter(found, lambda t: ~t.isin(list(dict.fromkeys(stop))))
    return F.filter(kept, lambda t: F.length(t) > longer_than) if longer_than else kept


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), 0))


def normalise_line(text: Column) -> Column:
    """Drops soft hyphens, makes white space single spaces, and trims."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "­", ""), "[ \t\r\n ]+", " "))


def caps_ratio(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / F.greatest(letters, F.lit(1))).otherwise(F.lit(0.0))


def is_heading(text: Column) -> Column:
    """A short shouted line, or one that begins with a structural word, that does not end like a clause."""
    line = F.trim(text)
    body = F.trim(F.regexp_replace(line, r"^(?:[0-9]+(?:\.[0-9]+)*|[IVXLC]+)[.)]?\s+", ""))
    shouted = ~body.rlike(r"\p{Ll}") & body.rlike(r"\p{Lu}")
    clause_end = body.rlike("[.;,:]$") & ~shouted
    structural = body.rlike("(?i)^(?:" + "|".join(K.HEADING_WORDS) + ")")
    fits = F.length(line).between(3, 120) & F.length(body).between(1, 90)
    return F.coalesce(fits & ~clause_end & (structural | (caps_ratio(body) >= 0.6)), F.lit(False))


def normalise_for_compare(text: Column) -> Column:
    """Compatibility composition, typographic characters as ASCII, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(fold_punctuation(text)), r"\s+", " "))


def contains_phrase(text: Column, phrase: Column) -> Column:
    needle = normalise_for_compare(phrase)
    return (needle != "") & F.contains(normalise_for_compare(text), needle)


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("␟", *(p.cast("string") for p in parts)), 256), 1, 12)


def normalise_query(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    short = F.trim(F.regexp_replace(clean, r"[?!.,;: ]+$", ""))
    return F.when(short != "", short).otherwise(clean)


def parse_markers(text: Column) -> Column:
    """Distinct source numbers in order of first use."""
    groups = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MARKER), 1)
    numbers = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"\d+"), 0)))
    return F.array_distinct(F.transform(numbers, lambda n: n.cast("int")))


def strip_markers(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, MARKER, ""), r"\s{2,}", " "))


def attach_trailing_markers(text: Column) -> Column:
    """Markers behind a full stop come before it, so they stay with their sentence."""
    moved = F.regexp_replace(F.coalesce(text, F.lit("")), rf"([.!?])\s*({MARKER_GROUP})", " $2$1 ")
    return F.rtrim(F.regexp_replace(moved, r"\]\s+([.!?])", "]$1"))


def numbers(text: Column) -> Column:
    """Distinct numbers without thousands separators."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+(?:[.,]\d+)*"), 0)
    return F.array_distinct(F.transform(found, lambda n: F.regexp_replace(F.regexp_replace(n, ",", ""), r"\.+$", "")))


def ngram_features(found: Column) -> Column:
    """Tokens, adjacent pairs ``a_b``, and ``#`` with each four-character piece of tokens of six characters or more."""
    pairs = F.zip_with(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))
    long = F.filter(found, lambda t: F.length(t) >= 6)
    pieces = F.flatten(F.transform(long, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 3), lambda i: F.concat(F.lit("#"), t.substr(i, F.lit(4))))))
    return F.concat(found, pairs, pieces)


def page_range(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("p."), first)).otherwise(F.concat(F.lit("p."), first, F.lit("-"), last))


def locator(page: Column, first: Column, last: Column) -> Column:
    lines = F.when(first == last, F.concat(F.lit("L"), first)).otherwise(F.concat(F.lit("L"), first, F.lit("-"), last))
    return F.concat(F.lit("p."), page, F.lit(" "), lines)


def body_text(text: Column, section: Column) -> Column:
    """``text`` without a leading repetition of its section."""
    rest = F.regexp_replace(text.substr(F.length(section) + 1, F.length(text)), r"^[ \-–—:.]+", "")
    return F.when((section != "") & F.startswith(text, section), rest).otherwise(text)


def topic_name(raw: Column) -> Column:
    """A readable name from a heading: no enumerator or structural prefix, no shouting."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(raw, r"\s+", " ")), r"^[ \-–—:.]+|[ \-–—:.]+$", "")
    prefix = r"(?i)^(?:(?:SECTION|CLAUSE|UNIT|MODULE|CHAPTER|PART|ARTICLE|SCHEDULE|ANNEXURE)\s+)?[A-Z0-9]+(?:\.\d+)*\s*[-–—.)]\s*"
    short = F.trim(F.regexp_replace(clean, prefix, ""))
    name = F.when(short != "", short).otherwise(clean)
    return F.when(~name.rlike(r"\p{Ll}") & name.rlike(r"\p{Lu}"), F.initcap(F.lower(name))).otherwise(name)


def strip_leading_noise(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, K.LEADING_NOISE, ""))


def json_rows(reply: Column, schema: str) -> Column:
    """The array of objects in a model's reply: without code fences, from the first ``[`` to the last ``]``; an object that wraps ``questions`` or ``items`` is opened, a single object counts as an array of one."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(reply, F.lit(""))), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    inner = F.regexp_extract(clean, r"(?s)\[.*\]", 0)
    wrapped = F.coalesce(F.get_json_object(clean, "$.questions"), F.get_json_object(clean, "$.items"))
    single = F.when(clean.rlike(r"(?s)^\{.*\}$"), F.concat(F.lit("["), clean, F.lit("]")))
    chosen = F.coalesce(wrapped, F.when(clean.rlike(r"(?s)^\["), clean), single, inner)
    rows = F.from_json(chosen, f"array<struct<{schema}>>")
    rows = F.coalesce(rows, F.from_json(inner, f"array<struct<{schema}>>"), F.array().cast(f"array<struct<{schema}>>"))
    return F.filter(rows, lambda r: r.isNotNull())
