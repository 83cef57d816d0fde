"""Sentence splitting without Python, linear in the length of a text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

_CUT = "\u0001"


def _unfinished(piece: Column) -> Column:
    """True where a piece ends in an abbreviation, an initial or an enumerator, so the next piece belongs to it."""
    word = F.regexp_replace(F.lower(F.regexp_extract(piece, r"([^\s(\[]*)\.$", 1)), "^[.,;:\"']+|[.,;:\"']+$", "")
    return F.endswith(piece, F.lit(".")) & (word != "") & (word.isin(K.ABBREVIATIONS) | word.rlike(r"^\p{L}$") | word.rlike(r"^\d+$"))


def split_sentences(text: Column, min_chars: int = 3) -> Column:
    """Sentences of ``text``: cut behind ``. ! ?`` (closing quotes and brackets go with the cut), rejoined after abbreviations, then cut at bullets."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    pieces = F.split(F.regexp_replace(clean, r"([.!?])[\"')\]]*\s+", "$1" + _CUT), _CUT)
    whole = F.split(F.array_join(F.transform(pieces, lambda p: F.concat(p, F.when(_unfinished(p), F.lit(" ")).otherwise(F.lit(_CUT)))), ""), _CUT)
    bullets = rf"(?:^|\s)[{re.escape(K.BULLETS)}]\s+"
    parts = F.flatten(F.transform(whole, lambda s: F.split(s, bullets)))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) >= min_chars)
