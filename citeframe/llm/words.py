"""Fast words: lower-cased runs of characters other than white space and punctuation."""

from __future__ import annotations

import re

_PUNCTUATION = bytes(c for c in range(128) if not (chr(c).isalnum()))
_TABLE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
_OTHER = re.compile("[\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7 -⁯　-〠﻿]+")


def words(text: str) -> list[bytes]:
    """UTF-8 words of ``text``, in order. ASCII other than letters and digits, Latin-1 signs, and general and CJK punctuation separate words."""
    low = text.lower()
    if not low.isascii():
        low = _OTHER.sub(" ", low)
    return low.encode("utf-8", "surrogatepass").translate(_TABLE).split()
