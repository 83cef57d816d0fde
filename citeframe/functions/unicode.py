"""Typographic folding, and the one text function that has no built-in form: compatibility composition."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as K


def fold_ascii(text: Column) -> Column:
    """Typographic dashes, quotes and spaces as ASCII."""
    out = F.translate(F.coalesce(text, F.lit("")), K.DASHES + K.APOSTROPHES + K.QUOTES + K.SPACES + K.DELETED, "-" * len(K.DASHES) + "'" * len(K.APOSTROPHES) + '"' * len(K.QUOTES) + " " * len(K.SPACES))
    return F.replace(out, F.lit("…"), F.lit("..."))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def fold_punctuation(text: Column) -> Column:
    """NFKC, then typographic characters as ASCII. Only texts that are not ASCII travel to Python."""
    return fold_ascii(F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text))
