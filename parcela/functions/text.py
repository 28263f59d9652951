"""Cleaning of free text and keys for comparing names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of name keys.
ACCENTED, PLAIN = "áàäâéèëêíìïîóòöôúùüûñ", "aaaaeeeeiiiioooouuuun"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode's compatibility composition, which Spark has no function for. ASCII is composed already."""
    return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def clean(c: Column) -> Column:
    """NFKC, runs of white space to one blank, trimmed, empty to null."""
    return F.nullif(F.trim(F.regexp_replace(nfkc(c), r"\s+", " ")), F.lit(""))


def joined(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(". ", *parts), F.lit(""))


def name_key(c: Column) -> Column:
    """Lower case, without accents, single blanks."""
    return F.regexp_replace(F.translate(F.lower(F.trim(c)), ACCENTED, PLAIN), r"\s+", " ")
