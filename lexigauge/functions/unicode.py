"""Compatibility forms (NFKC): texts of ASCII letters stay in the JVM, only others go to a worker."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())  # a type by name would need a session while this is imported
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatible(text: Column) -> Column:
    """``text`` in compatibility form: full-width, circled, ligature and other variants as plain letters, marks composed.

    A text of ASCII characters is its own form; the worker is given a null in its place. A null stays null. The column
    cannot stand inside a function of an array's elements; apply it before the keys of ``functions.text``.
    """
    other = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(_folded(other), text)
