"""Character references of markup, which need the standard library's table and so go through Arrow batches."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Texts with all named and numeric references resolved."""
    return texts.map(lambda t: html.unescape(t) if isinstance(t, str) and "&" in t else t)
