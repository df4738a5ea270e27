"""Structural comparison of responses."""


import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def difference(a, b, path: str = "$") -> str | None:
    """The path and kind of the first difference of two JSON values, keys in order."""
    if type(a) is not type(b) and not (isinstance(a, int | float) and isinstance(b, int | float) and not isinstance(a, bool) and not isinstance(b, bool)):
        return f"{path}: type"
    if isinstance(a, dict):
        for k in sorted(a.keys() | b.keys()):
            if k not in a or k not in b:
                return f"{path}.{k}: {'added' if k not in a else 'missing'}"
            if found := difference(a[k], b[k], f"{path}.{k}"):
                return found
        return None
    if isinstance(a, list):
        for k, (x, y) in enumerate(zip(a, b, strict=False)):
            if found := difference(x, y, f"{path}[{k}]"):
                return found
        return None if len(a) == len(b) else f"{path}: length"
    return None if a == b else f"{path}: value"


def _parsed(text: str | None):
    try:
        return json.loads(text or "null")
    except ValueError:
        return " ".join((text or "").split())


@F.pandas_udf(T.StringType())
def first_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null where two JSON texts (or texts, blanks squeezed) agree."""
    return pd.Series([difference(_parsed(x), _parsed(y)) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def canonical(text: pd.Series) -> pd.Series:
    return text.map(lambda x: json.dumps(_parsed(x), sort_keys=True, separators=(",", ":")))
