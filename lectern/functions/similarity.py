"""Sequence similarity: the ratio of matching blocks, in the order of the arguments."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

NEAR = 0.82


def _ratio(a: str, b: str, least: float) -> float | None:
    """The ratio, or null where bounds show that it is below ``least``."""
    total = len(a) + len(b)
    if total and 2 * min(len(a), len(b)) / total < least:
        return None
    if total and 2 * sum((Counter(a) & Counter(b)).values()) / total < least:
        return None
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


@F.pandas_udf(DoubleType())
def _near_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([_ratio(a, b, NEAR) if a is not None and b is not None else None for a, b in zip(left, right, strict=True)], dtype="float64")


#: The ratio where it can reach NEAR, else null; both bounds lose no such pair.  A filter on it is not worked out twice.
near_ratio = _near_ratio.asNondeterministic()
