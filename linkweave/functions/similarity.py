"""Similarity of sentences: the normalised indel ratio and its token-sorted form, from 0 to 100."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, a machine word of whose table is a column: bits of an integer."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str | None, b: str | None) -> float | None:
    """200 LCS / (len a + len b); two empty strings are alike."""
    if a is None or b is None:
        return None
    n = len(a) + len(b)
    return 100.0 if not n else 100.0 if a == b else 200.0 * lcs_length(a, b) / n


@F.pandas_udf(DoubleType())
def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def indel_ratio(a: Column, b: Column) -> Column:
    return _indel(a, b)


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.trim(c), r"(?U)\s+"), lambda x: x != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return _indel(sorted_tokens(a), sorted_tokens(b))


def ratio_bound(a: Column, b: Column) -> Column:
    """An upper bound of the ratio from the lengths alone, for filtering before the ratio itself."""
    n = F.length(a) + F.length(b)
    return F.when(n == 0, 100.0).otherwise(200.0 * F.least(F.length(a), F.length(b)) / n)
