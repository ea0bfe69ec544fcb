"""Evaluation of search results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: a row of the table is one large integer, made from the row before by an addition.

    A bit is 0 where the length grows along the longer text; the shorter one gives the rows.
    """
    if len(a) > len(b):
        a, b = b, a
    if a == b or not a:
        return len(a)
    codes = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    places = {c: int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little") for c in set(a)}
    whole = (1 << len(b)) - 1
    row = whole
    for c in a:
        if found := row & places[c]:
            row = (row + found | row - found) & whole
    return len(b) - row.bit_count()


def lcs_distance(a: str | None, b: str | None) -> float:
    """1 - LCS / length of the shorter text; 1 if either is empty."""
    if not a or not b:
        return 1.0
    return 1.0 - lcs_length(a, b) / min(len(a), len(b))


@F.pandas_udf(DoubleType())
def lcs_distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_distance(x, y) for x, y in zip(a, b)], dtype=float)


def best_distance(pairs: DataFrame, by: str = "qid", distance: str = "distance") -> DataFrame:
    """The smallest distance among a query's results."""
    return pairs.groupBy(by).agg(F.min(distance).alias("distance"))


def success_rate(best: DataFrame, threshold: float = 0.33) -> DataFrame:
    """One row: the share of queries whose best result is nearer than the threshold."""
    return best.agg(F.avg((F.col("distance") < threshold).cast("double")).alias("success"))
