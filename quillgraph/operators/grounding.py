"""Is a quote in its source? Exactly first; what fails goes to windows of matching blocks."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded

THRESHOLD = 0.88


def exact(rows: DataFrame, quote: str = "quote", source: str = "source") -> DataFrame:
    """Rows with quote_exact: the folded quote is part of the folded source; false if either is blank."""
    q, s = folded(F.col(quote)), folded(F.col(source))
    return rows.withColumn("quote_exact", F.coalesce((q != "") & (s != "") & F.contains(s, q), F.lit(False)))


def windows_match(q: str, s: str, threshold: float) -> bool:
    """Some window of the quote's length, a quarter of it apart, is similar enough. A tail off the grid is not tested."""
    if not q or not s:
        return False
    size = len(q)
    starts = np.arange(0, max(1, len(s) - size + 1), max(1, size // 4))
    ends = np.minimum(starts + size, len(s))
    # a ratio is at most twice the characters in common over both lengths: counted for all windows at once
    points, common = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4"), np.zeros(len(starts))
    for c, n in Counter(q).items():
        upto = np.concatenate(([0], np.cumsum(points == ord(c))))
        common += np.minimum(upto[ends] - upto[starts], n)
    m = SequenceMatcher(None)
    m.set_seq1(q)
    for i in starts[2 * common / (size + ends - starts) >= threshold - 1e-9].tolist():
        m.set_seq2(s[i : i + size])
        if m.ratio() >= threshold:
            return True
    return False


def present(rows: DataFrame, quote: str = "quote", source: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Rows with quote_found: exact, or in some window. Python gets the texts of the rows that fail the exact test only."""
    @F.pandas_udf("boolean")
    def near(q: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([windows_match(a, b, threshold) for a, b in zip(q.fillna(""), s.fillna(""))], dtype=bool)

    tested = exact(rows, quote, source)
    missed = ~F.col("quote_exact")
    rest = near(F.when(missed, folded(F.col(quote))), F.when(missed, folded(F.col(source))))
    return tested.withColumn("quote_found", F.col("quote_exact") | rest)


def verdicts(rows: DataFrame) -> DataFrame:
    """Rows (supported, unsupported_claims, quote_found): a missing quote makes the claim unsupported and says so."""
    missing = ~F.coalesce("quote_found", F.lit(False))
    claims = F.coalesce("unsupported_claims", F.array().cast("array<string>"))
    return rows.withColumn("unsupported_claims", F.when(missing, F.array_append(claims, F.lit("supporting quote not found in source"))).otherwise(claims)).withColumn("supported", F.col("supported") & ~missing)
