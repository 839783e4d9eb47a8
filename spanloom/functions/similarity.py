"""Similarity of tokens to lexicon words."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_malayalam


def sequence_ratio(a: Column | str, b: Column | str) -> Column:
    """Twice the matched characters by the lengths' sum; the order of arguments matters.

    Use it on distinct pairs: it is the one step here that needs Python.
    """

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)

    return F.pandas_udf(run, "double")(a, b)


def needed(a: Column, b: Column, cutoff: float) -> Column:
    """The ratio that words of two lengths need."""
    short = F.least(a, b)
    return F.when(short <= 3, max(cutoff, 0.90)).when(short <= 5, max(cutoff, 0.80)).otherwise(cutoff)


def fuzzy_allowed(variant: Column, target: Column, ratio: Column, cutoff: float) -> Column:
    """Whether a ratio suffices: shorter words need more, words of one script the same first character,
    and lengths may differ by two or two fifths."""
    long = F.greatest(F.length(variant), F.length(target))
    need = needed(F.length(variant), F.length(target), cutoff)
    same_script = has_malayalam(variant) == has_malayalam(target)
    first = F.substring(variant, 1, 1) == F.substring(target, 1, 1)
    apart = F.abs(F.length(variant) - F.length(target)) <= F.greatest(F.lit(2), F.round(long * 0.4).cast("int"))
    return (variant != "") & (ratio >= need) & (~same_script | first) & apart
