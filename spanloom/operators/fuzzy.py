"""Words like the words of a lexicon: a similarity join by an inverted index, with an upper bound before the ratio.

The ratio of two words is at most twice the number of characters they share, each as often as
in both, by the sum of their lengths.  So words that pass share, beside their first character, one of the
first few characters of each in a common order (rarer ones first); the index has only those.  Pairs that meet there
are held against the bound by the lengths and by all characters, and what is left goes to
the ratio itself, once per distinct pair of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import small
from ..functions.similarity import fuzzy_allowed, needed, sequence_ratio
from ..functions.text import has_malayalam


def bag(c: Column) -> Column:
    """The characters after the first, each with how often it was there before: second and third ones, which are rarer, first."""
    rest = F.when(F.length(c) > 1, F.split(F.substring(c, F.lit(2), F.length(c)), "")).otherwise(F.array().cast("array<string>"))
    nth = lambda x, i: F.size(F.filter(F.slice(rest, F.lit(1), i), lambda y: y == x))
    return F.sort_array(F.transform(rest, lambda x, i: F.concat(F.lpad(nth(x, i).cast("string"), 4, "0"), x)), asc=False)


def _keyed(words: DataFrame, name: str, cutoff: float) -> DataFrame:
    """Distinct words with script, first character, bag, and ``key``: a row for each character of the index."""
    c = F.col(name)
    rows = words.select(c.alias(name), has_malayalam(c).alias("script"), F.substring(c, 1, 1).alias("initial"), bag(c).alias(f"{name}_bag"))
    # Characters that a word shares at least with what passes, by the least length that can.
    least = F.ceil(F.length(c) * (cutoff / (2 - cutoff)) - 1e-9)
    first = F.slice(f"{name}_bag", F.lit(1), F.greatest(F.lit(0), F.least(F.size(f"{name}_bag"), (F.length(c) - least + 1).cast("int"))))
    keys = F.when(least <= 1, F.concat(first, F.array(F.lit("")))).otherwise(first)
    return rows.select("*", F.explode(keys).alias("key"))


def similar(forms: DataFrame, words: DataFrame, cutoff: float) -> DataFrame:
    """``form, word, score`` of the distinct pairs of ``forms`` (``form``) and ``words`` (``word``), not equal, that pass the gate.

    Pairs have one script and first character.  The index of the words is broadcast if it is small.
    """
    forms = forms.select("form").where("form <> ''").distinct()
    words = words.select("word").where("word <> ''").distinct()
    met = _keyed(forms, "form", cutoff).join(small(_keyed(words, "word", cutoff)), ["script", "initial", "key"])
    a, b = F.length("form"), F.length("word")
    short = needed(a, b, cutoff)
    shared = 1 + F.size(F.array_intersect("form_bag", "word_bag"))
    may = met.where((F.col("form") != F.col("word")) & (2 * F.least(a, b) >= (a + b) * (short - 1e-9))).where(2 * shared >= (a + b) * (short - 1e-9))
    pairs = may.select("form", "word").distinct().withColumn("score", sequence_ratio("form", "word"))
    return pairs.where(fuzzy_allowed(F.col("form"), F.col("word"), F.col("score"), cutoff))


def similar_entries(forms: DataFrame, entries: DataFrame, cutoff: float) -> DataFrame:
    """``form, ord, category, norm, is_trigger, word, score`` of the one-word entries that forms are like."""
    words = entries.where(~F.col("is_regex") & (F.size("tokens") == 1)).select("ord", "category", "norm", "is_trigger", F.col("tokens")[0].alias("word"))
    return similar(forms, words, cutoff).join(small(words), "word").select("form", "ord", "category", "norm", "is_trigger", "word", "score")
