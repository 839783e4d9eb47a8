"""Candidate spans of a lexicon in tokenised texts, by joins: exact, fuzzy and by pattern.

This is the way for lexicons too large for ``matcher``, which finds the same.
A tokenised text is one row, ``row_idx, tokens``; what leaves it is a place with the few tokens around it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import small
from ..functions.lookup import Lookup
from ..functions.morphology import CORE_SUFFIXES, variants
from ..functions.text import normal
from . import lattice, patterns
from .fuzzy import similar_entries

#: Tokens of the longest window.
LONGEST = 4
# Words beside which a bare number is a size or a price.
MEMORY_WORDS = ("gb", "mb", "kb", "tb", "ജിബി", "ram", "storage", "memory")
PRICE_WORDS = (
    "₹", "rs", "rs.", "inr", "rupee", "rupees", "price", "rate", "വില",
    "k", "l", "thousand", "thousnd", "thusnd", "thousandrupees",
)
NUMBER = "^\\p{Nd}+(?:\\.\\p{Nd}+)?$"
NUMBER_OR_K = "^\\p{Nd}+(?:\\.\\p{Nd}+)?[kKK]$"
COLUMNS = ["row_idx", "start", "end", "category", "canonical", "score", "match_type", "is_trigger", "filtered", "gen"]


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed once per row.

    Otherwise the planner puts their expressions into those that use them, also
    into functions on arrays, which would compute them for every element.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def analysed(
    texts: DataFrame, stop: Sequence[str] = (), suffixes: Sequence[str] = CORE_SUFFIXES, basic: bool = False, lemmas: Lookup | None = None
) -> DataFrame:
    """``row_idx, tokens, forms, norms, stops``: each token's variants, normal form, and whether one of them is a stop word."""
    texts = settled(texts.select("row_idx", "tokens"))
    out = settled(texts.withColumn("norms", F.transform("tokens", normal)))
    out = settled(out.withColumn("forms", F.transform("norms", lambda t: variants(t, suffixes, basic, lemmas, normalised=True))))
    if not stop:
        return out.withColumn("stops", F.transform("tokens", lambda _: F.lit(False)))
    found = F.array_intersect(F.flatten("forms"), F.array(*[F.lit(w) for w in sorted(set(stop))]))
    out = settled(out.withColumn("found", found))
    return out.withColumn("stops", F.transform("forms", lambda f: F.arrays_overlap(f, F.col("found")))).drop("found")


def number_allowed(category: Column, is_number: Column, by_memory: Column, by_price: Column) -> Column:
    """A bare number is no phone; it is a memory size or a price only beside such words."""
    return ~is_number | F.when(category == "phone", False).when(category == "memory", by_memory).when(
        category == "price", by_price
    ).otherwise(True)


def phone_allowed(category: Column, surface: Column) -> Column:
    """No phone is a number, or a number with a k."""
    return ~((category == "phone") & (surface.rlike(NUMBER) | surface.rlike(NUMBER_OR_K)))


def _described(rows: DataFrame) -> DataFrame:
    """Rows with ``row_idx, start, n, around``: ``end, surface, filtered, is_number, by_memory, by_price`` in place of ``n`` and ``around``."""
    at, norms = F.col("around.at"), F.col("around.norms")

    def beside(words: Sequence[str], radius: int) -> Column:
        left = F.greatest(F.lit(0), at - radius)
        return F.arrays_overlap(F.slice(norms, left + 1, at + F.col("n") + radius - left), F.array(*[F.lit(w) for w in words]))

    surface = F.array_join(F.slice(norms, at + 1, F.col("n")), " ")
    return rows.withColumns({
        "end": F.col("start") + F.col("n"), "surface": surface, "filtered": F.forall(F.slice("around.stops", at + 1, F.col("n")), lambda s: s),
        "is_number": (F.col("n") == 1) & surface.rlike(NUMBER), "by_memory": beside(MEMORY_WORDS, 1), "by_price": beside(PRICE_WORDS, 2),
    }).drop("around")


def exact(analysed: DataFrame, entries: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Windows one of whose phrases, over all forms of their tokens, is an entry."""
    hits = lattice.joined(analysed, entries, longest, patterns.around(F.col("start"), 2, longest + 1))
    hits = _described(hits.where(F.size("found.entries") > 0)).select("*", F.inline("found.entries"))
    gen = F.struct(F.lit(0).alias("a"), (-F.col("n")).alias("b"), F.col("start").alias("c"), F.col("place").alias("d"), F.col("ord").alias("e"))
    return _candidates(hits, F.lit(1.0), "exact", F.col("norm"), gen)


def by_pattern(analysed: DataFrame, entries: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Windows that a pattern matches whole, whatever the case; what is no pattern finds nothing."""
    rows = _described(patterns.joined(analysed, entries, longest)).select("*", "entry.ord", "entry.category", "entry.norm", "entry.is_trigger")
    gen = F.struct(F.lit(2).alias("a"), F.col("ord").cast("int").alias("b"), (-F.col("n")).alias("c"), F.col("start").cast("long").alias("d"), F.col("ord").alias("e"))
    return _candidates(rows, F.lit(1.0), "regex", F.col("surface"), gen)


def fuzzy(analysed: DataFrame, entries: DataFrame, cutoff: float = 0.75) -> DataFrame:
    """Single tokens like a one-word entry of the same script and first character.

    The ratio is taken once per distinct pair of form and word that may pass; of a token's
    forms that pass the gate the best counts; a token that is an entry
    exactly is no fuzzy candidate for it.
    """
    place = F.explode(F.sequence(F.lit(0), F.size("forms") - 1)).alias("start")
    rows = analysed.where(F.size("forms") > 0).select("row_idx", place, "*")
    rows = rows.select("row_idx", "start", F.lit(1).alias("n"), patterns.around(F.col("start"), 2, 2).alias("around"), F.get("forms", F.col("start")).alias("forms"))
    rows = rows.select("*", F.explode("forms").alias("form"))
    pairs = similar_entries(rows.select("form").distinct(), entries, cutoff)
    hit = rows.join(small(pairs), "form").where(~F.array_contains(F.col("forms"), F.col("word")))
    best = _described(hit.groupBy("row_idx", "start", "ord").agg(F.max("score").alias("score"), *[F.any_value(c).alias(c) for c in ("n", "around", "category", "norm", "is_trigger")]))
    gen = F.struct(F.lit(1).alias("a"), F.col("start").alias("b"), F.lit(0).alias("c"), F.lit(0).cast("long").alias("d"), F.col("ord").alias("e"))
    return _candidates(best, F.col("score"), "fuzzy", F.col("norm"), gen)


def _candidates(hits: DataFrame, score: Column, kind: str, canonical: Column, gen: Column) -> DataFrame:
    """Allowed hits as candidates, each place, category and form once, as first generated."""
    allowed = number_allowed(F.col("category"), F.col("is_number"), F.col("by_memory"), F.col("by_price"))
    rows = hits.where(allowed).withColumn("gen", gen)
    first = rows.groupBy("row_idx", "start", "end", "category", "norm").agg(
        *[F.min_by(c, "gen").alias(n) for c, n in ((canonical, "canonical"), (score, "score"), (F.col("is_trigger"), "is_trigger"), (F.col("filtered"), "filtered"))],
        F.min("gen").alias("gen"),
    )
    return first.withColumn("match_type", F.lit(kind)).select(*COLUMNS)


def candidates(
    analysed: DataFrame, entries: DataFrame, kinds: Sequence[str] = ("exact", "fuzzy", "regex"), cutoff: float = 0.75, longest: int = LONGEST
) -> DataFrame:
    """All candidates of the given kinds, by joins with the lexicon; kinds that are off aren't planned.

    Small lexicons are matched without a join (see ``matcher``).
    """
    parts = []
    if "exact" in kinds:
        parts.append(exact(analysed, entries, longest))
    if "fuzzy" in kinds:
        parts.append(fuzzy(analysed, entries, cutoff))
    if "regex" in kinds:
        parts.append(by_pattern(analysed, entries, longest))
    return reduce(DataFrame.unionByName, parts)


def numbers(texts: DataFrame) -> DataFrame:
    """``row_idx, start, surface, by_memory, by_price`` of tokens that are numbers, with whether such words are beside."""
    place = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: (i >= 0) & F.get("tokens", i).rlike(NUMBER))
    rows = texts.where(F.size("tokens") > 0).select("row_idx", "tokens", F.explode(place).alias("start"))

    def beside(words: Sequence[str], radius: int) -> Column:
        left = F.greatest(F.lit(0), F.col("start") - radius)
        part = F.slice("tokens", left + 1, F.col("start") + 1 + radius - left)
        return F.arrays_overlap(F.transform(part, normal), F.array(*[F.lit(w) for w in words]))

    return rows.select("row_idx", "start", normal(F.get("tokens", F.col("start"))).alias("surface"), beside(MEMORY_WORDS, 1).alias("by_memory"), beside(PRICE_WORDS, 2).alias("by_price"))


def guarded(candidates: DataFrame, analysed: DataFrame | None = None) -> DataFrame:
    """Candidates without phones that are numbers; the surface is that of the span."""
    if analysed is None:
        return candidates.where(phone_allowed(F.col("category"), F.col("canonical")))
    rows = candidates.where("category = 'phone'").join(analysed.select("row_idx", "norms"), "row_idx")
    surface = F.array_join(F.slice("norms", F.col("start") + 1, F.col("end") - F.col("start")), " ")
    phones = rows.where(phone_allowed(F.col("category"), surface)).select(*candidates.columns)
    return candidates.where("category <> 'phone'").unionByName(phones)
