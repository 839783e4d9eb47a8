"""Variants of tokens: suffix roots and English base forms, as array columns.

They depend on the token alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import small
from .lookup import Lookup
from .text import has_malayalam, let, normal

#: Suffixes that hold beside any supplied list.
CORE_SUFFIXES = ("യുടെ", "ന്റെ", "നുള്ള", "ത്തിൽ", "കളെ", "ങ്ങൾ", "ങ്ങളായി", "മായി", "പ്പെട്ടു", "നിന്റെ")


def suffix_roots(base: Column, suffixes: Sequence[str] = CORE_SUFFIXES) -> Column:
    """The form itself and what is left after one or two suffixes, sorted.

    A suffix goes only from forms over two characters longer, and at least two
    characters must be left.
    """
    known = F.array(*[F.lit(s) for s in sorted(set(suffixes))])

    def shorter(forms: Column) -> Column:
        stems = F.transform(
            forms,
            lambda f: F.transform(
                F.filter(known, lambda s: f.endswith(s) & (F.length(f) > F.length(s) + 2)),
                lambda s: normal(F.substring(f, F.lit(1), F.length(f) - F.length(s))),
            ),
        )
        return F.filter(F.flatten(stems), lambda s: F.length(s) >= 2)

    one = F.array_union(F.array(base), shorter(F.array(base)))
    return F.sort_array(F.array_union(one, shorter(one)))


def english_lemma(token: Column, lemmas: Lookup | None = None) -> Column:
    """Base form: without possessive, what the dictionary ``lemmas`` has, else by rule: -ies, -ses, -s."""
    owned = token.endswith("'s") & (F.length(token) > 3)
    base = F.when(owned, F.substring(token, F.lit(1), F.length(token) - 2)).otherwise(token)
    cut = lambda n: F.substring(base, F.lit(1), F.length(base) - n)
    by_rule = (
        F.when(base.endswith("ies") & (F.length(base) > 4), F.concat(cut(3), F.lit("y")))
        .when(base.endswith("ses") & (F.length(base) > 4), cut(2))
        .when(base.endswith("s") & ~base.endswith("ss") & (F.length(base) > 3), cut(1))
        .otherwise(base)
    )
    return F.coalesce(lemmas(base), by_rule) if lemmas else by_rule


def variants(
    token: Column, suffixes: Sequence[str] = CORE_SUFFIXES, basic: bool = False, lemmas: Lookup | None = None, normalised: bool = False
) -> Column:
    """All forms under which a token may be found, sorted: itself, suffix roots, base forms.

    Suffixes go from tokens with Malayalam letters; base forms are those of
    forms without.  ``basic``: the token alone.  ``normalised``: the token is ``normal`` already.
    """
    base = token if normalised else normal(token)
    alone = F.filter(F.array(base), lambda v: v != "")
    if basic:
        return alone

    def with_lemmas(roots: Column) -> Column:
        bases = F.transform(F.filter(roots, lambda f: ~has_malayalam(f)), lambda f: english_lemma(f, lemmas))
        return F.sort_array(F.filter(F.array_union(roots, bases), lambda v: v != ""))

    # By the rules only words in s have another base form.
    may = F.lit(True) if lemmas else base.endswith("s")
    return F.when(has_malayalam(base), let(suffix_roots(base, suffixes), with_lemmas)).when(may, with_lemmas(F.array(base))).otherwise(alone)


def with_lemmas(tokens: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """``tokens`` with ``lemma`` of ``token``: what the dictionary ``lemmas`` (``form``, ``lemma``) has, else by rule."""
    base = F.when(F.col("token").endswith("'s") & (F.length("token") > 3), F.substring("token", F.lit(1), F.length("token") - 2)).otherwise(F.col("token"))
    if lemmas is None:
        return tokens.withColumn("lemma", english_lemma(F.col("token")))
    known = small(lemmas.select(F.col("form").alias("_form"), F.col("lemma").alias("_lemma")))
    rows = tokens.join(known, base == F.col("_form"), "left")
    return rows.withColumn("lemma", F.coalesce("_lemma", english_lemma(F.col("token")))).drop("_form", "_lemma")
