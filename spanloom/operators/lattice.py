"""Phrases of a lexicon in tokens that have several forms each, without trying all combinations of forms.

The lexicon is a table of prefixes: each phrase's first word, first two words, and so on,
with the entries that end there and whether any goes on.  From every token the prefixes are
walked over the forms of the tokens that follow; what is no prefix ends at once, so the
work follows the matches, however many combinations there are, and none is left out.

``in_row`` walks within a text's row, by a table that expressions look up.  ``joined``
does the same by joins, a step for each further word, for lexicons of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import small
from ..functions.lookup import Lookup
from ..functions.text import let

ENTRY = "struct<ord:bigint,category:string,norm:string,is_trigger:boolean>"


def prefixes(entries: DataFrame, longest: int) -> DataFrame:
    """``phrase, found``: of every prefix of the literal entries of up to ``longest`` words whether one goes on (``more``), and the ``entries`` it is."""
    literal = entries.where(~F.col("is_regex") & F.size("tokens").between(1, longest))
    each = literal.select(
        "ord", "category", "norm", "is_trigger", "tokens", F.explode(F.sequence(F.lit(1), F.size("tokens"))).alias("n")
    )
    entry = F.when(F.col("n") == F.size("tokens"), F.struct("ord", "category", "norm", "is_trigger"))
    by = each.groupBy(F.array_join(F.slice("tokens", F.lit(1), F.col("n")), " ").alias("phrase")).agg(
        F.bool_or(F.col("n") < F.size("tokens")).alias("more"), F.sort_array(F.collect_list(entry)).cast(f"array<{ENTRY}>").alias("entries")
    )
    return by.select("phrase", F.struct("more", "entries").alias("found"))


def in_row(forms: Column, table: Lookup, longest: int) -> Column:
    """Hits as ``array<struct<start, n, place, phrase, found>>``; ``place`` is the combination's number among all of the window."""

    def hits(phrases: Column, start: Column, n: int, before: Column, many: Column) -> Column:
        one = lambda p, i, found: F.struct(start.alias("start"), F.lit(n).alias("n"), (before * many + i).alias("place"), p.alias("phrase"), found.alias("found"))
        met = lambda p, i: let(table(p), lambda found: F.when(found.isNotNull(), one(p, i, found)))
        return F.array_compact(F.transform(phrases, met))

    first = F.flatten(F.transform(forms, lambda fs, i: hits(fs, i, 1, F.lit(0).cast("long"), F.lit(0).cast("long"))))

    def further(found: Column, n: int) -> Column:
        def on(h: Column) -> Column:
            fs = F.get(forms, h["start"] + n)
            return hits(F.transform(fs, lambda f: F.concat(h["phrase"], F.lit(" "), f)), h["start"], n + 1, h["place"], F.size(fs).cast("long"))

        going = F.filter(found, lambda h: h["found"]["more"] & (h["start"] + n < F.size(forms)))
        return F.flatten(F.transform(going, on))

    def all_from(found: Column, n: int) -> Column:
        return found if n == longest else let(found, lambda x: F.concat(x, all_from(further(x, n), n + 1)))

    return all_from(first, 1)


def joined(analysed: DataFrame, entries: DataFrame, longest: int, carried: Column | None = None) -> DataFrame:
    """``row_idx, start, n, place, phrase, found, around``: hits by joins with the prefixes, which are broadcast if they are few.

    A row is a place with the forms of the tokens that follow; each step joins the phrases of one word more, and
    hits that are there already pass.  ``carried``: of a place, what is to go along.
    """
    known = prefixes(entries, longest)
    known = small(known)
    place = F.sequence(F.lit(0), F.size("forms") - 1)
    around = carried if carried is not None else F.lit(0)
    rows = analysed.where(F.size("forms") > 0).select("row_idx", F.explode(place).alias("start"), "*").select(
        "row_idx", "start", F.slice("forms", F.col("start") + 1, F.lit(longest)).alias("ahead"), around.alias("around")
    )
    rows = rows.select("row_idx", "start", "ahead", "around", F.lit(1).alias("n"), F.posexplode(F.get("ahead", F.lit(0))).alias("place", "phrase"))
    rows = rows.withColumn("place", F.col("place").cast("long")).join(known, "phrase")
    for n in range(1, longest):
        fs, going = F.get("ahead", F.lit(n)), F.col("more") & (F.size("ahead") > n) & (F.col("n") == n)
        step = lambda f, i: F.struct(F.lit(n + 1).alias("n"), (F.col("place") * F.size(fs) + i).alias("place"), F.concat("phrase", F.lit(" "), f).alias("phrase"), F.lit(False).alias("done"))  # noqa: E731, B023
        here = F.array(F.struct("n", "place", "phrase", F.lit(True).alias("done")))
        steps = F.when(going, F.concat(here, F.transform(fs, step))).otherwise(here)
        rows = rows.withColumns({"more": F.col("found.more"), "old": F.col("found")}).drop("found")
        rows = rows.select("row_idx", "start", "ahead", "around", "old", F.inline(steps))
        # Hits that are there already meet no prefix; their key is the place, so they are dealt out evenly.
        key = F.when(F.col("done"), F.concat(F.lit("\n"), F.col("row_idx").cast("string"), F.lit(" "), F.col("start").cast("string"))).otherwise(F.col("phrase"))
        further = known.select(F.col("phrase").alias("key"), F.col("found").alias("next"))
        rows = rows.withColumn("key", key).join(further, "key", "left").where("done or next is not null")
        rows = rows.select("row_idx", "start", "ahead", "around", "n", "place", "phrase", F.when(F.col("done"), F.col("old")).otherwise(F.col("next")).alias("found"))
    return rows.drop("ahead")
