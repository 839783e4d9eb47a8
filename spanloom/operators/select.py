"""Choosing among candidates: best per place, and greedily without overlap.

Candidates may have ``context``, ``other`` and ``margin`` (null or absent
without a context model).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let


def evidence(kind: Column, length: Column) -> Column:
    """Strength of a candidate's evidence."""
    return (
        F.when((kind == "exact") & (length > 1), 5)
        .when(kind == "exact", 4)
        .when(kind == "regex", 3)
        .when(kind == "fuzzy", 2)
        .when(kind == "semantic", 1)
        .when(kind == "contextual-extension", 0)
        .otherwise(-1)
    )


def with_scores(candidates: DataFrame) -> DataFrame:
    """The score columns, null where they are missing."""
    for c in ("context", "other", "margin"):
        if c not in candidates.columns:
            candidates = candidates.withColumn(c, F.lit(None).cast("double"))
    return candidates


def rank(simple: bool = False) -> Column:
    """What is largest wins: evidence, margin, context, score, early start; ``simple``: length, score, early start."""
    length = F.col("end") - F.col("start")
    if simple:
        parts = [length, F.col("score"), -F.col("start")]
    else:
        parts = [
            evidence(F.col("match_type"), length),
            F.coalesce("margin", F.lit(-1.0)),
            F.coalesce("context", F.lit(-1.0)),
            F.col("score"),
            -F.col("start"),
        ]
    return F.struct(*[p.alias(f"r{i}") for i, p in enumerate(parts)])


def best_per_span(candidates: DataFrame, simple: bool = False) -> DataFrame:
    """The best candidate of each place; of equal ones the first generated."""
    rows = with_scores(candidates).withColumn("rank", rank(simple))
    place = Window.partitionBy("row_idx", "start", "end").orderBy(F.col("rank").desc(), "gen")
    return rows.withColumn("nth", F.row_number().over(place)).where("nth = 1").drop("nth")


def _rank_of(c: Column, simple: bool, scored: bool) -> list[Column]:
    """``rank`` of a candidate as columns of which the least wins; ``scored``: it has a margin and a context."""
    length = c["end"] - c["start"]
    if simple:
        return [-length, -c["score"]]
    context = [-F.coalesce(c["margin"], F.lit(-1.0)), -F.coalesce(c["context"], F.lit(-1.0))] if scored else []
    return [-evidence(c["match_type"], length), *context, -c["score"]]


def chosen_in_row(found: Column, simple: bool = False, stop_words: bool = False, longest: int | None = None, scored: bool = False) -> Column:
    """Of an array of candidates the best of each place, then the best first without overlap, in order of places.

    Of equal ones the first in place, then the first generated wins; candidates of stop words alone never enter unless ``stop_words``.
    Candidates part into stretches that don't touch, and the choice is made within each, so work follows
    the stretches.  ``longest`` bounds the candidates' tokens; without it the longest is looked up.
    """
    ranked = lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), F.struct(*[x.alias(f"r{i}") for i, x in enumerate(_rank_of(c, simple, scored))]).alias("rank"),
        c["gen"].alias("gen"), c.alias("c"),
    )

    def first_of_place(xs: Column) -> Column:
        before = lambda i: F.get(xs, i - 1)
        same = lambda x, i: (i > 0) & (before(i)["start"] == x["start"]) & (before(i)["end"] == x["end"])
        return F.filter(xs, lambda x, i: ~F.coalesce(same(x, i), F.lit(False)))

    def greedy(xs: Column) -> Column:
        """The choice within a stretch."""
        key = lambda x: F.struct(x["rank"].alias("rank"), x["start"].alias("start"), x["gen"].alias("gen"), x["c"].alias("c"))
        inside = lambda t, c: (t["start"] < c["end"]) & (c["start"] < t["end"])
        in_order = F.transform(F.array_sort(F.transform(xs, key)), lambda x: x["c"])
        first = F.slice(in_order, 1, 1)
        taken = F.aggregate(
            F.slice(in_order, F.lit(2), F.size(xs)), first, lambda acc, c: F.when(F.exists(acc, lambda t: inside(t, c)), acc).otherwise(F.concat(acc, F.array(c)))
        )
        return F.when(F.size(xs) == 1, F.transform(xs, lambda x: x["c"])).otherwise(taken)

    def stretches(xs: Column, width: Column) -> Column:
        """No candidate of a place before reaches into the place at which a stretch begins."""
        reach = width * width
        inside = lambda x, i: F.exists(F.slice(xs, F.greatest(F.lit(1), i + 1 - reach), F.least(i, reach)), lambda y: y["end"] > x["start"])
        starts = F.filter(F.transform(xs, lambda x, i: F.when(~inside(x, i), i)), lambda i: i.isNotNull())
        ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(xs)))
        return F.zip_with(starts, ends, lambda a, b: F.slice(xs, a + 1, b - a))

    def choice(xs: Column) -> Column:
        width = F.lit(longest) if longest else F.array_max(F.transform(xs, lambda x: x["end"] - x["start"]))
        parts = lambda w: F.flatten(F.transform(stretches(xs, w), greedy))
        taken = parts(width) if longest else let(width, parts)
        return F.transform(F.array_sort(F.transform(taken, lambda c: F.struct(c["start"].alias("start"), c.alias("c")))), lambda x: x["c"])

    best = let(F.array_sort(F.transform(found, ranked)), first_of_place)
    kept = best if stop_words else F.filter(best, lambda x: ~x["c"]["filtered"])
    none = F.slice(found, F.lit(1), F.lit(0))
    return let(kept, lambda xs: F.when(F.size(xs) > 0, choice(xs)).otherwise(none))


def without_overlap(candidates: DataFrame, simple: bool = False) -> DataFrame:
    """Greedy choice per text, best rank first; candidates of stop words alone never enter.

    A text's candidates come together in one row, which its length bounds.
    """
    rows = with_scores(candidates)
    columns = [c for c in rows.columns if c != "row_idx"]
    by_text = rows.groupBy("row_idx").agg(F.collect_list(F.struct(*columns)).alias("found"))
    return by_text.select("row_idx", F.inline(chosen_in_row(F.col("found"), simple, scored=True)))


def merged(spans: DataFrame) -> DataFrame:
    """Adjacent spans of one category as one compound span."""
    by = Window.partitionBy("row_idx").orderBy("start", "end")
    new = (F.lag("end").over(by) == F.col("start")) & (F.lag("category").over(by) == F.col("category"))
    rows = with_scores(spans).withColumn("island", F.sum(F.when(F.coalesce(new, F.lit(False)), 0).otherwise(1)).over(by))
    several = F.count(F.lit(1)) > 1
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "canonical"))), lambda x: x["canonical"])
    return rows.groupBy("row_idx", "island").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.first("category").alias("category"),
        F.array_join(parts, " ").alias("canonical"),
        F.min("score").alias("score"),
        F.when(several, "compound").otherwise(F.first("match_type")).alias("match_type"),
        F.bool_or("is_trigger").alias("is_trigger"),
        F.avg("context").alias("context"),
    ).drop("island")
