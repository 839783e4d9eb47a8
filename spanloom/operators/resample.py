"""Resampling tests over reviews: bootstrap intervals, randomization and an exact sign test.

Draws come from a hash of seed, draw and place, so a plan repeats them without
state and SQL can say the same.  Reviews are reduced to their counts first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import small
from ..functions.ordering import numbered
from ..functions.ratios import f1

PAIR = ["tp_a", "fp_a", "fn_a", "tp_b", "fp_b", "fn_b"]


def draw_number(seed: int, draw: Column, place: Column) -> Column:
    """A number from 0 to 2**32 - 1, fixed by its arguments."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), place.cast("string"))), 1, 8), 16, 10).cast("long")


def paired_counts(a: DataFrame, b: DataFrame, rows: DataFrame) -> DataFrame:
    """``place`` (0 on, by ``row_idx``) and the counts of two systems for every review of ``rows``."""
    out = rows.select("row_idx").join(a.select("row_idx", *[F.col(c).alias(f"{c}_a") for c in ("tp", "fp", "fn")]), "row_idx", "left")
    out = out.join(b.select("row_idx", *[F.col(c).alias(f"{c}_b") for c in ("tp", "fp", "fn")]), "row_idx", "left").fillna(0)
    return numbered(out, "place", F.col("row_idx")).select("place", *PAIR)


def picks(places: DataFrame, draws: int, seed: int = 42) -> DataFrame:
    """``draw, place``: for each draw as many places, with repeats, as ``places`` (``place`` from 0 on) has rows.

    Every row of ``places`` makes one pick of each draw, where it stands.
    """
    n = places.count()
    rows = places.select(F.col("place").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    return rows.select("draw", F.pmod(draw_number(seed, F.col("draw"), F.col("slot")), F.lit(max(n, 1))).alias("place"))


def bootstrap_deltas(counts: DataFrame, draws: int, seed: int = 42) -> DataFrame:
    """``draw, delta``: the difference in F1 on reviews drawn with replacement."""
    rows = picks(counts.select("place"), draws, seed).join(small(counts), "place")
    return rows.groupBy("draw").agg(*[F.sum(c).alias(c) for c in PAIR]).select("draw", (_f1("a") - _f1("b")).alias("delta"))


def drawn_cells(groups: DataFrame, cells: str, draws: int, seed: int = 42) -> DataFrame:
    """``draw`` and the sums of ``n`` by cell over groups drawn with replacement.

    ``groups`` has ``place`` (0 on) and ``cells``, an array of structs of which ``n`` is summed and the other fields name the cell.
    A group's cells come to its picks, so sums are partial where the picks are made and what moves is draws x cells a task.
    """
    names = [f.name for f in groups.schema[cells].dataType.elementType if f.name != "n"]
    rows = picks(groups.select("place"), draws, seed).join(small(groups.select("place", cells)), "place")
    return rows.select("draw", F.inline(cells)).groupBy("draw", *names).agg(F.sum("n").alias("n"))


def _f1(side: str) -> Column:
    return f1(*[F.col(f"{c}_{side}") for c in ("tp", "fp", "fn")])


def interval(draws: DataFrame, value: str = "delta", level: float = 0.95) -> DataFrame:
    """One row: ``mean, low, high`` by linear percentiles."""
    side = (1 - level) / 2
    return draws.agg(F.avg(value).alias("mean"), F.percentile(value, side).alias("low"), F.percentile(value, 1 - side).alias("high"))


def randomization(counts: DataFrame, draws: int, seed: int = 42, tolerance: float = 1e-12) -> DataFrame:
    """One row: ``observed, two_sided, one_sided``; reviews change sides by a bit, and one is added to each count."""
    # Draw -1 changes nothing: it is what was observed.  Sums are partial where the reviews stand.
    rows = counts.select("place", *PAIR, F.explode(F.sequence(F.lit(-1), F.lit(draws - 1))).alias("draw"))
    swap = (F.col("draw") >= 0) & (draw_number(seed, F.col("draw"), F.col("place")) % 2 == 1)
    put = []
    for c in ("tp", "fp", "fn"):
        put.append(F.sum(F.when(swap, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a"))).alias(f"{c}_a"))
        put.append(F.sum(F.when(swap, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))).alias(f"{c}_b"))
    deltas = rows.groupBy("draw").agg(*put).select("draw", (_f1("a") - _f1("b")).alias("delta"))
    # One row of one number a draw.
    one = deltas.agg(F.max(F.when(F.col("draw") < 0, F.col("delta"))).alias("observed"), F.collect_list(F.when(F.col("draw") >= 0, F.col("delta"))).alias("deltas"))
    far = F.filter("deltas", lambda d: F.abs(d) >= F.abs(F.col("observed")) - tolerance)
    above = F.filter("deltas", lambda d: d >= F.col("observed") - tolerance)
    p = lambda found: (F.size(found) + 1) / F.lit(draws + 1)
    return one.select("observed", p(far).alias("two_sided"), p(above).alias("one_sided"))


#: Differences whose signs can be flipped in all ways exactly: 2 ** MOST_FLIPS is below 10 ** 38.
MOST_FLIPS = 126


def sign_flip(differences: DataFrame, column: str = "difference") -> DataFrame:
    """One row, ``observed, reviews, p``: ``exact_sign_flip`` of a column of whole numbers, as a fold over the ones that aren't 0.

    The fold carries how many ways lead to each sum, as an array of decimals.  Nulls count as 0.
    Fails where over ``MOST_FLIPS`` differ, as the ways then are no longer exact; use ``randomization`` there.
    """
    d = F.coalesce(F.col(column).cast("long"), F.lit(0).cast("long"))
    one = differences.agg(F.coalesce(F.sum(d), F.lit(0)).alias("observed"), F.count(F.when(d != 0, 1)).alias("reviews"))
    ok = F.assert_true(F.col("reviews") <= MOST_FLIPS, F.lit(f"over {MOST_FLIPS} differences: flips can't be counted exactly"))
    one = one.select("observed", "reviews", ok.alias("ok")).where("ok is null").drop("ok")
    # The check is of the same rows, so what is gathered is MOST_FLIPS numbers at most.
    sizes = differences.select(F.abs(d).alias("d")).where("d != 0").limit(MOST_FLIPS + 1).agg(F.collect_list("d").alias("sizes"))
    row = one.join(F.broadcast(sizes)).withColumn("reach", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))
    none, many = F.lit(0).cast("decimal(38,0)"), "array<decimal(38,0)>"
    at = lambda ways, i: F.coalesce(F.get(ways, i.cast("int")), none)
    places = F.sequence(-F.col("reach"), F.col("reach"))
    start = F.transform(places, lambda t: F.when(t == 0, F.lit(1)).otherwise(F.lit(0)).cast("decimal(38,0)"))
    flip = lambda ways, x: F.transform(ways, lambda _, i: (at(ways, i - x) + at(ways, i + x)).cast("decimal(38,0)")).cast(many)
    row = row.withColumn("ways", F.aggregate("sizes", start, flip))
    far = F.filter(F.arrays_zip(F.col("ways").alias("w"), places.alias("t")), lambda x: F.abs(x["t"]) >= F.abs(F.col("observed")))
    found = F.aggregate(F.transform(far, lambda x: x["w"].cast("double")), F.lit(0.0), lambda a, x: a + x)
    return row.select("observed", "reviews", (found / F.pow(F.lit(2.0), F.col("reviews"))).alias("p"))


def exact_sign_flip(differences: Sequence[int]) -> float:
    """Two-sided p of the sum of integer differences under all flips of their signs, exactly.

    The distribution of the sum is built one difference after another; numbers
    are Python's, so nothing overflows.
    """
    sizes = [abs(int(d)) for d in differences if d]
    ways = Counter({0: 1})
    for d in sizes:
        after: Counter[int] = Counter()
        for total, n in ways.items():
            after[total + d] += n
            after[total - d] += n
        ways = after
    seen = abs(sum(differences))
    return sum(n for total, n in ways.items() if abs(total) >= seen) / 2 ** len(sizes)
