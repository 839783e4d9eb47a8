"""Every configuration of a grid of thresholds from one pass over the texts.

Candidates are found once, at the least thresholds.  Within a text's row each configuration
leaves some of them; the choice is made once for every set that differs, and gives one count of hits,
false and missed spans for each configuration.  What shuffles is a row of counts per task and configuration.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .metrics import scored
from .select import chosen_in_row


@dataclass(frozen=True)
class Thresholds:
    """One configuration: least context of single exact words, triggers and fuzzy words, least margin (None: any), least ratio of fuzzy words."""

    exact: float = 0.0
    trigger: float = 0.0
    fuzzy: float = 0.0
    margin: float | None = None
    cutoff: float = 0.0


FIELDS = "struct<exact:double,trigger:double,fuzzy:double,margin:double,cutoff:double>"
COUNTS = ["tp", "fp", "fn"]


def allowed(c: Column, t: Column) -> Column:
    """Whether a configuration leaves a candidate; see ``context.context_allowed`` and ``context.margin_allowed``."""
    phrase = (c["match_type"] == "exact") & (c["end"] - c["start"] > 1)
    at_least = lambda least: F.coalesce(c["context"] >= least, F.lit(False))
    by_context = (
        F.when(phrase, True)
        .when(c["is_trigger"], at_least(t["trigger"]))
        .when(c["match_type"] == "fuzzy", at_least(t["fuzzy"]))
        .when(c["end"] - c["start"] == 1, at_least(t["exact"]))
        .otherwise(True)
    )
    by_margin = phrase | c["margin"].isNull() | t["margin"].isNull() | (c["margin"] >= t["margin"])
    return by_context & by_margin & ((c["match_type"] != "fuzzy") | (c["score"] >= t["cutoff"]))


def counted(found: Column, gold: Column, grid: Sequence[Thresholds], simple: bool = False, longest: int | None = None) -> Column:
    """``array<struct<config_id, tp, fp, fn>>`` of a text with candidates ``found`` and true spans ``gold`` (``start, end, category``)."""
    every = F.array(*[F.struct(*[F.lit(v).cast("double").alias(k) for k, v in asdict(t).items()]) for t in grid]).cast(f"array<{FIELDS}>")
    left = lambda t: F.array_compact(F.transform(found, lambda c, i: F.when(allowed(c, t), i)))
    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("category"))
    true = F.transform(gold, place)

    def counts(numbers: Column) -> Column:
        """Of one set of candidates."""
        spans = F.transform(chosen_in_row(F.transform(numbers, lambda i: F.get(found, i)), simple, longest=longest, scored=True), place)
        hits = lambda both: F.struct(F.size(both).alias("tp"), F.size(spans).alias("n"))
        return let(F.array_intersect(spans, true), hits)

    def of_all(sets: Column) -> Column:
        def by(distinct: Column) -> Column:
            each = lambda done: F.transform(sets, lambda s, k: let(F.get(done, F.array_position(distinct, s).cast("int") - 1), lambda x: F.struct(
                k.alias("config_id"), x["tp"].cast("long").alias("tp"), (x["n"] - x["tp"]).cast("long").alias("fp"), (F.size(true) - x["tp"]).cast("long").alias("fn"))))
            return let(F.transform(distinct, counts), each)

        return let(F.array_distinct(sets), by)

    return let(F.transform(every, left), of_all)


def board(rows: DataFrame, grid: Sequence[Thresholds], found: str = "found", gold: str = "gold", simple: bool = False, longest: int | None = None) -> DataFrame:
    """``config_id, precision, recall, f1, support`` and the thresholds of every configuration, over rows with their candidates and true spans.

    Candidates have ``context`` and ``margin``, which may be null.  A null or empty array counts as without any.
    """
    spark = rows.sparkSession
    one = counted(F.coalesce(found, F.slice(found, F.lit(1), F.lit(0))), F.coalesce(gold, F.slice(gold, F.lit(1), F.lit(0))), grid, simple, longest)
    sums = rows.where(f"{found} is not null and {gold} is not null").select(F.inline(one)).groupBy("config_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
    configs = spark.createDataFrame([(i, *asdict(t).values()) for i, t in enumerate(grid)], "config_id int, exact double, trigger double, fuzzy double, margin double, cutoff double")
    full = configs.join(F.broadcast(sums), "config_id", "left").fillna(0, COUNTS)  # as many rows as configurations
    return scored(full).select("config_id", "precision", "recall", "f1", "support", "exact", "trigger", "fuzzy", "margin", "cutoff")
