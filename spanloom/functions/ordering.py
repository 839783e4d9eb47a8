"""Places of rows in one order, without bringing all rows into one task."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Ranges of the key at most, and rows that are numbered as one range.
RANGES, ALONE = 4096, 10_000
#: Parts that a range of one key is split into, at most.
PARTS = 64


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, for several passes: in the session's checkpoint folder if it has one, else with the executors."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def _bounds(df: DataFrame, ranges: int) -> list[float]:
    """Bounds of ranges of about equal numbers of rows; a key that fills a range has one of its own."""
    found = df.select(F.col("_key").cast("double").alias("_key")).approxQuantile("_key", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))
    own = {math.nextafter(b, math.inf) for a, b in zip(found, found[1:], strict=False) if a == b}
    return sorted({*found, *own})


def ranged(df: DataFrame, n: int, ties: tuple[Column | str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_range`` and ``_part``, in the order of ``_key`` and the first of ``ties``, and ``_n``, how many rows each has.

    Bounds are quantiles, so an outlier makes no range large.  A range of a single key that has over twice the mean
    is parted by quantiles of the first tie, if that is a number.
    """
    ranges = min(RANGES, n // ALONE + 1) * 2
    bounds = _bounds(df, ranges) or [0.0]
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_at", outputCol="_range", handleInvalid="keep")
    df = cut.transform(df.withColumn("_at", F.col("_key").cast("double"))).drop("_at")
    df = df.withColumn("_range", F.when(F.col("_key").isNull(), -1).otherwise(F.col("_range").cast("int")))  # nulls come first
    part = F.lit(0)
    if ties:
        tie = F.col(ties[0]) if isinstance(ties[0], str) else ties[0]
        df = df.withColumn("_tie", tie)
        if isinstance(df.schema["_tie"].dataType, NumericType):
            by = df.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_key").alias("a"), F.max("_key").alias("b"))
            hot = by.where((F.col("_n") > 2 * n / ranges) & F.col("a").eqNullSafe(F.col("b"))).select("_range").collect()  # ``ranges`` rows at most
            if hot:
                rows = df.where(F.col("_range").isin([r["_range"] for r in hot])).groupBy("_range")
                cuts = rows.agg(F.percentile_approx(F.col("_tie").cast("double"), [i / PARTS for i in range(1, PARTS)], 50 * PARTS).alias("_cuts"))
                df = df.join(F.broadcast(cuts), "_range", "left")
                part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_tie").cast("double"))), F.lit(0))
    df = df.withColumn("_part", F.when(part < 0, 0).otherwise(part)).drop("_tie", "_cuts")
    return df, df.groupBy("_range", "_part").agg(F.count(F.lit(1)).alias("_n"))


def numbered(df: DataFrame, name: str, key: Column, *ties: Column | str) -> DataFrame:
    """``df`` with ``name``, the place from 0 of each row by ``key``, a whole number, then by ``ties``; null keys come first.

    Rows are numbered within ranges of about equal size, and the sizes of the ranges
    before, a table of bounded size, are added.  Up to ``ALONE`` rows are one range.
    """
    df = df.withColumn("_key", key.cast("long"))
    order = [F.col("_key").asc_nulls_first(), *ties]
    n = df.count()
    if n <= ALONE:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")).drop("_key")
    df, sizes = ranged(df, n, ties)
    before = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)  # 2 x RANGES x PARTS rows at most
    sizes = sizes.select("_range", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range", "_part").orderBy(*order))
    rows = df.withColumn("_nth", within).join(F.broadcast(sizes), ["_range", "_part"])
    return rows.withColumn(name, F.col("_before") + F.col("_nth") - 1).drop("_key", "_range", "_part", "_before", "_nth")
