"""Bit maps as tables, built by aggregates and looked up by broadcast joins, sized by what they hold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

BITS_PER_ROW = 16
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 32
#: Bits of a segment of the map, which is one row of 64 longs.
SEGMENT = 64 * 64


def bits_for(rows: int) -> int:
    """Size of the bit map for so many rows."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << math.ceil(math.log2(max(1, rows * BITS_PER_ROW)))))


def bit_map(positions: DataFrame) -> DataFrame:
    """``(segment long, words array<long>)`` from the positions ``at`` whose bits are set."""
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    words = positions.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(bit).alias("mask"))
    slot = (F.col("word") % 64).cast("int")
    held = words.groupBy(F.expr("word div 64").alias("segment")).agg(F.map_from_entries(F.collect_list(F.struct(slot, "mask"))).alias("held"))
    return held.select("segment", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("long"))).alias("words"))


def bit_set(rows: DataFrame, at: Column, filter_: DataFrame, mark: str) -> DataFrame:
    """``rows`` with a boolean column ``mark``: whether the bit at that position is set; the filter is broadcast."""
    segment, words = fresh([*rows.columns, mark], "segment"), fresh([*rows.columns, mark], "words")
    side = F.broadcast(filter_.select(F.col("segment").alias(segment), F.col("words").alias(words)))
    word = F.get(F.col(words), F.floor((at % SEGMENT) / 64).cast("int"))
    found = rows.join(side, F.floor(at / SEGMENT) == F.col(segment), "left")
    return found.withColumn(mark, F.coalesce(F.getbit(word, (at % 64).cast("int")) == 1, F.lit(False))).drop(segment, words)
