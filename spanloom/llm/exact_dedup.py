"""Exact dedup by two passes and a Bloom filter, in DataFrame operations only.

Pass one hashes every normalised text to ``HASHES`` positions of a bit map and
sets the bits of positions that two or more rows hit.  A text of which some
position is hit once only is unique.  Pass two reads the rows again: those with
all their bits set possibly repeat, and only they shuffle, by their digest; the
rest pass straight through.  Digests decide in the end, so false positives cost
time but change nothing.

The bit map has ``BITS_PER_ROW`` bits for each row of the input, a power of two of at
most ``MOST_BITS`` (512 MB), so what is broadcast is bounded.  Executors build it by an
aggregate, as a row of 64 longs for each segment in which a bit is set.  Up to 250
million rows one unique row in about a hundred shuffles; with more rows than that the
map fills up and more do, but results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bits import bit_map, bit_set, bits_for
from .common import fresh, join_groups, without_blanks, written

HASHES = 2


def text_key(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text without white space; null counts as empty."""
    return F.unhex(F.sha2(without_blanks(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def repeated_positions(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """The filter: the bit map of positions that two rows or more hit."""
    hit = keys.select(F.explode(F.array(*_positions(F.col(key), bits))).alias("at"))
    return bit_map(hit.groupBy("at").count().where("count > 1"))


def possibly_repeated(rows: DataFrame, key: str, filter_: DataFrame, bits: int) -> tuple[DataFrame, str]:
    """``rows`` with a boolean column, true where all positions of the key are set."""
    mark, one = fresh(rows.columns, "maybe"), fresh(rows.columns, "bit")
    out = rows.withColumn(mark, F.lit(True))
    for at in _positions(F.col(key), bits):
        out = bit_set(out, at, filter_, one).withColumn(mark, F.col(mark) & F.col(one)).drop(one)
    return out, mark


def exact_dedup(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int | None = None, keep_all: bool = True
) -> DataFrame:
    """All rows and columns of ``docs`` with the decision on each.

    Added: ``keep_id`` (id of the row that stays), ``group_size`` long,
    ``kept`` boolean and ``text_sha256``; an input column of the same name is
    replaced.  Of equal texts the one with most code points stays, then the
    smallest id, null ids last; of rows alike in both, any one.  Null texts
    count as empty, and empty texts are equal to each other.  Very long texts are
    hashed whole.  An empty table gives an empty table.  With ``keep_all=False``
    dropped rows are left out and nothing is added: input columns stay whatever
    their names.  ``bits`` is the size of the filter (see ``bits_for``).
    """
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    if keep_all:
        docs = docs.drop(*[c for c in added if c not in (text, doc_id)])
    bits = bits or bits_for(docs.count())
    names: list[str] = []
    for c in ("key", "size", "row", "best", "n", *added):
        names.append(fresh([*docs.columns, *names], c))
    key, size, row, best, n, *own = names
    keyed = docs.withColumn(key, text_key(F.col(f"`{text}`")))
    filter_ = written(repeated_positions(keyed.select(key), key, bits), "repeat-bits")
    marked, mark = possibly_repeated(keyed, key, filter_, bits)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    sha = F.lower(F.hex(F.col(key)))

    def decided(rows: DataFrame, *values: Column) -> DataFrame:
        return rows.select(*columns, *[v.alias(a) for v, a in zip((*values, sha), own, strict=True)])

    single = decided(marked.where(~F.col(mark)), F.col(f"`{doc_id}`"), F.lit(1).cast("long"), F.lit(True))
    chars = F.length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long")
    again = written(
        marked.where(F.col(mark)).drop(mark).withColumns({size: chars, row: F.monotonically_increasing_id()}),
        "possible-repeats",
    )
    order = F.struct((-F.col(size)).alias("a"), F.col(f"`{doc_id}`").isNull().alias("b"), F.col(f"`{doc_id}`").alias("id"), F.col(row).alias("row"))
    groups = again.groupBy(key).agg(F.min(order).alias(best), F.count(F.lit(1)).alias(n))
    groups = written(groups, "repeat-groups")
    several = join_groups(again, groups, key, n, again.count())
    several = decided(several, F.col(best)["id"], F.col(n), F.col(best)["row"] == F.col(row))
    out = single.unionByName(several)
    if keep_all:
        return out.select(*columns, *[F.col(a).alias(c) for a, c in zip(own, added, strict=True)])
    return out.where(own[2]).select(*columns)
