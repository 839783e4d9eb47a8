"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session.  Only where that is unset,
    as in tests on one machine, a temporary folder takes its place.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spanloom-"))
    return f"file://{_own_dir[0]}"


#: Rows that go to Python at once while a table is written: whole texts are held in this number, not in Spark's 10,000.
ARROW_ROWS = 1024
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """At most ``ARROW_ROWS`` rows in an Arrow batch of plans made meanwhile."""
    before = spark.conf.get(_ARROW)
    spark.conf.set(_ARROW, str(min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_ARROW, before)


def written(df: DataFrame, hint: str, scratch: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again.

    This cuts lineage, fixes row ids, and survives lost executors, as each
    task's file is committed by Spark.  ``scratch`` gets the path, for ``drop``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{hint}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, scratch: list[str]) -> None:
    """Deletes tables that ``written`` made, once nothing will read them."""
    while scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(scratch.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(taken: Sequence[str], name: str) -> str:
    """``name``, lengthened until no column of ``taken`` has it in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so extra columns can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_blanks(c: Column) -> Column:
    """All of ``BLANKS`` deleted."""
    for b in BLANKS:
        c = F.replace(c, F.lit(b), F.lit(""))
    return c


def hot_size(total: int) -> int:
    """Groups of more rows than this, of ``total`` in all, are hot: there are 10,000 of them at most."""
    return max(10_000, total // 10_000)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of rows with one row per group, by ``key``; ``n`` is the group's size, ``total`` the number of rows.

    Hot groups, if there are any, and only those, are broadcast; their rows stay where
    they are.  The others are joined by a shuffle in which no key is large.
    """
    least = hot_size(total)
    hot = groups.where(F.col(n) > least)
    if total <= least or hot.isEmpty():
        return rows.join(groups, key)
    mark = fresh([*rows.columns, *groups.columns], "hot")
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias(mark))), key, "left")
    large = marked.where(F.col(mark)).drop(mark).join(F.broadcast(hot), key)
    rest = marked.where(F.col(mark).isNull()).drop(mark).join(groups.where(F.col(n) <= least), key)
    return large.unionByName(rest)
