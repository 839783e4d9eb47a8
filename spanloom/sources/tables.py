"""Reviews, tags and manifests as tables; results as files; hashes of files."""

from __future__ import annotations

import ast
import json
from collections.abc import Mapping, Sequence
from importlib.metadata import PackageNotFoundError, version
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_reviews(spark: SparkSession, path: str, text: str = "Review_Text", limit: int | None = None) -> DataFrame:
    """``row_idx, text`` of a CSV file with a header, quoted lines included; ``limit`` takes the first rows.

    ``row_idx`` is the row's place, from 0: partitions keep the order of the
    file, so it is the sum of rows before plus the place within.  A file with quoted
    line breaks is read by one task; at scale, give reviews as Parquet with ``row_idx``.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    if text not in raw.columns:
        raise KeyError(text)
    placed = with_place(raw.select(F.col(f"`{text}`").alias("text")))
    return placed.orderBy("row_idx").limit(limit) if limit is not None else placed


def with_place(df: DataFrame) -> DataFrame:
    """``df`` with ``row_idx``, the place of each row by partition, without a global sort."""
    marked = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    sizes = {r["_part"]: r["count"] for r in marked.groupBy("_part").count().collect()}  # one row per partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    if not before:
        return df.withColumn("row_idx", F.lit(0).cast("long"))
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.withColumn("row_idx", offset[F.col("_part")] + inside).drop("_id", "_part")


def parsed_list(c: Column) -> Column:
    """Cells that hold a Python list: of strings, or of pairs, of which the second counts."""

    def one(cell):
        if not cell:
            return []
        return [x if isinstance(x, str) else x[1] for x in ast.literal_eval(cell)]

    def run(cells: pd.Series) -> pd.Series:
        return cells.map(one)

    return F.pandas_udf(run, "array<string>")(c)


def tag_column(df: DataFrame, names: tuple[str, ...] = ("BIO_Tags", "Predicted_BIO")) -> Column:
    """The first of the accepted columns that ``df`` has, as an array of tags."""
    for n in names:
        if n in df.columns:
            c = F.col(f"`{n}`")
            kind = df.schema[n].dataType.simpleString()
            if kind == "string":
                return parsed_list(c)
            return c if kind == "array<string>" else F.transform(c, lambda x: x["tag"])
    raise KeyError(f"none of {names}")


def checked_gold(gold: DataFrame) -> DataFrame:
    """``gold`` whose rows have as many ``tags`` as ``tokens``; fails on another."""
    ok = F.assert_true(F.size("tokens") == F.size("tags"), F.lit("tokens and tags differ in number"))
    return gold.withColumn("_ok", ok).where("_ok is null").drop("_ok")


def run_record(spark: SparkSession, path: str, config: Mapping[str, Any], reads: str, writes: str, resources: Sequence[str] = ()) -> dict[str, Any]:
    """Writes what a run will do to a new JSON file, before it does: configuration, input, output and hashes of resources."""
    hashes = {r: file_hashes(spark, r).first()["sha256"] for r in resources}
    record = {"configuration": dict(config), "input": reads, "output": writes, "resources": hashes}
    write_text(spark, path, json.dumps(record, ensure_ascii=False, indent=2))
    return record


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small new file in any store that Spark writes to; fails if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_result(df: DataFrame, path: str, reads: tuple[str, ...] = (), kind: str = "parquet") -> None:
    """Writes to a new folder; never over a path that the plan reads."""
    if path.rstrip("/") in {r.rstrip("/") for r in reads}:
        raise ValueError(f"{path} is also read: write to another folder")
    if kind in ("csv", "csv-bom"):
        flat = [F.to_json(f.name).alias(f.name) if f.dataType.simpleString().startswith(("array", "map", "struct")) else F.col(f.name) for f in df.schema]
        flat = df.select(*flat)
        if kind == "csv-bom" and flat.columns:  # for programs that know UTF-8 by it; each file begins with its header
            flat = flat.withColumnRenamed(flat.columns[0], f"\ufeff{flat.columns[0]}")
        flat.write.csv(path, header=True, escape='"')
    elif kind == "json":
        df.write.json(path)
    else:
        df.write.parquet(path)


def _store(spark: SparkSession, path: str):
    """The file system of ``path``, and how it names paths."""
    name = spark._jvm.org.apache.hadoop.fs.Path
    return name(path).getFileSystem(spark._jsc.hadoopConfiguration()), name


def replace_result(df: DataFrame, path: str) -> None:
    """Puts ``df`` as Parquet where ``path`` was, which ``df`` may read.

    It is written to ``path.staging`` whole, then ``path`` becomes ``path.old``, ``staging`` becomes ``path``, and the old one goes.
    Stopped at any step, ``recover`` gives the old table or the new one, whole.  One writer at a time.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    recover(spark, path)
    df.write.parquet(f"{path}.staging")
    fs, name = _store(spark, path)
    if fs.exists(name(path)):
        _moved(fs, name, path, f"{path}.old")
    _moved(fs, name, f"{path}.staging", path)
    fs.delete(name(f"{path}.old"), True)


def recover(spark: SparkSession, path: str) -> str:
    """Ends or takes back a ``replace_result`` that was stopped; ``clean``, ``ended`` or ``taken back``.

    Once the old table is aside, the staged one is whole and takes its place; until then the old one stays.
    """
    path = path.rstrip("/")
    fs, name = _store(spark, path)
    there = lambda p: fs.exists(name(p))
    staging, old = f"{path}.staging", f"{path}.old"
    if not there(staging) and not there(old):
        return "clean"
    if there(path):
        ended = there(old)
        fs.delete(name(staging), True)
        fs.delete(name(old), True)
        return "ended" if ended else "taken back"
    if there(f"{staging}/_SUCCESS"):
        _moved(fs, name, staging, path)
        fs.delete(name(old), True)
        return "ended"
    fs.delete(name(staging), True)
    if there(old):
        _moved(fs, name, old, path)
    return "taken back"


def _moved(fs, name, a: str, b: str) -> None:
    if not fs.rename(name(a), name(b)):
        raise OSError(f"{a} could not be renamed to {b}")


def file_hashes(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``path, bytes, sha256`` of files, each at most 2 GB, of all folders below if ``recursive``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def versions(packages: Sequence[str]) -> dict[str, str | None]:
    """Of each package the version that is installed here; None if there is none."""
    out: dict[str, str | None] = {}
    for p in packages:
        try:
            out[p] = version(p)
        except PackageNotFoundError:
            out[p] = None
    return out


def verified(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``path, status`` of a manifest (``path, sha256``): ok, changed or missing."""
    f = files.select("path", F.col("sha256").alias("found"))
    rows = manifest.select("path", "sha256").join(f, "path", "left")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.lower("sha256"), "ok").otherwise("changed")
    return rows.select("path", status.alias("status"))


#: Bytes up to which rows are dealt out to all cores.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """A small table with its rows dealt out to all cores, as a small file is often one row group, so one task; larger ones as they are."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= most else df
