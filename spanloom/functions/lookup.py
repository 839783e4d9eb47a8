"""Small tables that expressions look strings up in, within a row and without a join."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a table at most: it goes with every task's plan.
MOST_KEYS = 20_000


@dataclass(frozen=True)
class Lookup:
    """Gives the value of a key, null for others.  The keys stand in buckets by hash, so one bucket is looked at."""

    text: str
    value: str
    buckets: int

    def __call__(self, key: Column) -> Column:
        # A constant, so the planner reads the text once.
        table = F.from_json(F.lit(self.text), f"array<array<struct<k:string,v:{self.value}>>>")
        bucket = F.get(table, F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int"))
        return F.get(F.filter(bucket, lambda e: e["k"] == key), F.lit(0))["v"]


def lookup(rows: DataFrame, key: str, value: str, most: int = MOST_KEYS) -> Lookup | None:
    """The table of ``rows``, whose keys are distinct strings; None if there are over ``most``."""
    given = rows.select(F.col(key).alias("k"), F.xxhash64(key).alias("h"), F.to_json(F.struct(F.col(value).alias("v")), {"ignoreNullFields": "false"}).alias("v"))
    found = given.limit(most + 1).collect()
    if len(found) > most:
        return None
    buckets = 1
    while buckets < 2 * len(found):
        buckets *= 2
    table: list[list] = [[] for _ in range(buckets)]
    for r in sorted(found, key=lambda r: r["k"]):
        table[r["h"] % buckets].append({"k": r["k"], **json.loads(r["v"])})
    return Lookup(json.dumps(table, ensure_ascii=False), rows.schema[value].dataType.simpleString(), buckets)
