"""Places by sampled ranges, on keys that are hard to cut."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import ordering


@pytest.mark.parametrize("kind", ["outlier", "skewed", "one key", "nulls", "even"])
def test_places_and_ranges_of_hard_keys(spark, monkeypatch, kind):
    monkeypatch.setattr(ordering, "ALONE", 200)
    r, n = random.Random(1), 6000
    key = {
        "outlier": lambda i: 1 << 62 if i == 7 else i % 3000, "skewed": lambda i: int(r.paretovariate(0.5)) % (1 << 40), "one key": lambda i: 5,
        "nulls": lambda i: None if i % 3 else i, "even": lambda i: -i,
    }[kind]
    rows = [(key(i), i, str(i)) for i in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, tie int, name string").repartition(7)
    want = {x[2]: i for i, x in enumerate(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])))}
    got = {x.name: x.place for x in ordering.numbered(df, "place", F.col("k"), "tie").collect()}
    assert got == want
    _, sizes = ordering.ranged(df.withColumn("_key", F.col("k")), n, ("tie",))
    found = [x["_n"] for x in sizes.collect()]
    ranges = 2 * (n // 200 + 1)
    assert sum(found) == n and max(found) <= 2 * n / ranges * 1.05, (kind, max(found), n / ranges)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(3, "a"), (None, "b"), (3, "0")], "k long, name string")
    assert {x.name: x.place for x in ordering.numbered(df, "place", F.col("k"), "name").collect()} == {"b": 0, "0": 1, "a": 2}
    assert ordering.numbered(df.limit(0), "place", F.col("k")).count() == 0
