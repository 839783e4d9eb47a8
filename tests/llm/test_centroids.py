"""Centroid clustering against plain loops."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import centroids as op
from spanloom.llm.queries import op11_centroids

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=op.K, rounds=op.ROUNDS, size=op.SIZE):
    """``(vec_id, cluster, distance, cluster_inertia, inertia)`` and the centroids, vector by vector."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        by = {}
        for _, v in kept:
            by.setdefault(nearest(v)[1], []).append(v)
        for n, vs in by.items():
            centres[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {c: sum(d for _, x, d in found if x == c) for _, c, _ in found}
    return [(i, c, d, inertia[c], sum(inertia.values())) for i, c, d in found], centres


def ours(spark, rows, parts=3, **how):
    found, centres = op.cluster(spark.createDataFrame(rows, SCHEMA).repartition(parts), **how)
    return [tuple(r) for r in found.collect()], centres.tolist()


def key(r):
    return (r[0] is None, *r[1:], r[0] or 0)


def test_rounds_as_plain_loops(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=64) + 2 * (i % 11)).astype("float32").tolist()) for i in range(300)]
    assert sorted(ours(spark, rows)[0], key=key) == sorted(plain(rows)[0], key=key)
    assert ours(spark, rows, parts=1)[1] == ours(spark, rows, parts=7)[1] == plain(rows)[1]


def test_what_is_left_out_and_ties(spark):
    rng = np.random.default_rng(8)
    good = rng.normal(size=(12, 64)).astype("float32").tolist()
    odd = [None, [], good[0][:63], [*good[0], 0.5], [None, *good[0][1:]], [float("nan"), *good[1][1:]], [float("inf"), *good[2][1:]], [float("-inf"), *good[2][1:]]]
    rows = [(100 + i, v) for i, v in enumerate(odd)]
    rows += [(i, v) for i, v in enumerate(good)] + [(3, good[3]), (3, good[4]), (None, good[5]), (None, good[6]), ((1 << 62) + 1, good[7])]
    rows += [(50 + i, good[0]) for i in range(9)]  # copies: equal centroids, of which the first takes all
    got, want = ours(spark, rows), plain(rows)
    assert sorted(got[0], key=key) == sorted(want[0], key=key) and got[1] == want[1]


def test_few_vectors_and_none(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    found, centres = ours(spark, rows)
    assert len(centres) == 3 and sorted(found, key=key) == sorted(plain(rows)[0], key=key)
    assert ours(spark, [(1, None)]) == ([], [])
    assert ours(spark, []) == ([], [])


def test_other_sizes_numbers_and_extra_columns(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("x"), "v": F.lit(1), "distance": F.lit(2)})
    found, _ = op.cluster(df, size=5, k=3, rounds=4)
    by = {r["vec_id"]: r["cluster"] for r in found.collect()}
    assert sorted(by) == list(range(60)) and set(by.values()) == {0, 1, 2}


def test_too_large_components_fail(spark):
    with pytest.raises(Exception, match="is over"):
        ours(spark, [(1, [1e9] * 64)])


def test_query_on_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op11_centroids(spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0
