"""Centroid clustering: plain Lloyd rounds on whole numbers, so that the result depends on the rows alone.

``kept`` turns vectors into whole numbers once for all rounds, as a table in the shared
folder that goes after the last.
A round broadcasts the centroids, K x ``SIZE`` numbers; ``mapInPandas`` finds
for each vector the squared differences to one centroid after the other and
takes the first of the least; a task adds up its vectors, and ``groupBy`` merges
the tasks' sums, K x (``SIZE`` + 1) rows each.  The driver sees so many rows a round
and never a vector; nothing else shuffles.

Defined results: vectors of another size than ``size``, null vectors and those with a null
or non-finite component are left out.  Rows with equal ids are rows of their own; where ids among
the first centroids tie, the lesser vector goes first; null ids go last.  With fewer than ``k``
vectors there are as many centroids as vectors, with none the result is empty.  A centroid
equal to another keeps its number and, as ties go to the smaller, has no vectors.  A component over
``MOST`` in whole numbers fails the query, as distances would not fit into a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, only, written

#: Components of a vector, centroids, rounds, whole numbers to 1, and what the first centroids' hash begins with.
SIZE, K, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3"
#: Largest component: 64 squared differences of twice this still fit into a long.
MOST = 1 << 27


def whole(vector: Column, size: int = SIZE, scale: int = SCALE) -> Column:
    """The components as whole numbers, rounded down; null for vectors that aren't kept."""
    x = F.transform(vector, lambda v: v.cast("double"))
    good = F.forall(x, lambda v: F.coalesce((v > float("-inf")) & (v < float("inf")), F.lit(False)))  # NaN is over infinity
    n = F.transform(x, lambda v: F.floor(v * scale))
    n = F.transform(n, lambda v: F.when(F.abs(v) <= MOST, v.cast("int")).otherwise(F.raise_error(F.lit(f"a component is over {MOST} / {scale}"))))
    return F.when((F.size(vector) == size) & good, n)


def kept(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` of the rows that take part."""
    rows = only(vectors, vec_id, vector).toDF("vec_id", "v")
    return rows.select("vec_id", whole(F.col("v"), size, scale).alias("v")).where("v is not null")


def first_centroids(rows: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """The ``k`` vectors whose ids' hashes are least."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    least = rows.select(digest.alias("digest"), "v").orderBy(F.col("digest").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in least], dtype=np.int64)


def nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``v`` the number of the nearest centroid, the smaller of equal ones, and its squared distance."""
    far = np.empty((len(centres), len(v)), dtype=np.int64)
    for i, c in enumerate(centres):
        d = v - c
        far[i] = np.einsum("ij,ij->i", d, d)
    cluster = far.argmin(axis=0)
    return cluster, far[cluster, np.arange(len(v))]


def _matrix(v: pd.Series, size: int) -> np.ndarray:
    return np.concatenate(v.to_numpy()).reshape(-1, size).astype(np.int64) if len(v) else np.empty((0, size), dtype=np.int64)


def sums(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``cluster, place, total``: the sum of each component of the vectors nearest to each centroid, and, at place -1, their number."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)
    k, size = centres.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, size + 1), dtype=np.int64)
        for batch in batches:
            v = _matrix(batch["v"], size)
            cluster = nearest(v, sent.value)[0]
            for c in np.unique(cluster):
                mine = v[cluster == c]
                total[c] += np.append(mine.sum(axis=0), len(mine))
        some = np.flatnonzero(total[:, -1])
        places = [*range(size), -1]
        yield pd.DataFrame({"cluster": np.repeat(some, size + 1), "place": places * len(some), "total": total[some].ravel()})

    return rows.select("v").mapInPandas(run, "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum("total").alias("total"))


def moved(centres: np.ndarray, merged: Sequence) -> np.ndarray:
    """The centroids after a round: the floor of each cluster's mean; those without vectors stay."""
    out, n = centres.copy(), {c: t for c, place, t in merged if place < 0}
    for c, place, t in merged:
        if place >= 0:
            out[c, place] = t // n[c]
    return out


def assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)
    size = centres.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cluster, distance = nearest(_matrix(batch["v"], size), sent.value)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "known": batch["known"], "cluster": cluster.astype(np.int32), "distance": distance})

    # pandas holds whole numbers beside nulls as floats, so nulls go apart from the ids.
    kind = rows.schema["vec_id"].dataType.simpleString()
    given = rows.select(F.coalesce("vec_id", F.lit("0").cast(kind)).alias("vec_id"), F.col("vec_id").isNotNull().alias("known"), "v")
    found = given.mapInPandas(run, f"vec_id {kind}, known boolean, cluster int, distance long")
    return found.select(F.when(F.col("known"), F.col("vec_id")).alias("vec_id"), "cluster", "distance")


def cluster(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: int = SCALE,
    k: int = K, rounds: int = ROUNDS, seed: str = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance, cluster_inertia, inertia`` of every kept vector, and the final centroids."""
    given, scratch = kept(vectors, vec_id, vector, size, scale), []
    rows = written(given, "vectors", scratch)
    centres = first_centroids(rows, k, seed)
    if not len(centres):
        drop(rows.sparkSession, scratch)
        none = given.select("vec_id", *[F.lit(0).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"))])
        return none, centres
    for _ in range(rounds):
        centres = moved(centres, sums(rows, centres).collect())  # k x (size + 1) rows at most
    by = assigned(rows, centres).groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # at most k rows
    drop(rows.sparkSession, scratch)
    total = sum(r["cluster_inertia"] for r in by)
    inertia = given.sparkSession.createDataFrame([(r["cluster"], r["cluster_inertia"], total) for r in by], "cluster int, cluster_inertia long, inertia long")
    out = assigned(given, centres).join(F.broadcast(inertia), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia"), centres


def digests(centres: np.ndarray) -> list[str]:
    """Of each centroid the SHA-256 of its components in decimal, joined by commas."""
    return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
