"""Context scores: vectors of tokens against centroids of categories, and the filters that use them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, mean_pool, unit

#: Turns a list of tokens into one vector each, null from where it takes no more.
Encode = Callable[[list[str]], list[np.ndarray | None]]


def hash_encoder(size: int = 32, longest: int = 512) -> Encode:
    """A fixed encoder without a model: each token a unit vector made from its hash, mixed with its neighbours."""

    def encode(tokens: list[str]) -> list[np.ndarray | None]:
        raw = []
        for t in tokens[:longest]:
            seed = int.from_bytes(hashlib.sha256(t.encode()).digest()[:4], "little")
            raw.append(np.random.RandomState(seed).normal(size=size))
        out: list[np.ndarray | None] = []
        for i, v in enumerate(raw):
            v = v + 0.25 * sum(raw[max(0, i - 1) : i] + raw[i + 1 : i + 2], np.zeros(size))
            out.append(v / np.linalg.norm(v))
        return [*out, *[None] * (len(tokens) - len(out))]

    return encode


def encoded(texts: DataFrame, encode: Encode, tokens: str = "tokens") -> DataFrame:
    """``texts`` with ``vectors``: one per token, null where the encoder stops."""

    @F.pandas_udf("array<array<double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([[None if v is None else v.tolist() for v in encode(list(r))] for r in rows], dtype=object)

    return texts.withColumn("vectors", run(F.col(tokens)))


def centroids(phrases: DataFrame, size: int, by: str = "category", vector: str = "vector") -> DataFrame:
    """``by, centroid``: the mean of the unit vectors, by position, at unit length.

    Sums are taken per position with partial aggregation, so no group of
    vectors is gathered.
    """
    if not size:
        return phrases.select(by).distinct().withColumn("centroid", F.array().cast("array<double>"))
    parts = [F.avg(F.get(F.col("u"), F.lit(i))).alias(f"m{i}") for i in range(size)]
    means = phrases.select(by, unit(F.col(vector)).alias("u")).groupBy(by).agg(*parts)
    return means.select(by, unit(F.array(*[F.col(f"m{i}") for i in range(size)])).alias("centroid"))


def lexicon_centroids(entries: DataFrame, encode: Encode, size: int) -> DataFrame:
    """``category, centroid`` from a lexicon's literals but for triggers and those of one character."""
    usable = entries.where("not is_regex and not is_trigger and length(norm) >= 2").select("category", "norm", "tokens").dropDuplicates(["category", "norm"])
    rows = encoded(usable, encode).withColumn("vector", mean_pool(F.filter("vectors", F.isnotnull), size))
    return centroids(rows.where("vector is not null"), size)


def with_similarities(rows: DataFrame, centroids: DataFrame, vector: str) -> DataFrame:
    """``rows`` with ``scores``, an array of category and cosine to its centroid; those without a cosine are left out.

    The centroids, one per category, come to the rows as one array, so no row is repeated or moved.
    """
    table = F.broadcast(centroids.agg(F.collect_list(F.struct("category", "centroid")).alias("_table")))  # one row
    scores = F.transform("_table", lambda c: F.struct(c["category"].alias("category"), cosine(F.col(vector), c["centroid"]).alias("score")))
    return rows.join(table).withColumn("scores", F.filter(scores, lambda s: s["score"].isNotNull())).drop("_table")


def scored(candidates: DataFrame, texts: DataFrame, centroids: DataFrame, size: int) -> DataFrame:
    """Candidates with ``context``, ``other`` and ``margin``: cosine to their category's centroid, the best of the others', and the gap.

    Centroids are one row per category.  All are null where no token of the
    span has a vector or the category no centroid.
    """
    places = candidates.select("row_idx", "start", "end").distinct().join(texts.select("row_idx", "vectors"), "row_idx")
    own = F.filter(F.slice("vectors", F.col("start") + 1, F.col("end") - F.col("start")), F.isnotnull)
    places = places.select("row_idx", "start", "end", mean_pool(own, size).alias("v")).where("v is not null")
    places = with_similarities(places, centroids, "v").select("row_idx", "start", "end", "scores")
    rows = candidates.join(places, ["row_idx", "start", "end"], "left")
    score = lambda s: s["score"]
    context = F.array_max(F.transform(F.filter("scores", lambda s: s["category"] == F.col("category")), score))
    other = F.array_max(F.transform(F.filter("scores", lambda s: s["category"] != F.col("category")), score))
    rows = rows.withColumns({"context": context, "other": other}).withColumn("margin", F.col("context") - F.col("other"))
    return rows.drop("scores")


def context_allowed(exact: float, trigger: float, fuzzy: float) -> Column:
    """Exact phrases of several words stay; triggers, fuzzy matches and single words need their score; the rest stays."""
    length = F.col("end") - F.col("start")
    at_least = lambda t: F.coalesce(F.col("context") >= t, F.lit(False))
    return (
        F.when((F.col("match_type") == "exact") & (length > 1), True)
        .when(F.col("is_trigger"), at_least(trigger))
        .when(F.col("match_type") == "fuzzy", at_least(fuzzy))
        .when(length == 1, at_least(exact))
        .otherwise(True)
    )


def margin_allowed(least: float) -> Column:
    """Exact phrases of several words and candidates without a margin stay; others need one."""
    phrase = (F.col("match_type") == "exact") & (F.col("end") - F.col("start") > 1)
    return phrase | F.col("margin").isNull() | (F.col("margin") >= least)


def two_best(vectors: DataFrame, centroids: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """``key, category, score, second, margin``: the nearest centroid, and by how much before the next."""
    rows = with_similarities(vectors.select(key, vector), centroids, vector)
    ranked = F.array_sort(F.transform("scores", lambda s: F.struct((-s["score"]).alias("less"), s["category"].alias("category"))))
    best, second = F.get(F.col("ranked"), F.lit(0)), F.get(F.col("ranked"), F.lit(1))
    rows = rows.withColumn("ranked", ranked).where(F.size("ranked") > 0)
    rows = rows.select(key, best["category"].alias("category"), (-best["less"]).alias("score"), (-second["less"]).alias("second"))
    return rows.withColumn("margin", F.col("score") - F.col("second"))


def discovered(analysed: DataFrame, texts: DataFrame, candidates: DataFrame, centroids: DataFrame, least: float = 0.60, margin: float = 0.05) -> DataFrame:
    """Single tokens outside all candidates that are near one centroid and clearly farther from the others."""
    taken = candidates.select("row_idx", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("start")).distinct()
    token = analysed.join(texts.select("row_idx", "vectors"), "row_idx").select(
        "row_idx", F.posexplode(F.arrays_zip("norms", "stops", "vectors")).alias("start", "t")
    )
    usable = ~F.col("t.stops") & (F.length("t.norms") >= 2) & ~F.col("t.norms").rlike("^\\p{Nd}+(?:\\.\\p{Nd}+)?[kKK]?$") & F.col("t.vectors").isNotNull()
    token = token.where(usable).join(taken, ["row_idx", "start"], "left_anti")
    token = token.select(F.struct("row_idx", "start").alias("at"), F.col("t.norms").alias("canonical"), F.col("t.vectors").alias("vector"))
    best = two_best(token, centroids, "at").where((F.col("score") >= least) & (F.col("margin") >= margin))
    rows = best.join(token.select("at", "canonical"), "at")
    gen = F.struct(F.lit(3).alias("a"), F.col("at.start").alias("b"), F.lit(0).alias("c"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("e"))
    return rows.select(
        "at.row_idx", "at.start", (F.col("at.start") + 1).alias("end"), "category", "canonical", F.lit(0.0).alias("score"),
        F.lit("semantic").alias("match_type"), F.lit(False).alias("is_trigger"), F.lit(False).alias("filtered"), gen.alias("gen"),
        F.col("score").alias("context"), F.col("second").alias("other"), "margin",
    )


def extensions(selected: DataFrame, analysed: DataFrame, texts: DataFrame, centroids: DataFrame, least: float) -> DataFrame:
    """Tokens beside a selected span, free and no stop words, that are near its category's centroid."""
    free = selected.select("row_idx", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("at")).distinct()
    beside = selected.select("row_idx", "category", F.explode(F.array(F.col("start") - 1, F.col("end"))).alias("at")).distinct()
    rows = beside.join(free, ["row_idx", "at"], "left_anti").join(analysed.select("row_idx", "norms", "stops"), "row_idx")
    rows = rows.join(texts.select("row_idx", "vectors"), "row_idx").where((F.col("at") >= 0) & (F.col("at") < F.size("norms")))
    rows = rows.where(~F.get("stops", F.col("at"))).join(F.broadcast(centroids), "category")
    rows = rows.withColumn("context", cosine(F.get("vectors", F.col("at")), F.col("centroid"))).where(F.col("context") >= least)
    gen = F.struct(F.lit(4).alias("a"), F.col("at").alias("b"), F.lit(0).alias("c"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("e"))
    return rows.select(
        "row_idx", F.col("at").alias("start"), (F.col("at") + 1).alias("end"), "category", F.get("norms", F.col("at")).alias("canonical"),
        F.lit(0.0).alias("score"), F.lit("contextual-extension").alias("match_type"), F.lit(False).alias("is_trigger"),
        F.lit(False).alias("filtered"), gen.alias("gen"), "context",
    )
