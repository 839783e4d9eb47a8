"""Language identification by nearest centroid.

A text's letters, lower-cased, with all else as single spaces, are cut into
n-grams of two and three bytes of UTF-8, hashed to ``DIMS`` dimensions.  Counts
are damped, weighted by inverse document frequency and normalised.  Each
language of the training rows gets ``centroids`` centroids by spherical
k-means.  A text has the language of the centroid of largest cosine, which is
its score; it is rejected where its distance to that centroid is far beyond
those of training rows (see ``Model.floor``).

The fit uses a bounded sample of the training rows: about ``per_language`` rows
of each language, fewer where languages are so many that all would have over
``most_rows``, picked by a hash of the id.  Prediction covers every row and
the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

DIMS = 1 << 12
PER_LANGUAGE = 1_000
#: Rows of all languages together that are fitted: 8 KB each on the driver.
MOST_ROWS = 20_000
CENTROIDS = 3
SIZES = DIMS.bit_length()
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
#: Texts are turned to vectors in parts of this many bytes, so memory is bounded by parts, not texts.
_PART = 1 << 20
#: Rows that the fit weighs at once.
_ROWS = 256


def term_weights(text: str) -> np.ndarray:
    """``1 + log`` of each dimension's count, 0 where there is none."""
    counts = np.zeros(DIMS, dtype=np.float64)
    raw = np.frombuffer(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace"), dtype=np.uint8)
    for at in range(0, len(raw), _PART):
        b = raw[at : at + _PART + 2].astype(np.uint32)
        two = b[:-1] * np.uint32(0x9E3779B1) ^ b[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) ^ b[2:] * np.uint32(0x27D4EB2F)
        # The next part begins with the two bytes that end this one.
        two = two[:_PART]
        for h in (two, three + np.uint32(0x165667B1)):
            h = h ^ (h >> np.uint32(15))
            counts += np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(20), minlength=DIMS)
    out = np.zeros(DIMS, dtype=np.float32)
    seen = counts > 0
    out[seen] = 1 + np.log(counts[seen])
    return out


@dataclass
class Model:
    """``floor`` has, per centroid and size class, the cosine under which a text is rejected.

    It is 0.6 of the least cosine of the language's training rows of that size
    class, short and odd ones included, so only texts far from all that was
    learned go; a class with few rows takes the floor of the one below.
    """

    languages: list[str]
    of: np.ndarray
    idf: np.ndarray
    centroids: np.ndarray
    floor: np.ndarray

    def cosines(self, weights: np.ndarray) -> np.ndarray:
        """Rows of ``term_weights`` against all centroids."""
        return _unit(weights * self.idf) @ self.centroids.T

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and rejection of each text.

        A null text, or one without a letter, is ``und`` with score 0 and rejected.
        """
        lang, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.languages else []
        for at in range(0, len(known), 256):
            part = known[at : at + 256]
            weights = np.stack([term_weights(texts[i]) for i in part])
            cos = self.cosines(weights)
            for i, c, k, s in zip(part, cos, cos.argmax(axis=1), _size_class(weights), strict=True):
                lang[i], score[i] = self.languages[self.of[k]], float(min(1, max(0, c[k])))
                rejected[i] = bool(c[k] < self.floor[k, s])
        return lang, score, rejected


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _size_class(weights: np.ndarray) -> np.ndarray:
    """Of each row the whole binary logarithm of its number of dimensions: cosines grow with it."""
    return np.log2(np.maximum(np.count_nonzero(weights, axis=1), 1)).astype(int)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of spherical k-means; starts far apart, so the result is fixed by ``x``."""
    picked = [_unit(x.mean(axis=0))]
    while len(picked) < min(k, len(x)):
        picked.append(x[np.argmin(np.max(x @ np.stack(picked).T, axis=1))])
    c = np.stack(picked)
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = np.stack([_unit(x[near == j].mean(axis=0)) if (near == j).any() else c[j] for j in range(len(c))])
    return c


def fit_weights(weights: np.ndarray, langs: list[str], centroids: int = CENTROIDS) -> Model:
    """A model from rows of ``term_weights`` and their languages; ``weights`` is overwritten, so that the driver holds it once."""
    idf = (1 + np.log((1 + len(weights)) / (1 + np.count_nonzero(weights, axis=0)))).astype(np.float32)
    size = _size_class(weights)
    for at in range(0, len(weights), _ROWS):  # in place, as these are all the rows of the fit
        weights[at : at + _ROWS] = _unit(weights[at : at + _ROWS] * idf)
    x, y = weights, np.array(langs)
    names, all_c, of = sorted(set(langs)), [], []
    for i, name in enumerate(names):
        c = _clusters(x[y == name], centroids)
        all_c.append(c)
        of += [i] * len(c)
    c = np.concatenate(all_c)
    best = np.max(x @ c.T, axis=1)
    floor = np.zeros((len(of), SIZES))
    for k, i in enumerate(of):
        for s in range(SIZES):
            own = best[(y == names[i]) & (size == s)]
            floor[k, s] = 0.6 * own.min() if len(own) >= 5 else floor[k, s - 1] if s else 0.0
    return Model(names, np.array(of), idf, c, floor)


def held_out(doc_id: Column) -> Column:
    """Rows that may not be learned from: crc32 of the id as text, mod 4, is 2; a null id isn't one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
    per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, most_rows: int = MOST_ROWS,
) -> Model:
    """A model from rows that have a language and a letter and aren't held out."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where(
        F.col("lang").isNotNull() & ~held_out(F.col("id"))
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.zeros(0, int), np.zeros(0), np.zeros((0, DIMS)), np.zeros((0, SIZES)))
    per_language = min(per_language, max(1, most_rows // len(counts)))
    share = F.create_map(*[F.lit(x) for l, n in sorted(counts.items()) for x in (l, min(1.0, per_language / n))])
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, l in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t and _LETTER.search(t):
                    w = term_weights(t).astype("<f2").tobytes()
                    yield pa.record_batch([pa.array([l], pa.string()), pa.array([w], pa.binary())], names=["lang", "w"])

    got = sorted(map(tuple, picked.select("text", "lang").mapInArrow(weights, "lang string, w binary").collect()))
    if not got:
        return Model([], np.zeros(0, int), np.zeros(0), np.zeros((0, DIMS)), np.zeros((0, SIZES)))
    langs, found = [l for l, _ in got], np.empty((len(got), DIMS), dtype=np.float32)
    for i in range(len(got)):
        found[i], got[i] = np.frombuffer(got[i][1], "<f2"), None
    return fit_weights(found, langs, centroids)


def language_id(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred``, ``score`` and ``rejected``.

    The text alone decides.  Null texts and texts without a letter are ``und``,
    score 0, rejected; so are all if the model knows no language.  Very long texts are
    read whole, in parts.  Equal texts get equal results; input columns named as the
    added ones are replaced; an empty table stays empty.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    out, got = _predicted(docs, model, text)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], f"{got}.lang_pred", f"{got}.score", f"{got}.rejected")


def known(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with their columns, whatever their names, and no others."""
    out, got = _predicted(docs, model, text)
    return out.where(~F.col(got)["rejected"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def _predicted(docs: DataFrame, model: Model, text: str) -> tuple[DataFrame, str]:
    """``docs`` with a struct of ``lang_pred, score, rejected``, and that column's name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: languages x centroids x DIMS

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        lang, score, rejected = shared.value.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": rejected})

    # Only the text goes to Python.  Called nondeterministic, so that filters
    # on the result don't make it run a second time.
    got = fresh(docs.columns, "got")
    return docs.withColumn(got, predicted.asNondeterministic()(F.col(f"`{text}`"))), got
