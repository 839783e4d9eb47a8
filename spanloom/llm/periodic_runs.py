"""Periodic runs of words, found by Karp-Miller-Rosenberg names.

Each text is one row's work, so nothing shuffles.  ``names`` gives every stretch of
2**k words a number, equal for equal stretches: a pair of names of the level below is
one whole number, and numbers in sorted order are the next level's names.  It ends with
the level on which all stretches differ.  The common extension of two places is read
off by descending levels.

A run of period p and at least max(24, 3p) words holds max(24, 3p) - p places in a row
whose word comes again p places on, so one of them is on the grid of that step.  Every
grid place of every period whose word comes again is extended both ways; what is long
enough is a run, and of equal stretches the smallest period is its period.

Time and memory follow the words of a text, times the logarithm of their number; grid places are
taken ``STEP`` at a time.  A name is 4 bytes, so a text of a million words that repeats itself whole
takes 80 MB.

Defined results: a null or blank text has no words and no runs; its hashes are those of the
empty text.  Rows with a null id get no planted run (see ``planted``).  Equal rows are rows of their own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

#: Words and periods that a run has at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Grid places that are looked at together.
STEP = 1 << 20

RESULT = (
    "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def words_of(text: bytes | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+``; in UTF-8 these bytes stand for nothing else, and they are what ``split`` parts at."""
    return text.split() if text else []


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    first = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(first.__getitem__, words), dtype=np.int32, count=len(words))


def planted(ids: np.ndarray, doc_id: str | None) -> np.ndarray:
    """The source place of each place: texts whose id's CRC-32, in decimal, ends in 0 get a repeated stretch from some place on."""
    n = len(ids)
    place = np.arange(n, dtype=np.int64)
    if doc_id is None or not n:
        return place
    h = zlib.crc32(doc_id.encode())
    g, rest = divmod(h, 10)
    if rest:
        return place
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place[a:] = a + (place[a:] - a) % p
    return place


def names(ids: np.ndarray, most: int | None = None) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4, ... words (``most`` at most) by their first place.

    The last level is the first on which all differ, or the longest that fits.
    """
    levels = [ids]
    size = 1
    while 2 * size <= min(len(ids), most or len(ids)):
        last = levels[-1]
        n = len(last) - size
        pair = last[:n].astype(np.int64) * (1 + int(last.max())) + last[size:]
        different, new = np.unique(pair, return_inverse=True)
        levels.append(new.astype(np.int32))
        size *= 2
        if len(different) == n:
            break
    return levels


def extensions(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places ``i`` < ``j``: how many words from them on are equal, and how many before them."""
    n = len(levels[0])
    on, back = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size, level = 1 << k, levels[k]
        a, b = i + on, j + on
        fits = b + size <= n
        at = np.where(fits, b, 0), np.where(fits, a, 0)
        on += size * (fits & (level[at[0]] == level[at[1]]))
        a, b = i - back - size, j - back - size
        fits = a >= 0
        at = np.where(fits, b, 0), np.where(fits, a, 0)
        back += size * (fits & (level[at[0]] == level[at[1]]))
    return on, back


def _grid(n: int, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods to look at, at most some ``STEP`` together."""
    period = np.arange(1, n // times + 1, dtype=np.int64)
    gap = np.maximum(least, times * period) - period
    many = -(-(n - period) // gap)
    ends = np.cumsum(many)
    first = 0
    while first < len(period):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + STEP, side="right")))
        part = slice(first, last)
        p = np.repeat(period[part], many[part])
        nth = np.arange(len(p), dtype=np.int64) - np.repeat(ends[part] - many[part] - before, many[part])
        yield nth * np.repeat(gap[part], many[part]), p
        first = last


def runs(ids: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> np.ndarray:
    """Rows of start, length and period of all runs, by start, then period."""
    n = len(ids)
    found = [np.empty((0, 3), dtype=np.int64)]
    levels = names(ids) if n >= least else []
    for i, p in _grid(n, least, times) if levels else ():
        again = np.flatnonzero(ids[i] == ids[i + p])
        i, p = i[again], p[again]
        on, back = extensions(levels, i, i + p)
        long = np.flatnonzero(on + back + p >= np.maximum(least, times * p))
        found.append(np.stack([i[long] - back[long], (on + back + p)[long], p[long]], axis=1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # A stretch has every multiple of its period as a period, too: the first, the smallest, stays.
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def dropped(n: int, found: np.ndarray) -> np.ndarray:
    """Whether each word is in a run after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:n]) > 0


def strongest(found: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length by period, compared exactly; then the first, then the shorter period."""
    best = None
    for start, length, period in found.tolist():  # by start, then period: an equal one comes too late
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def described(text: bytes | None, doc_id: str | None, plant: bool) -> tuple:
    """A row of ``RESULT``."""
    words = words_of(text)
    ids = numbered(words)
    if plant:
        place = planted(ids, doc_id)
        ids = ids[place]
    found = runs(ids)
    best = strongest(found)
    kept = np.flatnonzero(~dropped(len(ids), found))
    collapsed = b" ".join([words[x] for x in (place[kept] if plant else kept).tolist()])
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
    digest = lambda b: hashlib.sha256(b).hexdigest()
    start, length, period = best or (None, None, None)
    milli = 1000 * length // period if best else None
    return len(found), start, length, period, milli, digest(listed.encode()), digest(collapsed)


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", plant: bool = False) -> DataFrame:
    """``doc_id`` and the columns of ``RESULT`` for every row of ``docs``.

    ``start, length, period, exponent_milli`` are of the strongest run, null without one;
    ``runs_sha256`` is of all runs, ``collapsed_sha256`` of the text without words that a run
    repeats.  ``plant``: texts of some ids are given a run first (see ``planted``).
    """
    rows = only(docs, doc_id, text).toDF("doc_id", "text")
    columns = [c.split()[0] for c in RESULT.split(", ")]
    longs = columns[:5]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = pd.DataFrame([described(t, i, plant) for t, i in zip(batch["text"], batch["id"], strict=True)], columns=columns)
            yield got.astype(dict.fromkeys(longs, "Int64")).assign(id=batch["id"].to_numpy())

    # Ids go as text, as pandas holds whole numbers beside nulls as floats.
    given = rows.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("binary").alias("text"))
    found = given.mapInPandas(run, f"id string, {RESULT}")
    return found.select(F.col("id").cast(rows.schema["doc_id"].dataType).alias("doc_id"), *columns)
