"""Substring dedup by sliding spans of sentences.

A text's words are grouped to sentences: a sentence ends with a word after
whose last letter or digit there is one of ``. ! ? ; : ,``, or at a line's end,
so clauses count as sentences and a passage set into another sentence loses
little.  Marks of other scripts (such as the full stops of Chinese, Japanese,
Hindi or Arabic) end no sentence, and text without spaces has few words, so
passages repeated within paragraphs of such scripts aren't found.
At every sentence starts one span: the least run of consecutive
sentences that has ``LEAST_SENTENCES`` of them and ``LEAST_WORDS`` words.  Spans
are compared by a 128-bit hash of their words, A-Z lower-cased, white space
aside.

Spans are counted by hash over the whole table, with partial sums before the
shuffle; of each repeated hash the first place is kept (least document id, null
last, then row, then sentence).  A second pass over the texts emits only
spans whose hash is in a bit map of the repeated ones (of ``BITS`` bits whatever
the input; false positives fall out in the join), joins them to the first
places, and removes every sentence covered by a span that isn't the first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import bit_map, bit_set, bits_for
from .common import fresh, join_groups, written
from .shingles import _PART, _cut, _power, _word_hashes, mix64

LEAST_SENTENCES = 2
LEAST_WORDS = 16
_HI = 0xD6E8FEB86659FD93
_LO = 0xA0761D6478BD642F
_INVERSES = {p: pow(p, -1, 1 << 64) for p in (_HI, _LO)}

#: By byte: 1 for marks that end a sentence, 2 for letters, digits and all beyond ASCII.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[ord(c) for c in ".!?;:,"]] = 1
_KIND[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = 2


@dataclass
class Spans:
    """Of one text: byte offsets at which sentences start, and its spans ``first..last`` (sentences) with hashes."""

    raw: bytes
    starts: np.ndarray
    first: np.ndarray
    last: np.ndarray
    hi: np.ndarray
    lo: np.ndarray


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and start of each word, and whether it ends a sentence."""
    hashes, starts = _word_hashes(raw)
    if not len(starts):
        return hashes, starts, np.zeros(0, dtype=bool)
    kind, at = _KIND[raw], np.arange(len(raw))
    # Up to the next word there is only white space behind a word.
    mark = np.maximum.reduceat(np.where(kind == 1, at, -1), starts)
    letter = np.maximum.reduceat(np.where(kind == 2, at, -1), starts)
    line = np.add.reduceat((raw == 10).astype(np.int64), starts) > 0
    return hashes, starts, (mark > letter) | line


def _spans_of(raw: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, sentences: int, words: int) -> Spans:
    none = np.zeros(0, dtype=np.int64)
    if not len(starts):
        return Spans(raw, none, none, none, none, none)
    cut = ends.copy()
    cut[-1] = True
    stop = np.flatnonzero(cut) + 1  # word after each sentence
    begin = np.concatenate([[0], stop[:-1]])
    n = len(stop)
    # The sentence in which enough words are reached, and enough sentences.
    last = np.maximum(np.searchsorted(stop, begin + words), np.arange(n) + sentences - 1)
    first = np.flatnonzero(last < n)
    last = last[first]
    out = []
    for p in (_HI, _LO):
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * _power(p, len(hashes))[: len(hashes)], out=sums[1:])
        own = (sums[stop[last]] - sums[begin[first]]) * _power(_INVERSES[p], len(hashes))[begin[first]]
        out.append(mix64(own + (stop[last] - begin[first]).astype(np.uint64)).view(np.int64))
    return Spans(raw, starts[begin], first, last, *out)


def text_spans(texts: Sequence[str | None], sentences: int = LEAST_SENTENCES, words: int = LEAST_WORDS) -> list[Spans]:
    """The spans of each whole text; null counts as empty."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out: list[Spans | None] = [None] * len(raws)
    at = 0
    while at < len(raws):
        if len(raws[at]) > _PART:
            parts, offset = [], 0
            for p in _cut(np.frombuffer(raws[at], dtype=np.uint8)):
                h, s, e = _words(p)
                parts.append((h, s + offset, e))
                offset += len(p)
            out[at] = _spans_of(raws[at], *[np.concatenate(x) for x in zip(*parts, strict=True)], sentences, words)
            at += 1
            continue
        part, n = [], 0
        while at < len(raws) and len(raws[at]) <= _PART and (not part or n + len(raws[at]) < _PART):
            part.append(at)
            n += len(raws[at]) + 1
            at += 1
        h, s, e = _words(np.frombuffer(b"\n".join([*[raws[i] for i in part], b""]), dtype=np.uint8))
        offsets = np.cumsum([0] + [len(raws[i]) + 1 for i in part])
        bounds = np.searchsorted(s, offsets)
        for i, o, a, b in zip(part, offsets, bounds[:-1], bounds[1:], strict=False):
            out[i] = _spans_of(raws[i], h[a:b], s[a:b] - o, e[a:b], sentences, words)
    return out


def _span_rows(docs: DataFrame, sentences: int, words: int) -> DataFrame:
    """``hi, lo, row, doc_id, first, last`` of spans."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = text_spans(part.column(2).to_pylist(), sentences, words)
                hi, lo, first, last = (np.concatenate([getattr(g, c) for g in got]) for c in ("hi", "lo", "first", "last"))
                index = np.repeat(np.arange(len(got)), [len(g.hi) for g in got])
                take = pa.array(index)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hi), pa.array(lo), part.column(0).take(take), part.column(1).take(take), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                    names=["hi", "lo", "row", "doc_id", "first", "last"],
                )

    return docs.mapInArrow(rows, "hi long, lo long, row long, doc_id long, first int, last int")


def repeated_spans(docs: DataFrame, sentences: int, words: int) -> DataFrame:
    """``row, first, last`` of all spans that aren't the first of their text; ``docs`` is ``row, doc_id, text``."""
    spans = _span_rows(docs, sentences, words)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"), F.col("first").alias("first"))
    groups = spans.groupBy("hi", "lo").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n")).where("n > 1")
    key = F.struct("hi", "lo").alias("key")
    groups = written(groups.select(key, "place", "n"), "repeated-spans")
    bits = bits_for(groups.count())
    at = lambda lo: F.pmod(lo, F.lit(bits))
    filter_ = written(bit_map(groups.select(at(F.col("key.lo")).alias("at")).distinct()), "repeat-bits")
    maybe = bit_set(_span_rows(docs, sentences, words), at(F.col("lo")), filter_, "maybe").where("maybe")
    maybe = written(maybe.select(key, "row", "first", "last"), "maybe-repeated")
    joined = join_groups(maybe, groups, "key", "n", maybe.count())
    return joined.where((F.col("place.row") != F.col("row")) | (F.col("place.first") != F.col("first"))).select("row", "first", "last")


def span_dedup(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    sentences: int = LEAST_SENTENCES,
    words: int = LEAST_WORDS,
    stored: bool = False,
) -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without the repeated sentences.

    Added: ``n_sentences`` and ``n_removed``, long; input columns so named are
    replaced.  A removed sentence goes with the white space behind it; what is
    left is byte for byte as it was.  Null texts stay null with no sentences;
    texts shorter than a span stay as they are; of repeated rows the first row
    stays whole, also if ids repeat or are null.  Very long texts are read whole, in
    parts.  An empty table gives an empty one.  ``stored``: ``docs`` reads files, so that its rows have the same place
    each time; otherwise it is written first.
    """
    docs = docs.drop(*[c for c in ("n_sentences", "n_removed") if c not in (text, doc_id)])
    if not stored:
        docs = written(docs, "documents")
    row, cover = (fresh([*docs.columns, "n_sentences", "n_removed"], c) for c in ("row", "cover"))
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    narrow = placed.select(F.col(row).alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    spans = repeated_spans(narrow, sentences, words)
    # One document's own spans, so a row is as long as its text at most.
    covered = spans.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias(cover)).withColumnRenamed("row", row)

    @F.pandas_udf("text string, n_sentences long, n_removed long")
    def cleaned(texts, covers):
        import pandas as pd

        whole = [t if isinstance(t, str) else None for t in texts]
        out = []
        for at in range(0, len(whole), 256):
            got = text_spans(whole[at : at + 256], sentences, words)
            for t, g, c in zip(whole[at : at + 256], got, covers[at : at + 256], strict=True):
                gone = np.zeros(len(g.starts) + 1, dtype=np.int64)
                for x in c if c is not None else ():
                    gone[x["first"]] += 1
                    gone[x["last"] + 1] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                if gone.any():
                    ends = np.append(g.starts[1:], len(g.raw))
                    left = b"".join([g.raw[: g.starts[0]], *[g.raw[a:b] for a, b in zip(g.starts[~gone], ends[~gone], strict=True)]])
                    t = left.decode("utf-8", "surrogatepass")
                out.append((t, len(g.starts), int(gone.sum())))
        return pd.DataFrame(out, columns=["text", "n_sentences", "n_removed"])

    got = fresh([*docs.columns, row, cover], "got")
    out = placed.join(covered, row, "left").withColumn(got, cleaned.asNondeterministic()(F.col(f"`{text}`"), F.col(cover)))
    return out.select(
        *[F.col(got)["text"].alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.col(got)["n_sentences"].alias("n_sentences"),
        F.col(got)["n_removed"].alias("n_removed"),
    )
