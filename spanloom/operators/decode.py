"""Tags from scores: the best legal sequence; and labels for pieces of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

NEVER = -1e9


def legal(before: str | None, tag: str) -> bool:
    """I- goes on only after B- or I- of its category."""
    return not tag.startswith("I-") or before in (f"B-{tag[2:]}", f"I-{tag[2:]}")


def best_paths(scores: np.ndarray, sizes: np.ndarray, into: np.ndarray, first: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Of each token the number of its label on its text's best path; ``scores`` has a row per token, ``sizes`` the tokens of each text.

    All texts go on by a token at once, the longest first, so those still going are the first ones.
    """
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    longest = int(sizes.max(initial=0))
    going = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    back = np.zeros(scores.shape, dtype=np.min_scalar_type(scores.shape[1]))
    total = scores[start[: going[0]]] + first if longest else np.zeros((0, scores.shape[1]))
    for t in range(1, longest):
        at = start[: going[t]] + t
        reached = total[: going[t], None, :] + into
        from_ = reached.argmax(axis=2)
        back[at] = from_
        total[: going[t]] = np.take_along_axis(reached, from_[:, :, None], axis=2)[:, :, 0] + (scores[at] + mask)
    path, now = np.zeros(len(scores), dtype=back.dtype), total.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        at = start[: going[t]] + t
        path[at] = now[: going[t]]
        now[: going[t]] = back[at, now[: going[t]]]
    return path


def best_tags(
    labels: Sequence[str], transitions: Sequence[Sequence[float]] | None = None, observed: Sequence[str] | None = None
) -> Callable[[Column | str], Column]:
    """An expression from scores (an array per token, in the order of ``labels``) to the best legal tags, by Viterbi's method in an Arrow UDF.

    ``transitions[i][j]`` is added from label i to j; labels not in ``observed``
    are left out.  Of equal sequences the one of earlier labels counts.  Time grows with the tokens, whatever the
    texts' lengths.  A score that is null or missing counts as ``NEVER``.  Null or no tokens give no tags.
    """
    given = transitions if transitions is not None else [[0.0] * len(labels)] * len(labels)
    into = np.array([[float(given[i][j]) if legal(a, b) else NEVER for i, a in enumerate(labels)] for j, b in enumerate(labels)])
    mask = np.array([0.0 if observed is None or b in observed else NEVER for b in labels])
    first = np.array([m if legal(None, b) else m + NEVER for m, b in zip(mask, labels, strict=True)])
    names = list(labels)

    def run(scores: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(scores), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = scores.flatten()
        widths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = pc.fill_null(rows.flatten(), NEVER).to_numpy(zero_copy_only=False)
        if (widths == len(names)).all():
            values = values.reshape(-1, len(names))
        else:
            filled = np.full((len(widths), len(names)), NEVER)
            column = np.arange(len(values)) - np.repeat(np.cumsum(widths) - widths, widths)
            known = column < len(names)
            filled[np.repeat(np.arange(len(widths)), widths)[known], column[known]] = values[known]
            values = filled
        path = best_paths(values, sizes, into, first, mask)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(names, pa.string()).take(pa.array(path.astype(np.int32))))

    def decode(scores: Column | str) -> Column:
        scores = F.col(scores) if isinstance(scores, str) else scores
        return F.arrow_udf(run, "array<string>")(scores.cast("array<array<double>>"))

    return decode


def piece_labels(word_of: Column, tags: Column, ignored: str = "") -> Column:
    """Labels of pieces: that of the word for its first piece, ``ignored`` for others and for pieces of no word (null)."""
    return F.transform(
        word_of,
        lambda w, i: F.when(w.isNotNull() & ((i == 0) | ~F.get(word_of, i - 1).eqNullSafe(w)), F.get(tags, w)).otherwise(F.lit(ignored)),
    )


def common_prefix(pieces: Sequence[Column], most: int, special: Sequence[int] = ()) -> Column:
    """How many whole words fit into ``most`` pieces by each of several tokenizers.

    ``pieces`` has a column per tokenizer, the number of pieces of each word; ``special``
    are the pieces that each adds to a text.
    """
    added = list(special) or [0] * len(pieces)
    return F.least(*[fitting_prefix(p, most - s) for p, s in zip(pieces, added, strict=True)], F.lit(1 << 30))


def fitting_prefix(pieces: Column, most: int) -> Column:
    """How many whole words fit into ``most`` pieces, from the number of pieces of each."""
    sums = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"), F.lit(True).alias("on")),
        lambda s, p: F.when(
            s["on"] & (s["n"] + p <= most), F.struct((s["n"] + p).alias("n"), (s["words"] + 1).alias("words"), F.lit(True).alias("on"))
        ).otherwise(F.struct(s["n"].alias("n"), s["words"].alias("words"), F.lit(False).alias("on"))),
    )
    return sums["words"]


def piece_counter(path: str, kept: int = 200_000) -> Callable[[Sequence[str]], np.ndarray]:
    """Counts the pieces of words by a file of the tokenizers library; a word met before isn't cut again.

    Words are cut on their own, as the library does with texts given as words.  At most ``kept`` words are remembered.
    """
    from tokenizers import Tokenizer

    tokenizer, known = Tokenizer.from_file(path), {}

    def count(words: Sequence[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(new) > kept:
            known.clear()
            new = list(dict.fromkeys(words))
        for w, e in zip(new, tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
            known[w] = len(e.ids)
        return np.array([known[w] for w in words], dtype=np.int64)

    return count


def longest_prefix(words: Sequence[str], count: Callable[[Sequence[str]], np.ndarray], most: int) -> int:
    """How many of the first words have at most ``most`` pieces together.

    Stretches of words are counted, each twice as long as the one before, up to the one that goes over; none is counted twice.
    """
    done, used, step = 0, 0, 32
    while done < len(words):
        sums = used + np.cumsum(count(words[done : done + step]))
        fit = int(np.searchsorted(sums, most, side="right"))
        if fit < len(sums):
            return done + fit
        done, used, step = done + len(sums), int(sums[-1]), 2 * step
    return done


def shared_prefix(tokens: Column | str, paths: Sequence[str], most: int, special: Sequence[int] = ()) -> Column:
    """How many whole words of ``tokens`` fit into ``most`` pieces by each of several tokenizer files.

    ``special`` are the pieces that each tokenizer adds to a text.  A later tokenizer sees only the words that fit
    the ones before.  Null tokens have no words.
    """
    room = [most - s for s in (list(special) or [0] * len(paths))]

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counters = [piece_counter(p) for p in paths]

        def one(words) -> int:
            words = [] if words is None else list(words)
            for count, r in zip(counters, room, strict=True):
                words = words[: longest_prefix(words, count, r)]
            return len(words)

        for rows in batches:
            yield pd.Series([one(w) for w in rows], dtype="int32")

    return run(F.col(tokens) if isinstance(tokens, str) else tokens)
