"""Sets of word shingles as arrays of 64-bit hashes, computed for many texts at once.

Words are runs of bytes other than white space, A-Z lower-cased.  A word's hash
is taken from prefix sums of a polynomial over its bytes, so no word becomes a
Python object; five words' hashes in turn make a shingle's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

WORDS = 5
#: Bytes hashed at once; a longer text is cut between words and joined again.
_PART = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
_ODD = mix64(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, _PART + 2), base, dtype=np.uint64)
        x[0] = 1
        have = _powers[base] = np.multiply.accumulate(x)
    return have


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a string of bytes."""
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[low] * _power(_P, len(raw))[: len(raw)], out=sums[1:])
    own = (sums[ends] - sums[starts]) * _power(_P_INVERSE, len(raw))[starts]
    return mix64(own + (ends - starts).astype(np.uint64) * np.uint64(_P)), starts


def _cut(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of about ``_PART`` bytes that end between words."""
    at = 0
    while len(raw) - at > _PART:
        part = raw[at : at + _PART]
        blank = np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
        step = int(blank[-1]) + 1 if len(blank) else 0
        if not step:  # one word longer than a part: up to its end
            rest = raw[at + _PART :]
            blank = np.flatnonzero((rest == 32) | ((rest >= 9) & (rest <= 13)))
            step = _PART + (int(blank[0]) + 1 if len(blank) else len(rest))
        yield raw[at : at + step]
        at += step
    yield raw[at:]


def shingle_sets(texts: Sequence[str | None]) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles of five words.

    A text of one to four words has the whole sequence as its one shingle; one
    without words, or null, has none.
    """
    raws = [np.frombuffer((t or "").encode("utf-8", "surrogatepass"), dtype=np.uint8) for t in texts]
    out: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)] * len(raws)
    short = [i for i, r in enumerate(raws) if len(r) <= _PART]
    blank = np.full(1, 32, dtype=np.uint8)
    while short:
        part, n = [], 0
        while short and (not part or n + len(raws[short[0]]) < _PART):
            part.append(short.pop(0))
            n += len(raws[part[-1]]) + 1
        hashes, starts = _word_hashes(np.concatenate([x for i in part for x in (raws[i], blank)]))
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(raws[i]) + 1 for i in part]))
        for i, a, b in zip(part, bounds[:-1], bounds[1:], strict=True):
            out[i] = _shingles(hashes[a:b])
    for i, r in enumerate(raws):
        if len(r) > _PART:
            out[i] = _shingles(np.concatenate([_word_hashes(p)[0] for p in _cut(r)]))
    return out


def _shingles(words: np.ndarray) -> np.ndarray:
    n = len(words)
    if not n:
        return words
    if n < WORDS:
        return mix64((words * _ODD[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = words[: n - WORDS + 1] * _ODD[0]
    for k in range(1, WORDS):
        total = total + words[k : n - WORDS + 1 + k] * _ODD[k]
    return np.unique(mix64(total))


def minwise(sets: Sequence[np.ndarray], k: int) -> np.ndarray:
    """For each nonempty set the least of ``k`` hashes of its members: ``uint32`` of shape (sets, k), ``k`` even."""
    full = [s for s in sets if len(s)]
    out = np.zeros((len(full), k), dtype=np.uint32)
    if not full:
        return out
    flat, at = np.concatenate(full), np.cumsum([0] + [len(s) for s in full[:-1]])
    a = mix64(np.arange(1, k // 2 + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    for j in range(k // 2):  # one 64-bit hash gives two of 32 bits
        h = (flat ^ (a[j] >> np.uint64(7))) * a[j]
        h = (h ^ (h >> np.uint64(32))) * a[j]
        halves = h.view(np.uint32).reshape(-1, 2)
        out[:, 2 * j : 2 * j + 2] = np.minimum.reduceat(halves ^ (halves[:, ::-1] >> np.uint32(3)), at, axis=0)
    return out


#: Bits of a sketch.  Level ``k`` samples one in ``4 ** k`` members; a set has all levels under ``level(size)``.
BITS, LEVEL = 2048, 3072


def levels(n: int) -> int:
    """How many levels a set of ``n`` members has: one up to ``LEVEL``, and one more for each time it is four times as large."""
    k = 1
    while n > LEVEL * 4 ** (k - 1):
        k += 1
    return k


def odd_sketches(sets: Sequence[np.ndarray]) -> list[bytes]:
    """Of each nonempty set, for each of its levels, how many members the level has (32 bits) and ``BITS`` parities of their hashes."""
    full = [s for s in sets if len(s)]
    if not full:
        return []
    out = [b""] * len(full)
    depth = np.array([levels(len(s)) for s in full])
    for k in range(int(depth.max())):
        at = np.flatnonzero(depth > k)
        parts = [full[i] for i in at]
        if k:
            parts = [s[(s >> np.uint64(11)) & np.uint64(4**k - 1) == 0] for s in parts]
        for a in range(0, len(at), 64):
            some = parts[a : a + 64]
            owner = np.repeat(np.arange(len(some)), [len(s) for s in some])
            bit = owner * BITS + (np.concatenate(some) & np.uint64(BITS - 1)).astype(np.int64)
            odd = (np.bincount(bit, minlength=len(some) * BITS) & 1).astype(np.uint8)
            bits = np.packbits(odd.reshape(len(some), BITS), axis=1, bitorder="little")
            for i, s, row in zip(at[a : a + 64], some, bits, strict=True):
                out[i] += np.uint32(len(s)).tobytes() + row.tobytes()
    return out
