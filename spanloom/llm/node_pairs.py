"""Likely pairs among the documents of a node, by odd sketches, for many nodes at once.

An odd sketch has a parity for each of ``BITS`` hash values.  Two sketches differ
in as many bits as the sets' symmetric difference has members, less two for each
collision, so never in more: a pair at the threshold has at most
``d = (nA + nB) * (100 - percent) / (100 + percent)`` differing members, and on sets of
up to ``LEVEL`` members a pair with over ``d`` differing bits is none, for certain.
Where collisions are many the mean and five deviations of the count take ``d``'s
place, and larger sets are compared on samples, of which ``d`` gets five deviations
more; about one in three million pairs at the very threshold is lost so, none
of small sets.

Of a node's pairs that are links beyond doubt (six deviations) only a spanning
forest is given, marked ``sure``, and all pairs between its trees that may be links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shingles import BITS, mix64

#: Nodes up to here are compared by shifts over all of a batch, larger ones on their own.
_SMALL = 32
_WORDS = BITS // 64
_FIRST = 8
#: Pairs of a large node are looked at so many at a time.
_PART = 1 << 18


def bounds(total: np.ndarray, percent: int, sampled: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of sets with ``total`` members together: differing bits over the first are no link, under the second a sure one."""
    t = percent / 100
    most = np.floor(total * (100 - percent) / (100 + percent))
    spread = 2 / (1 + t) ** 2 * np.sqrt(t * (1 - t) * (1 + t) * total) if sampled else np.zeros(len(total))

    def count(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.maximum(d, 0)
        mean = BITS / 2 * (1 - np.exp(-2 * d / BITS))
        var = BITS / 4 * (1 - np.exp(-4 * d / BITS)) - d * np.exp(-4 * d / BITS)
        return mean, np.sqrt(np.maximum(var, 0))

    mean, dev = count(most + 5 * spread)
    none = mean + 5 * dev + 1
    if not sampled:
        none = np.minimum(none, most)
    mean, dev = count(most - 6 * spread)
    return none, mean - 6 * dev - 1


class _Rows:
    """Sketches of some rows: a matrix of words and member counts for each level."""

    def __init__(self, sketches: pa.Array) -> None:
        one = 4 + BITS // 8
        off = np.frombuffer(sketches.buffers()[1], np.int32)[sketches.offset : sketches.offset + len(sketches) + 1].astype(np.int64)
        data = np.frombuffer(sketches.buffers()[2], np.uint8)
        self.depth = (np.diff(off) // one).astype(np.int64)
        self.at, self.words, self.n = [], [], []
        for k in range(int(self.depth.max())):
            rows = np.flatnonzero(self.depth > k)
            raw = data[(off[rows] + k * one)[:, None] + np.arange(one)]
            at = np.zeros(len(off) - 1, np.int64)
            at[rows] = np.arange(len(rows))
            self.at.append(at)
            self.n.append(np.ascontiguousarray(raw[:, :4]).view("<u4")[:, 0].astype(np.int64))
            self.words.append(np.ascontiguousarray(raw[:, 4:]).view("<u8"))

    def likely(self, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of rows, which may be links, and which surely are."""
        maybe, sure = np.zeros(len(i), bool), np.zeros(len(i), bool)
        low, high = np.minimum(self.n[0][i], self.n[0][j]), np.maximum(self.n[0][i], self.n[0][j])
        open_ = np.flatnonzero(100 * low >= percent * high)
        for a in range(0, len(open_), 1 << 14):
            part = open_[a : a + (1 << 14)]
            x, y = i[part], j[part]
            most = (self.n[0][x] + self.n[0][y]) * (100 - percent) // (100 + percent)
            w = self.words[0]
            first = np.bitwise_count(w[x, :_FIRST] ^ w[y, :_FIRST]).sum(axis=1, dtype=np.int64)
            part = part[first <= most]
            level = np.minimum(self.depth[i[part]], self.depth[j[part]]) - 1
            for k in np.unique(level):
                some = part[level == k]
                x, y = self.at[k][i[some]], self.at[k][j[some]]
                differ = np.bitwise_count(self.words[k][x] ^ self.words[k][y]).sum(axis=1, dtype=np.int64)
                none, surely = bounds((self.n[k][x] + self.n[k][y]).astype(float), percent, k > 0)
                maybe[some], sure[some] = differ <= none, differ < surely
        return maybe, sure


def spanning(label: np.ndarray, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the edges that join trees; ``label``, each vertex' tree (its least vertex), is brought up to date.

    Each round every tree takes its edge of least ``weight`` to a tree with a lesser
    label, so that edges fall on many vertices and are the same in other nodes.
    """
    left, taken = np.arange(len(i)), []
    while True:
        left = left[label[i[left]] != label[j[left]]]
        if not len(left):
            return np.concatenate([left, *taken])
        high = np.maximum(label[i[left]], label[j[left]])
        order = np.lexsort((weight[left], high))
        pick = order[np.concatenate([[True], np.diff(high[order]) > 0])]
        taken.append(left[pick])
        label[high[pick]] = np.minimum(label[i[left[pick]]], label[j[left[pick]]])
        while not np.array_equal(deeper := label[label], label):
            label[:] = deeper


def _within(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places with equal keys, in parts; ``key`` is sorted."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    small = np.repeat(sizes <= _SMALL, sizes)
    shifts = range(1, min(_SMALL, int(sizes.max())))
    found = [np.flatnonzero((key[k:] == key[:-k]) & small[k:]) for k in shifts]
    if found:
        yield np.concatenate(found), np.concatenate([at + k for at, k in zip(found, shifts, strict=True)])
    for s, n in zip(starts[sizes > _SMALL], sizes[sizes > _SMALL], strict=True):
        step = max(1, _PART // n)
        for a in range(0, n, step):
            x, y = np.meshgrid(np.arange(a, min(n, a + step)), np.arange(a, n), indexing="ij")
            later = y > x
            yield x[later] + s, y[later] + s


def compared(batch: pa.Table, percent: int, forest: bool) -> pa.RecordBatch:
    """``a, b, sure`` from whole nodes: ``key, v, sketch, comp``, sorted by key; equal ``comp`` are joined already.

    Pairs are made in parts, and of those that a part's sure links join no further
    one is looked at, so memory follows the rows and the doubtful pairs alone.
    """
    key, v, comp = (batch.column(c).to_numpy() for c in (0, 1, 3))
    rows = _Rows(batch.column(2).combine_chunks())
    # Vertices are the node's components; the same one in another node is another vertex.
    order = np.lexsort((comp, key))
    new = np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(comp[order]) != 0)])
    vertex = np.empty(len(key), np.int64)
    vertex[order] = np.cumsum(new) - 1
    label = np.arange(int(vertex.max()) + 1)
    out: list[tuple[np.ndarray, np.ndarray, bool]] = []
    for i, j in _within(key):
        go = label[vertex[i]] != label[vertex[j]]
        i, j = i[go], j[go]
        maybe, sure = rows.likely(i, j, percent)
        if forest:
            x, y = i[sure], j[sure]
            a, b = np.minimum(v[x], v[y]), np.maximum(v[x], v[y])
            weight = mix64(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64))
            edges = spanning(label, vertex[x], vertex[y], weight)
            out.append((x[edges], y[edges], True))
            maybe &= ~sure
        i, j = i[maybe], j[maybe]
        go = label[vertex[i]] != label[vertex[j]]
        out.append((i[go], j[go], False))
    none = np.zeros(0, np.int64)
    i, j = (np.concatenate([none, *[o[k] for o in out]]) for k in (0, 1))
    sure = np.concatenate([none, *[np.full(len(o[0]), o[2]) for o in out]]).astype(bool)
    some = sure | (label[vertex[i]] != label[vertex[j]])
    a, b, sure = np.minimum(v[i], v[j])[some], np.maximum(v[i], v[j])[some], sure[some]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure, pa.bool_())], names=["a", "b", "sure"])


def node_pairs(batches: Iterator[pa.RecordBatch], percent: int, forest: bool, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """``compared`` over a partition sorted by key, some thousands of rows at a time, nodes never cut."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            held.append(batch.slice(at, most))
            rows += held[-1].num_rows
            if rows < most:
                continue
            table = pa.Table.from_batches(held)
            key = table.column(0).to_numpy()
            whole = int(np.searchsorted(key, key[-1]))
            if whole:
                yield compared(table.slice(0, whole), percent, forest)
                held, rows = table.slice(whole).to_batches(), len(key) - whole
    if rows:
        yield compared(pa.Table.from_batches(held), percent, forest)
