"""Periodic runs against plain loops over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm import periodic_runs as op
from spanloom.llm.queries import op12_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=24, times=3):
    """All maximal stretches by their smallest period, period by period."""
    n, out = len(words), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, times * p):
                out.setdefault((i, j + p - i), p)
            i = j
    return sorted((s, n, p) for (s, n), p in out.items())


def plain(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 14)), max_size=8), st.sampled_from([(24, 3), (6, 2), (9, 4)]))
def test_runs_as_plain_loops(parts, bounds):
    words = [w for part, k in parts for w in part * k]
    assert [tuple(r) for r in op.runs(np.array(words, dtype=np.int32), *bounds).tolist()] == plain_runs(words, *bounds)


def test_runs_of_long_periods_and_any_step(monkeypatch):
    r = random.Random(5)
    words = [r.randrange(400) for _ in range(300)]
    words = words + words[:211] * 4 + [r.randrange(3) for _ in range(500)] + words[:90] * 5 + [7] * 60
    ids = np.array(words, dtype=np.int32)
    want = plain_runs(words)
    assert [tuple(x) for x in op.runs(ids).tolist()] == want and len(want) >= 3
    monkeypatch.setattr(op, "STEP", 5)
    assert [tuple(x) for x in op.runs(ids).tolist()] == want


def test_extensions_are_those_of_a_loop():
    r = random.Random(6)
    words = [r.randrange(2) for _ in range(40)] * 3
    ids = np.array(words, dtype=np.int32)
    i, j = map(np.array, zip(*[(a, b) for a in range(120) for b in range(a + 1, 120)], strict=True))
    on, back = op.extensions(op.names(ids), i, j)
    for a, b, f, g in zip(i.tolist(), j.tolist(), on.tolist(), back.tolist(), strict=True):
        assert f == next((k for k in range(120 - b) if words[a + k] != words[b + k]), 120 - b)
        assert g == next((k for k in range(a) if words[a - 1 - k] != words[b - 1 - k]), a)


def corpus():
    r = random.Random(4)
    word = lambda: r.choice(["a", "b", "ä", "猫", "x y", "long" * 9])
    texts = [None, "", " \t\n\x0b\x0c\r", "one", "la " * 24, "la " * 23, "a b " * 12 + "a", "a\x1cb " * 30, "  " * 40]
    texts += [" ".join(word() for _ in range(r.randrange(1, 300))) for _ in range(80)]
    texts += [" ".join([word() for _ in range(r.randrange(1, 9))] * r.randrange(3, 30)) + "\n" + " ".join(word() for _ in range(50)) for _ in range(30)]
    texts += ["\n".join([" ".join(word() for _ in range(700))] * 3), "ha " * 5000]
    rows = list(enumerate(texts)) + [(3, "la " * 30), (3, "la " * 30), (None, "na " * 30), ((1 << 62) + 1, "x y z " * 20), (-5, "q " * 50)]
    return rows


def test_query_as_plain_loops(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_runs int, id string")
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_periodic_runs(spark, str(tmp_path))
    key = lambda x: str(x)
    assert sorted((tuple(x) for x in got.collect()), key=key) == sorted((plain(d, t) for d, t in rows), key=key)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 5


@pytest.mark.parametrize("words", [[], ["a"], ["a"] * 24])
def test_without_planting(spark, words):
    df = spark.createDataFrame([("k", " ".join(words))], "doc_id string, text string").withColumn("start", F.lit(1))
    (got,) = op.periodic_runs(df).collect()
    assert (got.doc_id, got.n_runs) == ("k", int(len(words) == 24))


def test_empty_table(spark):
    assert op.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
