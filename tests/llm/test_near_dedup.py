import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm import near_dedup as op8
from spanloom.llm import shingles
from spanloom.llm import node_pairs as pairs
from spanloom.llm.near_dedup import near_dedup
from spanloom.llm.shingles import minwise, odd_sketches, shingle_sets

BLANK = " \t\n\x0b\x0c\r"
UPPER = {c: c + 32 for c in range(65, 91)}


def plain(text):
    words = (text or "").translate(UPPER).translate({ord(b): " " for b in BLANK}).split(" ")
    words = [w for w in words if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [plain(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {(d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAbB éÄ\n\t\xa0\x0c1", max_size=60), max_size=6))
def test_sets_equal_plain_ones(texts):
    got = shingle_sets(texts)
    assert [len(s) for s in got] == [len(plain(t)) for t in texts]
    for i, t in enumerate(texts):
        for j, u in enumerate(texts):
            assert len(np.intersect1d(got[i], got[j])) == len(plain(t) & plain(u))


def test_long_texts_are_cut_between_words(monkeypatch):
    texts = [" ".join(f"word{i % 97}x{i % 31}" for i in range(3000)), "y" * 3000 + " a b c d e " + "z" * 5000, "b c", None]
    want = shingle_sets(texts)
    monkeypatch.setattr(shingles, "_PART", 500)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(want, shingle_sets(texts), strict=True))
    assert [len(s) for s in want] == [len(plain(t)) for t in texts]


def test_minwise_tokens_estimate_similarity():
    a = np.arange(1000, dtype=np.uint64)
    a, b = shingles.mix64(a), shingles.mix64(np.arange(250, 1250, dtype=np.uint64))
    m = minwise([np.sort(a), np.sort(b)], 400)
    assert abs((m[0] == m[1]).mean() - 0.6) < 0.08


def batch(key, sets, comp=None):
    n = range(len(sets))
    cols = [pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(odd_sketches(sets), pa.binary()), pa.array(comp or n, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=["key", "v", "sketch", "comp"])


def pair_of(r, n, common):
    a, b, c = (shingles.mix64(r.randint(0, 2**62, k).astype(np.uint64)) for k in (n - common, n - common, common))
    x, y = (np.unique(np.concatenate([z, c])) for z in (a, b))
    return x, y, len(np.intersect1d(x, y)) / len(np.union1d(x, y))


def test_sketches_tell_likely_pairs():
    r = np.random.RandomState(1)
    for n, slack in ((6, 0.05), (60, 0.03), (600, 0.04), (2500, 0.1), (6000, 0.2), (60_000, 0.2)):
        for _ in range(60 if n < 6000 else 12):
            x, y, s = pair_of(r, n, int(n * r.uniform(0.7, 1)))
            i, j = np.array([0]), np.array([1])
            maybe, sure = pairs._Rows(batch([1, 1], [x, y]).column(2)).likely(i, j, 75)
            assert maybe[0] or s < 0.75
            assert not maybe[0] or s > 0.75 - slack
            assert not sure[0] or (s >= 0.75 and maybe[0])
            assert sure[0] or s < 0.95 or n < 60


def test_pairs_at_the_threshold_are_never_lost_in_small_sets():
    r, sets = np.random.RandomState(2), []
    for _ in range(2000):
        n = r.randint(7, 1500)
        a = shingles.mix64(r.randint(0, 2**62, 2 * n).astype(np.uint64))
        common = -(-75 * 2 * n // 175)  # the least intersection that makes a link
        sets += [np.sort(a[:n]), np.sort(np.concatenate([a[:common], a[n : 2 * n - common]]))]
    rows = pairs._Rows(batch([0] * len(sets), sets).column(2))
    assert rows.likely(np.arange(0, 4000, 2), np.arange(1, 4000, 2), 75)[0].all()


def test_of_a_node_a_forest_and_all_doubtful_pairs_between_trees():
    r = np.random.RandomState(3)
    base = shingles.mix64(r.randint(0, 2**62, 400).astype(np.uint64))

    def copy(k):
        return np.unique(np.concatenate([base[k:], shingles.mix64(r.randint(0, 2**62, k).astype(np.uint64))]))

    sets = [copy(k) for k in [0] * 1 + [5] * 40 + [60, 60, 350]]
    got = pairs.compared(pa.Table.from_batches([batch([7] * len(sets), sets)]), 75, True).to_pydict()
    everything = pairs.compared(pa.Table.from_batches([batch([7] * len(sets), sets)]), 75, False).to_pydict()
    assert sum(got["sure"]) < len(sets) and len(everything["a"]) > 800
    parent = list(range(len(sets)))
    for a, b in zip(got["a"], got["b"], strict=True):
        x, y = parent[a], parent[b]
        parent = [x if p == y else p for p in parent]
    assert len(set(parent[:43])) == 1 and parent[43] == 43
    # Nodes are never mixed and never cut, whatever the batches.
    key = sorted(r.randint(0, 4, len(sets)).tolist())
    one = batch(key, sets)
    whole = [tuple(x.values()) for b in pairs.node_pairs(iter([one]), 75, False) for x in b.to_pylist()]
    cut = [tuple(x.values()) for b in pairs.node_pairs(iter([one.slice(i, 1) for i in range(len(sets))]), 75, False, most=3) for x in b.to_pylist()]
    assert sorted(whole) == sorted(cut) and all(key[a] == key[b] for a, b, _ in whole) and whole
    joined = pairs.compared(pa.Table.from_batches([batch(key, sets, [0] * len(sets))]), 75, True)
    assert joined.num_rows == 0


def corpus(n, seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    rows, shared = [], [word() for _ in range(60)]
    for _ in range(n):
        words = [word() for _ in range(r.choice([1, 3, 5, 30, 120, 300]))]
        if r.random() < 0.5:
            words[len(words) // 2 : len(words) // 2] = shared
        for _ in range(r.choice([0, 0, 0, 1, 4])):
            copy = list(words)
            for _ in range(r.choice([0, 1, 2, 4, 8])):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
        rows.append(" ".join(words).upper() if r.random() < 0.1 else "\n".join(words))
    ids = r.sample(range(10 * len(rows)), len(rows))
    return list(zip(ids, rows, strict=True))


def found(df):
    return {tuple(r) for r in df.collect()}


def test_equals_brute_force(spark):
    rows = corpus(120, 1) + [(90001, ""), (90002, " \n"), (90003, None), (90004, "One two"), (90005, "one  TWO")]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, v int")
    assert found(near_dedup(df)) == brute(rows)
    assert found(near_dedup(df, block=4, leaf=6)) == brute(rows)
    kept = near_dedup(df, keep_only=True)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute(rows) if r[3])


def test_one_large_group_of_near_copies_with_chains(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    rows, now = [], list(words)
    for i in range(150):
        copy = list(words)
        for _ in range(3):
            copy[r.randrange(120)] = f"x{i}{r.random()}"
        rows.append((i, " ".join(copy)))
    for i in range(40):  # each like the one before, the last unlike the first
        now[(i * 3) % 120] = f"y{i}"
        rows.append((1000 + i, " ".join(now)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near_dedup(df, block=8, leaf=10)) == brute(rows)


def test_pairs_at_the_threshold_stay_together_in_large_nodes(spark):
    r, sets = np.random.RandomState(5), []
    for _ in range(6000):
        a = shingles.mix64(r.randint(0, 2**62, 160).astype(np.uint64))
        sets += [np.sort(a[:140]), np.sort(a[20:])]  # 120 of 160 are common
    sig = minwise(sets, op8.COORDS).view(np.int32).tolist()
    df = spark.createDataFrame([(i, *sig[2 * i : 2 * i + 2]) for i in range(6000)], "v long, a array<int>, b array<int>")
    at = df.select("v", F.explode(F.array_intersect(*[op8._roots(F.col(c), op8.TREES) for c in "ab"])).alias("node"))
    for _ in range(op8.DEPTH - 1):  # no node ends as a leaf
        both = [op8._branches(F.col("node"), F.col(c)) for c in "ab"]
        at = at.join(df, "v").select("v", F.explode(F.array_intersect(*both)).alias("node"))
    assert 6000 - at.select("v").distinct().count() <= 3


def test_large_groups_with_the_defaults(spark):
    r = random.Random(4)
    rows, words = [], [[f"w{g}x{i}" for i in range(120)] for g in range(2)]
    for i in range(700):  # in each group most pairs are near the threshold
        copy = list(words[i % 2])
        for _ in range(3):
            copy[r.randrange(120)] = f"x{i}{r.random()}"
        rows.append((i, " ".join(copy)))
    now = list(words[0])
    for i in range(40):
        now[(i * 3) % 120] = f"y{i}"
        rows.append((1000 + i, " ".join(now)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert found(near_dedup(df)) == want
    assert found(near_dedup(df, block=100, leaf=200)) == want  # nodes branch, and blocks are compared in pairs


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "x"), (None, "x"), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, near_dedup(df).collect()))
    kept = [g for g in got if "kept=True" in g]
    assert len(got) == 6 and len(kept) == 3 and sum("component_id=5" in g for g in got) == 3
    assert near_dedup(df.limit(0)).collect() == []
