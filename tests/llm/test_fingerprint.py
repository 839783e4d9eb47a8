import hashlib
import random
import re

from pyspark.sql import functions as F

from spanloom.llm import fingerprint
from spanloom.llm.fingerprint import differences, edited_fingerprints


def paragraphs(t):
    """Lines, cut after sentences."""
    return [p for line in t.split("\n") for p in re.split("(?<=[.!?;…。！？]) ", line)]


def brute(rows):
    """Per document in descending order of id: id, size, edited text, exact likeness to both."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (d, t, *_) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        like = lambda a, b: 1 - len(set(paragraphs(a)) ^ set(paragraphs(b))) / (len(set(paragraphs(a))) + len(set(paragraphs(b))))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(t, edited), 9), round(like(t, nxt), 9), t, edited))
    return out


def test_equals_brute_force(spark):
    r = random.Random(5)
    line = lambda: " ".join(r.choice(["ä", "bee", "cat 🐈", "dog", "x"]) + str(r.randrange(30)) for _ in range(r.randrange(6)))
    rows = [(i, "\n".join(line() for _ in range(r.choice([0, 1, 2, 8, 30, 300]))), "e") for i in r.sample(range(1000), 60)]
    rows += [(3000 + i, "".join(line() + r.choice([". ", "! ", ", ", "… "]) for _ in range(80)), "e") for i in range(8)]
    rows += [(2000, None, "e"), (2001, "", "e"), (2002, "one\ntwo\nthree\nfour", "e"), (2003, "\n".join(map(str, range(20_000))), "e"), (None, "a\nb", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, next string")
    got = edited_fingerprints(df).collect()
    want = brute(rows)
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(((g.doc_id, g.n_chars, g.edited_sha256, round(g.near_edited, 9), round(g.near_next, 9)) for g in got), key=key) == sorted((w[:5] for w in want), key=key)
    by = {}
    prints = {g.doc_id: (g.fingerprint, g.edited_fingerprint) for g in got}
    for w in want:
        for t, p in zip(w[5:], prints[w[0]], strict=True):
            assert by.setdefault(t, p) == p
    assert len(set(by.values())) >= len({frozenset(paragraphs(t)) for t in by})


def test_most_of_a_one_line_document_stays_alike(spark):
    text = " ".join(f"Sentence {i} says thing {i * 7}." for i in range(60))
    df = spark.createDataFrame([(2, text), (1, text.replace("thing", "other"))], "doc_id long, text string")
    got = {g.doc_id: g for g in edited_fingerprints(df).collect()}
    assert got[2].near_edited > 0.6 and got[2].near_next == 0.0


def test_peeling_recovers_digests_and_retries(spark):
    pairs = [(k, list(range(-n, 40)), list(range(0, 40 + m))) for k, (n, m) in enumerate([(0, 0), (1, 0), (5, 9), (300, 0), (1000, 2000)])]
    df = spark.createDataFrame(pairs, "k int, a array<long>, b array<long>").withColumns(
        {c: F.transform(c, lambda x: F.xxhash64(x)) for c in "ab"}
    )
    want = {r.k: (set(r.a) - set(r.b), set(r.b) - set(r.a)) for r in df.collect()}
    got = differences(df, ["k"]).collect()
    assert {r.k: (set(r.only_a), set(r.only_b)) for r in got} == want and len(got) == len(want)
    sizes = {r.k: (r.only_a, r.only_b) for r in differences(df, ["k"], sizes=True).collect()}
    assert sizes == {k: (len(a), len(b)) for k, (a, b) in want.items()}


def test_a_short_line_is_cut_after_sentences_too(spark):
    rows = [(2, "One. Two! Three? Four; five."), (1, "One. Two! Three? Four; six.")]
    got = {g.doc_id: g for g in edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].near_next == 0.8


def test_ties_one_row_and_empty_table(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = edited_fingerprints(df).collect()
    assert [(g.doc_id, g.near_next) for g in got] == [(1, 1.0)] * 3
    one = edited_fingerprints(df.limit(1)).collect()
    assert [(g.doc_id, g.near_next) for g in one] == [(1, 1.0)]
    assert edited_fingerprints(df.limit(0)).collect() == []


def test_only_parts_that_failed_are_dealt_again(spark, monkeypatch):
    """Of 400 digests in 16 sketches some sketches fail; before, all digests of the pair went to 64 sketches then, a row each."""
    pairs = [(k, [k * 10_000 + i for i in range(200)], [k * 10_000 + i for i in range(150, 350)]) for k in range(20)]
    df = spark.createDataFrame(pairs, "k int, a array<long>, b array<long>").withColumns({c: F.transform(c, lambda x: F.xxhash64(x)) for c in "ab"})
    tables = []
    keep = fingerprint.written
    monkeypatch.setattr(fingerprint, "written", lambda rows, *how: tables.append(keep(rows, *how)) or tables[-1])
    got = differences(df, ["k"], sizes=True).collect()
    assert sorted(map(tuple, got)) == [(k, 150, 150) for k in range(20)]
    assert tables[0].count() == 20 and sum(t.count() for t in tables[1:]) < 20 * 8


def test_cells_of_signed_digests_are_the_difference_of_two_sketches(spark):
    a, b = [F.transform(F.sequence(F.lit(x), F.lit(y)), lambda i: F.xxhash64(i)) for x, y in ((1, 60), (40, 90))]
    row = spark.range(1).select(
        fingerprint.sketch(a).alias("a"), fingerprint.sketch(b).alias("b"),
        fingerprint._cells(F.concat(fingerprint._placed(a, 1), fingerprint._placed(b, -1))).alias("d"),
    ).first()
    assert [(x.c - y.c, x.k ^ y.k, x.h ^ y.h, x.m) for x, y in zip(row.a, row.b, strict=True)] == [tuple(z) for z in row.d]
    assert [x.m for x in row.a] == [1 << j for j in range(48)] and sum(x.c for x in row.a) == 180
