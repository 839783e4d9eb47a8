import hashlib
import random

from pyspark.sql import functions as F

from spanloom.llm.bits import LEAST_BITS, MOST_BITS, bits_for
from spanloom.llm.exact_dedup import exact_dedup, possibly_repeated, repeated_positions

BLANK = {ord(c): None for c in " \t\n\x0b\x0c\r"}


def brute(rows):
    groups = {}
    for d, t in rows:
        t = t or ""
        groups.setdefault(t.translate(BLANK), []).append((-len(t), d is None, d or 0, d))
    out = []
    for d, t in rows:
        t = t or ""
        g = groups[t.translate(BLANK)]
        out.append((d, min(g)[3], len(g), hashlib.sha256(t.translate(BLANK).encode()).hexdigest()))
    return out


def corpus():
    r = random.Random(1)
    base = ["a b c", "ä\tö", "x" * 50, "long " * 20_000, " nbsp", ""]
    rows = [(i, " ".join(r.choice(base)) if r.random() < 0.1 else r.choice(base).replace(" ", r.choice([" ", "  ", "\n"]))) for i in range(200)]
    rows += [(1000 + i, f"alone {i}") for i in range(100)]
    return rows + [(3, "a b c"), (3, "a b c"), (None, "a b c"), (None, None), (500, None)]


def test_equals_brute_force_at_any_number_of_bits(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "k", 1, True) for d, t in rows], "doc_id long, text string, key string, size int, kept boolean")
    for bits in (64, 1 << 20):  # 64: the map is full, so all rows shuffle
        got = exact_dedup(df, bits=bits).collect()
        key = lambda x: str(x)
        assert sorted(((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got), key=key) == sorted(brute(rows), key=key)
        kept = [g for g in got if g.kept]
        assert sorted(g.text_sha256 for g in kept) == sorted({b[3] for b in brute(rows)}) and all(g.doc_id == g.keep_id for g in kept)
        assert all(g.key == "k" and g.size == 1 for g in got)


def test_kept_rows_only_and_empty_table(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup(df, keep_all=False)
    assert got.columns == df.columns and got.count() == len({b[3] for b in brute(rows)})
    assert exact_dedup(df.limit(0)).collect() == []


def test_columns_stay_whatever_their_names(spark):
    rows = [(1, "a", "x", 1, False, -1, "w"), (2, " a", "y", 2, True, -2, "w"), (3, None, "z", 3, None, -3, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id string, group_size int, kept boolean, n int, segment string")
    assert sorted(tuple(r) for r in exact_dedup(df, keep_all=False).collect()) == rows[1:]
    whole = {r.doc_id: r for r in exact_dedup(df).collect()}
    assert whole[1].keep_id == 2 and whole[1].group_size == 2 and not whole[1].kept and whole[3].n == -3


def test_the_filter_grows_with_the_rows_up_to_its_bound():
    assert bits_for(0) == bits_for(1000) == LEAST_BITS and bits_for(10**12) == MOST_BITS
    assert bits_for(10**6) == 1 << 24 and all(bits_for(n) >= 16 * n for n in (10**5, 10**7, 2 * 10**8))


def test_few_unique_rows_shuffle(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("t"), F.col("id") % 19_000).alias("key"))
    bits = bits_for(20_000)
    marked, mark = possibly_repeated(rows, "key", repeated_positions(rows, "key", bits), bits)
    got = {r.key: r[mark] for r in marked.collect()}
    assert all(got[f"t{i}"] for i in range(1000)) and sum(got.values()) < 1000 + 0.02 * 18_000
