"""Quality rules: counts against plain loops, lists against labels they should explain."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import quality_rules as op
from spanloom.llm.queries import op13_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    count = lambda chars: sum(c in chars for c in text)
    return (
        len(words), sum(map(len, words)), count("#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated),
        len(lines), max((words.count(w) for w in words), default=0), sum("A" <= c <= "Z" for c in text),
        sum("0" <= c <= "9" for c in text), count("!?"),
    )


def corpus():
    r = random.Random(3)
    words = ["the", "Ärger", "猫", "x<y", "50%", "oh!", "tab\there", "two\n", "nbsp ", " ", "a|b"]
    texts = [None, "", " \t\n\x0b\x0c\r", "\n\n", "one", "same\nsame\n\nsame \nsame", "a " * 200, "b c d e f g h i " * 2, "b c d e f g h " * 2]
    texts += [" ".join(r.choice(words) for _ in range(r.randrange(120))) for _ in range(60)]
    texts += ["\n".join(" ".join(r.choice(words) for _ in range(9)) for _ in range(3)) * r.randrange(1, 4) for _ in range(20)]
    texts.append(" ".join(str(r.randrange(9)) for _ in range(3000)))
    return texts


def test_counts_as_plain_loops(spark):
    rows = [(i, t) for i, t in enumerate(corpus())] + [(3, "again"), (3, "again"), (None, "no id"), ((1 << 62) + 1, "large id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int")
    got = op.statistics(df).collect()
    assert sorted(str(tuple(g)) for g in got) == sorted(str((i, *plain(t))) for i, t in rows)


def made(n, seed=1):
    """Documents of which long words and many symbols, or much upper case, are bad; and some with a wrong label."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.choice(["good", "good", "good", "symbols", "shouting"])
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(25, 120))]
        if kind == "symbols":
            words = [w + "###" for w in words]
        if kind == "shouting":
            words = [w.upper() for w in words]
        rows.append((i, " ".join(words), int(kind == "good") if r.random() > 0.01 else r.randrange(2)))
    return rows


def frames(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    return df.select("doc_id", "text", F.lit(1).alias("kept"), F.lit("x").alias("rule")), df.select("doc_id", "quality", F.lit(0).alias("toxic"))


def test_learned_list_on_rows_it_did_not_see(spark):
    docs, labels = frames(spark, made(600))
    rules = op.learn(docs, labels)
    assert "upper_share" in {c.name for r in rules for c in r} and len(rules) >= 2
    seen, truth = frames(spark, made(400, seed=2))
    got = op.quality_rules(seen, rules).join(truth, "doc_id")
    right = got.where(F.col("kept") == (F.col("quality") == 1)).count()
    assert right >= 0.97 * 400
    assert got.where("kept and rule is not null or not kept and not base_failed and rule is null").count() == 0
    assert op.learn(docs.repartition(7), labels.repartition(3)) == rules


def test_verdict_is_the_first_rule_that_holds(spark):
    rules = [(op.Condition("upper_share", False, 0.2),), (op.Condition("symbols_per_word", False, 0.5), op.Condition("word_length", True, 8.0))]
    texts = [t for t in corpus() if t] + [" ".join(["WORD#"] * 30), " ".join(f"w{i}##" for i in range(30)), " ".join(f"plain{i}" for i in range(30))]
    got = op.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rules).collect()
    for row in got:
        n = dict(zip(op.COUNTS, plain(texts[row.doc_id]), strict=True))
        ratio = lambda name: n[op.FEATURES[name][0]] / n[op.FEATURES[name][1]] if n[op.FEATURES[name][1]] else 0.0  # noqa: E731, B023
        meets = [r for r in rules if all((ratio(c.name) <= c.threshold) == c.at_most for c in r)]
        failed = n["n_words"] < 20 or 100 * n["n_repeat_words"] > 30 * n["n_words"]
        assert (row.base_failed, row.kept) == (failed, not failed and not meets)
        assert row.rule == (None if failed or not meets else " and ".join(map(str, meets[0])))


def test_pruning_takes_chance_conditions_away():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    bad = (x[:, 0] > 1) ^ (rng.random(300) < 0.02)
    first, chance = op.Condition("a", False, 1.0), op.Condition("b", False, 1.2)
    assert op.pruned((first, chance), x[::2], x[::2, 0] > 1, ["a", "b"]) == (first,)
    rules = op.learned(x, bad, np.arange(300) % 3 == 0, ["a", "b"])
    assert all(c.name == "a" for r in rules for c in r[:1])


def test_labels_that_say_nothing(spark):
    docs, labels = frames(spark, made(60))
    assert op.learn(docs, labels.withColumn("quality", F.lit(1))) == []
    assert op.learn(docs, labels.withColumn("quality", F.lit(None).cast("int"))) == []
    assert op.learn(docs, labels.limit(0)) == op.learn(docs.limit(0), labels) == []
    repeated = labels.unionByName(labels).unionByName(labels.withColumn("doc_id", F.lit(None).cast("long")))
    assert op.learn(docs.unionByName(docs), repeated) == op.learn(docs, labels)
    assert op.quality_rules(docs.limit(0), []).count() == 0


def test_bound_on_the_sample(spark):
    docs, labels = frames(spark, made(600))
    assert isinstance(op.learn(docs, labels, fit_rows=100), list)


@pytest.mark.skipif("not __import__('os').path.exists('/root/testdata/sf0.01')")
def test_query_keeps_clean_documents(spark):
    got = op13_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    got = got.where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() >= 0.99 and got[got.quality == 0].kept.mean() <= 0.1
