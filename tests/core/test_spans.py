import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import agreement, context, metrics, resample, splits
from spanloom.operators.decode import best_tags
from spanloom.operators.select import merged, without_overlap
from spanloom.operators.tags import aspects, decoded, emitted, invalid
from spanloom.plans.extract import Config, extract, tokenised
from spanloom.sources import tables, words
from spanloom.streaming.extract import start as start_stream

LEXICON = """ignored before
camera-
picture quality
lens
screen-
brightness
memory-
\\d+ ?gb
price-
വില
phone-
[0-9]+k?
lens
"""


def lexicon(spark):
    rows = list(enumerate(LEXICON.splitlines()))
    return words.lexicon(spark.createDataFrame(rows, "line_no long, line string"))


def test_lexicon_sections_triggers_and_aliases(spark):
    got = [(r.category, r.norm, r.is_regex, r.is_trigger) for r in lexicon(spark).orderBy("ord").collect()]
    assert got == [
        ("camera", "camera", False, True), ("camera", "picture quality", False, False), ("camera", "lens", False, False),
        ("display", "screen", False, True), ("display", "brightness", False, False),
        ("memory", "memory", False, True), ("memory", "\\d+ ?gb", True, False),
        ("price", "price", False, True), ("price", "വില", False, False),
        ("phone", "phone", False, True), ("phone", "[0-9]+k?", True, False), ("phone", "lens", False, False),
    ]
    one = words.inventory(lexicon(spark)).first()
    assert (one.entries, one.literals, one.distinct_literals, one.triggers, one.regexes) == (12, 5, 4, 5, 2)
    assert words.prune(lexicon(spark), lexicon(spark).where("norm = 'lens'")).count() == 10


def test_extraction_end_to_end(spark):
    texts = ["The picture qualitys of the Camera is good, 8 gb", "വിലയുടെ brightnes 15000k lens", None, "nothing here"]
    docs = tokenised(spark.createDataFrame(list(enumerate(texts)), "row_idx long, text string"))
    out = extract(docs, lexicon(spark), Config(), stop=("the", "of", "good"))
    tags = {r.row_idx: r.tags for r in out["tagged"].collect()}
    assert tags[0] == ["O", "B-camera", "I-camera", "O", "O", "B-camera", "O", "O", "B-memory", "I-memory"]
    assert tags[1] == ["B-price", "B-display", "O", "B-camera"] and tags[2] == [] and tags[3] == ["O", "O"]
    found = {r.row_idx: r.aspects for r in out["aspects"].collect()}
    assert found[0] == {"camera": ["picture quality", "camera"], "memory": ["8 gb"]}
    assert invalid(out["tagged"]).count() == 0
    spans = {tuple(r) for r in decoded(out["tagged"], "raise").collect()}
    assert spans == {(r.row_idx, r.start, r.end, r.category) for r in out["spans"].collect()}
    exact_only = extract(docs, lexicon(spark), Config(kinds=("exact",), basic=True))["spans"]
    assert {r.match_type for r in exact_only.collect()} == {"exact"}


def test_context_filter_discovery_and_extension(spark):
    docs = tokenised(spark.createDataFrame([(0, "lens brightness battery cover"), (1, "picture quality")], "row_idx long, text string"))
    strict = Config(kinds=("exact",), use_context=True, exact_threshold=0.99, trigger_threshold=0.99, fuzzy_threshold=0.99)
    assert [r.canonical for r in extract(docs, lexicon(spark), strict)["spans"].collect()] == ["picture quality"]
    loose = Config(kinds=("exact",), use_context=True, exact_threshold=-1.0, discover=True, discover_threshold=-1.0, discover_margin=0.0, extend=True, extend_threshold=-1.0)
    got = extract(docs, lexicon(spark), loose)["spans"].collect()
    assert {r.row_idx for r in got} == {0, 1} and sum(r.end - r.start for r in got if r.row_idx == 0) == 4
    with pytest.raises(ValueError):
        Config(discover=True)


def greedy(cs):
    """Plain selection: best per place, then best first without overlap; earlier generated first among equals."""
    best = {}
    for c in cs:
        k = (c[0], c[1])
        if k not in best or (c[3], -c[0]) > (best[k][3], -best[k][0]):
            best[k] = c
    taken = []
    for c in sorted(best.values(), key=lambda c: (-c[3], c[0], c[4])):
        if all(c[1] <= t[0] or c[0] >= t[1] for t in taken):
            taken.append(c)
    return {(c[0], c[1], c[2]) for c in taken}


def test_selection_equals_a_plain_model_and_tags_round_trip(spark):
    r, rows, want = random.Random(7), [], {}
    for row in range(80):
        cs = []
        for g in range(r.randrange(1, 9)):
            a = r.randrange(12)
            cs.append((a, a + r.randrange(1, 4), r.choice("xyz"), r.choice([0.8, 0.9, 1.0]), g))
        want[row] = greedy(cs)
        rows += [(row, a, b, c, c, s, "fuzzy", False, False, (0, 0, 0, 0, g)) for a, b, c, s, g in cs]
    schema = "row_idx long, start int, end int, category string, canonical string, score double, match_type string, is_trigger boolean, filtered boolean, gen struct<a:int,b:int,c:int,d:int,e:bigint>"
    spans = without_overlap(spark.createDataFrame(rows, schema))
    got = {}
    for s in spans.collect():
        got.setdefault(s.row_idx, set()).add((s.start, s.end, s.category))
    assert got == want
    texts = spark.createDataFrame([(i, [f"t{k}" for k in range(15)]) for i in range(80)], "row_idx long, tokens array<string>")
    back = {tuple(x) for x in decoded(emitted(texts, spans)).collect()}
    assert back == {(i, *s) for i, ss in want.items() for s in ss}
    joined = merged(spans).collect()
    assert sum(s.end - s.start for s in joined) == sum(b - a for ss in want.values() for a, b, _ in ss)


def test_decoding_invalid_tags(spark):
    df = spark.createDataFrame([(0, ["I-a", "B-a", "I-b", "I-b", "B-b", "I-b", "O", "I-b"])], "row_idx long, tags array<string>")
    assert sorted(map(tuple, decoded(df).collect())) == [(0, 1, 2, "a"), (0, 4, 6, "b")]
    assert sorted(r.pos for r in invalid(df).collect()) == [0, 2, 7]
    with pytest.raises(Exception, match="continues nothing"):
        decoded(df, "raise").collect()


def test_metrics_from_published_like_counts(spark):
    g = [(i, 0, 1, "a") for i in range(142)]
    p = [(i, 0, 1, "a") for i in range(115)] + [(i, 5, 6, "b") for i in range(195)]
    schema = "row_idx long, start int, end int, category string"
    rows = {(r.scope, r.category): r for r in metrics.metrics(spark.createDataFrame(g, schema), spark.createDataFrame(p, schema)).collect()}
    micro = rows["micro", None]
    assert (round(micro.precision, 5), round(micro.recall, 5), round(micro.f1, 5)) == (0.37097, 0.80986, 0.50885)
    # A class that only the prediction has counts in the macro average.
    assert rows["macro", None].f1 == pytest.approx(rows["class", "a"].f1 / 2) and rows["class", "b"].support == 0
    assert rows["weighted", None].f1 == pytest.approx(rows["class", "a"].f1)


def test_agreement_of_equal_and_opposite_raters(spark):
    df = spark.createDataFrame([(i, t, t, t) for i, t in enumerate("OOAB" * 5)], "id int, A1 string, A2 string, A3 string")
    one = agreement.chance_corrected(df, ["A1", "A2", "A3"]).first()
    assert (one.fleiss, one.alpha, one.unanimous) == (1, 1, 1)
    df = spark.createDataFrame([("x", "y"), ("y", "x")] * 3, "A1 string, A2 string")
    assert agreement.cohen(df, ["A1", "A2"]).first().kappa == pytest.approx(-1)


def test_exact_sign_flip_equals_enumeration():
    from itertools import product

    ds = [1, 2, -1, 3, 0, 1]
    every = [sum(s * abs(d) for s, d in zip(signs, ds)) for signs in product((1, -1), repeat=len(ds))]
    assert resample.exact_sign_flip(ds) == pytest.approx(sum(abs(x) >= abs(sum(ds)) for x in every) / len(every))


def test_viterbi_equals_enumeration(spark):
    from itertools import product

    from spanloom.operators.decode import legal

    labels, r = ["O", "B-a", "I-a", "B-b", "I-b"], random.Random(3)
    scores = [[[r.random() for _ in labels] for _ in range(4)] for _ in range(10)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, s array<array<double>>")
    for row in df.select("i", best_tags(labels)("s").alias("t")).collect():
        ok = [p for p in product(labels, repeat=4) if all(legal(a, b) for a, b in zip([None, *p], p))]
        assert tuple(row.t) == max(ok, key=lambda p: sum(scores[row.i][k][labels.index(x)] for k, x in enumerate(p)))


def test_viterbi_of_texts_of_all_lengths_together(spark):
    from spanloom.operators.decode import legal

    labels, r = ["O", "B-a", "I-a", "B-b", "I-b"], random.Random(5)
    moves, seen = [[r.randrange(8) / 4 for _ in labels] for _ in labels], ["O", "B-a", "I-a", "B-b"]
    texts = [[[r.randrange(16) / 8 for _ in labels] for _ in range(n)] for n in (0, 1, 7, 3000, 2, 40, 40, 1)]

    def plain(scores):
        cost = lambda a, b: (moves[labels.index(a)][labels.index(b)] if a else 0) + (0 if legal(a, b) else -1e9) + (0 if b in seen else -1e9)
        total, back = [], []
        for k, row in enumerate(scores):
            reached = [[(total[i] if k else 0) + cost(a, b) for i, a in enumerate(labels if k else [None])] for b in labels]
            back.append([x.index(max(x)) for x in reached])
            total = [max(x) + y for x, y in zip(reached, row)]
        path = [total.index(max(total))] if scores else []
        for b in reversed(back[1:]):
            path.append(b[path[-1]])
        return [labels[i] for i in reversed(path)]

    df = spark.createDataFrame([*enumerate(texts), (8, None)], "i int, s array<array<double>>").coalesce(1)
    got = {row.i: row.t for row in df.select("i", best_tags(labels, moves, seen)("s").alias("t")).collect()}
    assert got == {**{i: plain(t) for i, t in enumerate(texts)}, 8: []}
    odd = spark.createDataFrame([([[0.5, 1.0], [], [0.0, None], [0.0, 1.0, 9.0]],), ([[None, 1.0], None],)], "s array<array<double>>")
    assert [row.t for row in odd.select(best_tags(["O", "B-a"])("s").alias("t")).collect()] == [["B-a", "O", "O", "B-a"], ["B-a", "O"]]


def test_vocabulary_cuts_texts_once_whatever_their_ids(spark):
    cut = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(i):
        cut.add(1)
        return [f"w{(i * 7 + k) % 15_000}" for k in range(40)]

    def want(rows):
        at = {}
        for i, ts in rows:
            for k, t in enumerate(ts):
                at[t] = min(at.get(t, (1 << 70, 0)), (i, k))
        return {t: n + 2 for n, t in enumerate(sorted(at, key=at.get))}

    ids = spark.range(0, 3000, numPartitions=4).select((F.col("id") - 50).alias("row_idx"))
    got = {r.token: r.id for r in splits.vocabulary(ids.withColumn("tokens", words("row_idx"))).collect()}
    assert cut.value == 3000 and got == want((i, [f"w{(i * 7 + k) % 15_000}" for k in range(40)]) for i in range(-50, 2950))
    rows = [((1 << 62) + 5, ["a", "b", "a"]), (-(1 << 63), ["c", "b"]), ((1 << 62) + 4, ["d", "d"]), ((1 << 63) - 1, ["a", "e"]), (3, [])]
    df = spark.createDataFrame([*rows, (None, ["a", "z"]), (7, None)], "row_idx long, tokens array<string>")
    assert {r.token: r.id for r in splits.vocabulary(df).collect()} == {**want(rows), "z": 7}
    assert splits.vocabulary(df.limit(0)).collect() == []


def test_splits_manifests_and_grids(spark):
    df = spark.createDataFrame([(i,) for i in range(1000)], "row_idx long")
    roles = splits.split(df, "row_idx")
    n = {r.role: r["count"] for r in roles.groupBy("role").count().collect()}
    assert n == {"train": 720, "validation": 80, "test": 200} and splits.disjoint(roles, "row_idx").isEmpty()
    pool = splits.budget_pool(roles, "row_idx", 100)
    assert pool.count() == 100 and pool.join(roles, "row_idx").where("role = 'validation'").count() == 80
    m = spark.createDataFrame([("1.0", "a"), ("1", "b"), ("x", "c")], "k string, v string")
    assert [r.v for r in splits.matching(m, "k=1").collect()] == ["a", "b"] and splits.matching(m, "k=x").count() == 1
    got = splits.grid({"a": {"b": 1}, "c": 2}, {"a.b": [1, 2], "c": [3, 4]})
    assert got[1] == {"a": {"b": 1}, "c": 4} and len(got) == 4


def test_a_row_that_meets_two_alternatives_is_there_once(spark, tmp_path):
    from spanloom.plans.queries import QUERIES

    docs = [(4, "de", "src4"), (5, "de", "src4"), (5, "de", "src4"), (4, "en", "src4"), (4, "de", None), (None, "de", "src4")]
    spark.createDataFrame(docs, "doc_id long, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in QUERIES["manifest_filter"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([d for d in docs if d[1] == "de"], key=str)
    m = spark.createDataFrame([("1.0", "a"), ("1", "b"), ("x", "c"), (None, "a")], "k string, v string")
    both = splits.matching_any(m.union(m), ["k=1", "v=a"], ["k=1.0"], ["v=c"])
    assert sorted(r.v for r in both.collect()) == ["a", "a", "b", "b", "c", "c"]
    assert splits.matching_any(m).isEmpty()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "r.csv").write_text('﻿Review_Text,x\n"two\nlines, ""quoted""",1\n,2\nlast,3\n', encoding="utf-8")
    got = tables.read_reviews(spark, str(tmp_path / "r.csv")).orderBy("row_idx").collect()
    assert [(r.row_idx, r.text) for r in got] == [(0, 'two\nlines, "quoted"'), (1, None), (2, "last")]
    (tmp_path / "w.txt").write_bytes("Café\n\nfoo\n".encode("cp1252"))
    assert {r.word for r in words.read_word_sets(spark, [f"file://{tmp_path}/w.txt"]).collect()} == {"café", "foo"}
    cells = spark.createDataFrame([("[('a', 'B-x'), ('b', 'O')]",), ("['O']",), (None,)], "BIO_Tags string")
    assert [r.t for r in cells.select(tables.tag_column(cells).alias("t")).collect()] == [["B-x", "O"], ["O"], []]
    with pytest.raises(ValueError):
        tables.write_result(cells, "/x/y/", ("/x/y",))


def test_stream_gives_what_batches_give(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"the lens {i} of brightness") for i in range(6)], "row_idx long, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = start_stream(stream, lexicon(spark), str(tmp_path / "out"), str(tmp_path / "cp"), Config(kinds=("exact",)))
    q.processAllAvailable()
    q.stop()
    got = {(r.row_idx, tuple(r.tags)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = extract(tokenised(rows), lexicon(spark), Config(kinds=("exact",)))["tagged"]
    assert got == {(r.row_idx, tuple(r.tags)) for r in want.collect()} and len(got) == 6


def test_hash_encoder_is_fixed_and_stops():
    enc = context.hash_encoder(8, longest=2)
    a, b = enc(["x", "y", "z"]), enc(["x", "y", "z"])
    assert (a[0] == b[0]).all() and a[2] is None and abs((a[0] ** 2).sum() - 1) < 1e-9
