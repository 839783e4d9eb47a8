"""Numbering, resampling, agreement, splits, alignment and records, against plain loops."""

import hashlib
import json
import os
import random
from collections import Counter
from itertools import combinations, product

import numpy as np
import pyspark
import pytest
from pyspark.sql import functions as F

from spanloom.functions.ordering import numbered
from spanloom.operators import agreement, audit, context, decode, metrics, resample, splits, tags
from spanloom.plans import queries
from spanloom.sources import tables, words


def draw(seed, d, slot):
    return int(hashlib.md5(f"{seed}|{d}|{slot}".encode()).hexdigest()[:8], 16)


def test_numbers_are_those_of_one_order(spark):
    r = random.Random(1)
    for keys in ([], [5], [None, None], [r.choice([None, -3, 7, 7, 10**12, 5]) for _ in range(60)], [r.randrange(10**6) for _ in range(500)]):
        rows = [(i, k) for i, k in enumerate(keys)]
        df = spark.createDataFrame(rows, "i int, k long").repartition(3)
        got = {x.i: x.place for x in numbered(df, "place", F.col("k"), "i").collect()}
        want = {i: p for p, (i, k) in enumerate(sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0])))}
        assert got == want


def counts(spark, n=30):
    r = random.Random(2)
    rows = [(i, *[r.randrange(4) for _ in range(6)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "place long, " + ", ".join(f"{c} long" for c in resample.PAIR))


def f1(tp, fp, fn):
    return 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0


def test_bootstrap_and_randomization_equal_plain_loops(spark):
    rows, df = counts(spark)
    got = {r.draw: r.delta for r in resample.bootstrap_deltas(df, 7).collect()}
    for d in range(7):
        s = np.sum([rows[draw(42, d, k) % len(rows)][1:] for k in range(len(rows))], axis=0)
        assert got[d] == pytest.approx(f1(*s[:3]) - f1(*s[3:]))
    one = resample.randomization(df, 50).first()
    total = np.sum([r[1:] for r in rows], axis=0)
    seen = f1(*total[:3]) - f1(*total[3:])
    deltas = []
    for d in range(50):
        s = np.sum([(r[4:] + r[1:4]) if draw(42, d, r[0]) % 2 else r[1:] for r in rows], axis=0)
        deltas.append(f1(*s[:3]) - f1(*s[3:]))
    assert one.observed == pytest.approx(seen)
    assert one.two_sided == pytest.approx((sum(abs(x) >= abs(seen) - 1e-12 for x in deltas) + 1) / 51)
    assert one.one_sided == pytest.approx((sum(x >= seen - 1e-12 for x in deltas) + 1) / 51)


def kappa(pairs):
    n = len(pairs)
    po = sum(a == b for a, b in pairs) / n
    left, right = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    pe = sum(left[c] * right[c] for c in left) / n**2
    return (po - pe) / (1 - pe)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_agreement_bootstrap_equals_plain_loops(spark, kind):
    r = random.Random(3)
    raters = ["A1", "A2", "A3"]
    rows = []
    for i in range(120):
        t = r.choice(["O", "O", "B-x", "B-y"])
        rows.append((i % 12 if kind == "long" else f"g{i % 12:02}", *[t if r.random() < 0.8 else r.choice(["O", "B-x", "B-y"]) for _ in raters]))
    df = spark.createDataFrame(rows, f"g {kind}, A1 string, A2 string, A3 string")
    got = {x.draw: x for x in agreement.cohen_bootstrap(df, raters, "g", 6).collect()}
    groups = sorted({x[0] for x in rows})
    order = groups if kind == "long" else [x.g for x in numbered(df.select("g").distinct(), "p", F.xxhash64("g"), "g").orderBy("p").collect()]
    for d in range(6):
        picked = [order[draw(42, d, k) % len(order)] for k in range(len(order))]
        items = [x[1:] for g in picked for x in rows if x[0] == g]
        ks = [kappa([(x[i], x[j]) for x in items]) for i, j in combinations(range(3), 2)]
        assert got[d].kappa == pytest.approx(np.mean(ks))
        assert got[d].agreement == pytest.approx(np.mean([x[i] == x[j] for x in items for i, j in combinations(range(3), 2)]))
        assert got[d].unanimous == pytest.approx(np.mean([len(set(x)) == 1 for x in items]))
        n, m = len(items), 3
        per = [Counter(x) for x in items]
        p_bar = np.mean([(sum(v * v for v in c.values()) - m) / (m * (m - 1)) for c in per])
        share = Counter(x for y in items for x in y)
        p_e = sum((v / (n * m)) ** 2 for v in share.values())
        assert got[d].fleiss == pytest.approx((p_bar - p_e) / (1 - p_e))
        total = n * m
        observed = 1 - p_bar
        expected = (total**2 - sum(v * v for v in share.values())) / (total * (total - 1))
        assert got[d].alpha == pytest.approx(1 - observed / expected)


def test_spans_are_drawn_with_their_groups(spark):
    r = random.Random(8)
    rows = [(i % 7, i, *[r.choice(["O", "B-x", "B-y"]) for _ in range(3)]) for i in range(70)]
    df = spark.createDataFrame(rows, "g long, i long, A1 string, A2 string, A3 string")
    cut = lambda c: df.where(F.col(c) != "O").select(F.col("g").alias("row_idx"), F.col("i").alias("start"), (F.col("i") + 1).alias("end"), F.col(c).alias("category"))
    spans = agreement.span_counts({c: cut(c) for c in ("A1", "A2", "A3")})
    stray = spark.createDataFrame([(99, "A1A2", 5, 5, 5)], "row_idx long, pair string, tp long, fp long, fn long")
    got = {x.draw: x.span_f1 for x in agreement.cohen_bootstrap(df, ["A1", "A2", "A3"], "g", 5, spans=spans.unionByName(stray)).collect()}
    for d in range(5):
        items = [x[2:] for k in range(7) for x in rows if x[0] == draw(42, d, k) % 7]
        per = []
        for i, j in combinations(range(3), 2):
            tp = sum(x[i] == x[j] != "O" for x in items)
            per.append(f1(tp, sum(x[j] != "O" for x in items) - tp, sum(x[i] != "O" for x in items) - tp))
        assert got[d] == pytest.approx(np.mean(per))


def test_sign_flips_equal_enumeration_and_stay_exact(spark):
    r = random.Random(9)
    frame = lambda ds: spark.createDataFrame([(d,) for d in ds], "difference long")
    for ds in ([], [0, None], [3], [2, -1, 0, 5, None, -4], [r.randrange(-6, 7) for _ in range(11)]):
        real = [d for d in ds if d]
        sums = [sum(s * abs(d) for s, d in zip(signs, real)) for signs in product((1, -1), repeat=len(real))]
        got = resample.sign_flip(frame(ds)).first()
        assert (got.observed, got.reviews) == (sum(real), len(real))
        assert got.p == pytest.approx(sum(abs(x) >= abs(sum(real)) for x in sums) / len(sums), abs=1e-15)
    ds = [r.choice([-2, -1, 1, 1, 2, 3]) for _ in range(61)]
    assert resample.sign_flip(frame(ds)).first().p == pytest.approx(resample.exact_sign_flip(ds), rel=1e-12)
    with pytest.raises(Exception, match="counted exactly"):
        resample.sign_flip(frame([1] * 127)).collect()


def test_prefixes_fit_all_tokenizers(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    files = [public.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")]
    cut = [Tokenizer.from_file(f) for f in files]
    r = random.Random(10)
    texts = [[], ["x"], ["antidisestablishmentarianism"] * 9, *[[r.choice(["the", "Größe", "മലയാളം", "12345", "it's", "unbelievable"]) for _ in range(r.randrange(1, 200))] for _ in range(20)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, tokens array<string>")
    got = {x.i: x.n for x in df.select("i", decode.shared_prefix("tokens", files, 40, (2, 1)).alias("n")).collect()}
    fits = lambda t, n: all(len(c.encode(t[:n], is_pretokenized=True, add_special_tokens=False).ids) <= 40 - s for c, s in zip(cut, (2, 1))) if n else True
    for i, t in enumerate(texts):
        assert got[i] == max(n for n in range(len(t) + 1) if fits(t, n))
    assert got[len(texts)] == 0


@pytest.mark.parametrize("stop", [0, 1, 2, 3, None])
@pytest.mark.parametrize("first", [False, True])
def test_a_stopped_replacement_leaves_one_whole_table(spark, tmp_path, monkeypatch, stop, first):
    path = str(tmp_path / "t")
    if not first:
        spark.range(3).write.parquet(path)
    moves, real = [], tables._moved

    def moved(*args):
        if stop is not None and len(moves) == stop:
            raise RuntimeError("stopped")
        moves.append(args)
        real(*args)

    monkeypatch.setattr(tables, "_moved", moved)
    new = spark.range(5) if first else spark.read.parquet(path).selectExpr("id + 10 AS id")
    if stop is not None and stop < (1 if first else 2):
        with pytest.raises(RuntimeError):
            tables.replace_result(new, path)
    else:
        tables.replace_result(new, path)
    monkeypatch.setattr(tables, "_moved", real)
    tables.recover(spark, path)
    assert tables.recover(spark, path) == "clean" and [p.name for p in tmp_path.iterdir()] == ["t"]
    got = sorted(x.id for x in spark.read.parquet(path).collect())
    assert got == (list(range(5)) if first else [0, 1, 2] if stop == 0 else [10, 11, 12])


def test_an_unfinished_staging_goes(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(2).write.parquet(path)
    (tmp_path / "t.staging").mkdir()
    (tmp_path / "t.staging" / "part-0").write_text("half")
    assert tables.recover(spark, path) == "taken back" and spark.read.parquet(path).count() == 2


def test_boards_read_the_gold_once_and_keep_empty_systems(spark):
    schema = "row_idx long, start int, end int, category string"
    gold = spark.createDataFrame([(0, 0, 1, "a"), (0, 0, 1, "a"), (1, 2, 3, "b")], schema)
    found = spark.createDataFrame([(0, 0, 1, "a"), (1, 2, 3, "a")], schema)
    got = {r.system: r for r in metrics.leaderboard(gold, {"x": found, "none": found.limit(0)}).collect()}
    assert (got["x"].precision, got["x"].recall, got["x"].support) == (0.5, 0.5, 2)
    assert (got["none"].f1, got["none"].support) == (0.0, 2)
    empty = {r.scope: r for r in metrics.metrics(gold.limit(0), found.limit(0)).collect()}
    assert set(empty) == {"micro", "macro", "weighted"} and empty["macro"].f1 == 0.0


def test_alignment_compares_tokens_tags_and_texts(spark):
    gold = spark.createDataFrame([(0, "Café  x", ["cafe", "x"], ["O", "B-a"])], "row_idx long, text string, tokens array<string>, tags array<string>")
    good = spark.createDataFrame([(0, " Café x ", ["cafe", "x", "y"], ["O", "O", "O"])], gold.schema)
    assert [r.predicted for r in metrics.aligned(gold, good).collect()] == [["O", "O"]]
    for bad in (good.withColumn("text", F.lit("café x")), good.withColumn("tokens", F.array(F.lit("cafe"), F.lit("z"))), good.withColumn("tags", F.array(F.lit("O"))), good.limit(0)):
        with pytest.raises(Exception, match="align"):
            metrics.aligned(gold, bad).collect()
    with pytest.raises(Exception, match="differ in number"):
        tables.checked_gold(gold.withColumn("tags", F.array(F.lit("O")))).collect()
    assert tables.checked_gold(gold).count() == 1


def test_label_maps_and_vocabularies(spark):
    df = spark.createDataFrame([(7, ["b", "a", "b"], ["O", "B-x", "I-x"]), (3, ["c", "b"], ["O", "B-a"])], "row_idx long, tokens array<string>, tags array<string>")
    ids = lambda d, k: [r[0] for r in sorted(d.collect(), key=lambda r: r[1])] if k else None
    assert ids(splits.label_map(df), 1) == ["B-a", "B-x", "I-x", "O"] and ids(splits.label_map(df, first="O"), 1) == ["O", "B-a", "B-x", "I-x"]
    assert {r.token: r.id for r in splits.vocabulary(df).collect()} == {"c": 2, "b": 3, "a": 4}


def test_seed_plans_resume_and_hold_their_sources(spark):
    plan = splits.seed_plan(spark, ["m", "x"], [3003, 4000])
    assert [(r.system, r.seed, r.keep_model) for r in plan.collect()] == [("m", 3003, True), ("x", 3004, True), ("m", 4000, False), ("x", 4001, False)]
    runs = spark.createDataFrame([("m", 3003, True), ("q", 1, False)], "system string, seed int, complete boolean")
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    assert {(r.system, r.seed) for r in splits.to_run(plan, runs, files, files).collect()} == {("x", 3004), ("m", 4000), ("x", 4001)}
    for now in (files.limit(1), files.withColumn("sha256", F.lit("9"))):
        with pytest.raises(ValueError, match="changed"):
            splits.to_run(plan, runs, files, now)
    with pytest.raises(ValueError, match="begun"):
        splits.to_run(plan, spark.createDataFrame([("x", 4001, False)], runs.schema), files, files)
    found = {(r.system, r.seed): r.n for r in splits.complete_runs(runs, ["m"], [3003, 5]).collect()}
    assert found == {("m", 5): 0}


def test_manifests_in_order_renamed_and_contained(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "row_idx long, text string")
    manifest = spark.createDataFrame([(3, 0), (1, 1)], "row_idx long, manifest_ord long")
    assert [r.text for r in splits.in_order(rows, manifest).orderBy("manifest_ord").collect()] == ["t3", "t1"]
    assert [r.row_idx for r in splits.contained(manifest, rows.where("row_idx < 3"), "row_idx").collect()] == [3]
    roles = spark.createDataFrame([("train",), ("test",)], "role string")
    assert [r.role for r in splits.renamed_roles(roles, {"train": "used"}).collect()] == ["used", "not_used"]
    results = spark.createDataFrame([(2, 0.5, 0.5, 0.5), (1, 0.5, 0.5, 0.5), (3, 0.5, 0.4, 0.9)], "config_id int, f1 double, precision double, recall double")
    assert splits.best_config(results).first().config_id == 1


def test_prefixes_pieces_and_snippets(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 2, 2]), ([], []), ([9], [1])], "a array<int>, b array<int>")
    got = [r[0] for r in df.select(decode.common_prefix([F.col("a"), F.col("b")], 6, [2, 1])).collect()]
    assert got == [2, 0, 0]
    one = spark.createDataFrame([([0, 0, None, 1], ["B-a", "O"])], "w array<int>, t array<string>")
    assert one.select(decode.piece_labels(F.col("w"), F.col("t"), "-100")).first()[0] == ["B-a", "-100", "-100", "O"]
    text = spark.createDataFrame([([str(i) for i in range(12)],)], "t array<string>")
    assert text.select(tags.snippet(F.col("t"), F.lit(5), F.lit(6))).first()[0] == "1 2 3 4 5 6 7 8 9"


def test_audits(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "k string, v int")
    b = spark.createDataFrame([("y", 3), ("z", None), ("w", 1)], "k string, v int")
    assert {r.k: r.status for r in audit.reconciled(a, b, "k", "v").collect()} == {"x": "only_left", "y": "changed", "z": "same", "w": "only_right"}
    assert [r.k for r in audit.duplicates(a.union(b), "k").orderBy("k").collect()] == ["y", "z"]
    mix = audit.script_mix(spark.createDataFrame([(["വില", "abc", "12"],), (["abc"],)], "tokens array<string>")).first()
    assert (round(mix.script_tokens, 4), mix.mixed_texts, mix.mean_index) == (33.3333, 50.0, 25.0)
    spans = spark.createDataFrame([(0, 0, 1, "a")], "row_idx long, start int, end int, category string")
    got = agreement.span_agreement({"p": spans, "q": spans, "r": spans.limit(0)})
    assert {r.pair: (r.both, r.f1) for r in got.collect()} == {"pq": (1, 1.0), "pr": (0, 0.0), "qr": (0, 0.0)}


def test_vectors_without_rows_or_centroids(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("category_centroids", "nearest_category", "category_margin"):
        assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "k int, vector array<double>")
    centres = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.0, 0.0])], "category string, centroid array<double>")
    got = context.two_best(rows, centres, "k").collect()
    assert [(r.k, r.category, round(r.score, 6), round(r.margin, 6)) for r in got] == [(2, "b", 0.8, 0.2)]
    allowed = spark.createDataFrame([(0.05, "exact", 0, 2), (0.05, "exact", 0, 1), (0.2, "fuzzy", 0, 1), (None, "regex", 0, 1)], "margin double, match_type string, start int, end int")
    assert [r[0] for r in allowed.select(context.margin_allowed(0.1)).collect()] == [True, False, True, True]


def test_records_hashes_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "sub").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a")
    (tmp_path / "in" / "sub" / "b.txt").write_text("b")
    hashes = {os.path.basename(r.path): r.sha256 for r in tables.file_hashes(spark, f"{tmp_path}/in", recursive=True).collect()}
    assert tables.versions(["pyspark", "no-such-package"]) == {"pyspark": pyspark.__version__, "no-such-package": None}
    assert hashes == {f"{x}.txt": hashlib.sha256(x.encode()).hexdigest() for x in "ab"}
    files = tables.file_hashes(spark, f"{tmp_path}/in", recursive=True)
    manifest = files.select("path", F.upper(F.when(F.col("path").endswith("b.txt"), F.lit("0")).otherwise(F.col("sha256"))).alias("sha256"))
    manifest = manifest.union(spark.createDataFrame([("gone", "1")], "path string, sha256 string"))
    assert sorted(r.status for r in tables.verified(manifest, files).collect()) == ["changed", "missing", "ok"]
    record = tables.run_record(spark, f"{tmp_path}/r.json", {"k": "വില"}, "in", "out", [f"{tmp_path}/in/a.txt"])
    assert json.loads((tmp_path / "r.json").read_text(encoding="utf-8")) == record and list(record["resources"].values()) == [hashes["a.txt"]]
    with pytest.raises(Exception):
        tables.write_text(spark, f"{tmp_path}/r.json", "again")
    df = spark.createDataFrame([(1, ["a"], 'q"x')], "n int, l array<string>, s string").coalesce(1)
    tables.write_result(df, f"{tmp_path}/bom", kind="csv-bom")
    (part,) = [p for p in (tmp_path / "bom").iterdir() if p.suffix == ".csv"]
    assert part.read_bytes().startswith(b"\xef\xbb\xbfn,l,s") and "q" in part.read_text(encoding="utf-8-sig")
    tables.write_result(df, f"{tmp_path}/json", kind="json")
    assert spark.read.json(f"{tmp_path}/json").first().l == ["a"]
    assert words.with_taxonomy(spark.createDataFrame([("camera",), ("laptop",)], "category string")).count() == 1


@pytest.mark.skipif("SPANLOOM_LEXICON" not in os.environ, reason="the published lexicon is no part of this repository")
def test_published_lexicon_counts(spark):
    entries = words.lexicon(words.read_lines(spark, os.environ["SPANLOOM_LEXICON"]))
    one = words.inventory(entries).first()
    assert (one.entries, one.literals, one.distinct_literals, one.triggers, one.regexes) == (553, 529, 517, 18, 6)
    by = {r.category: r["count"] for r in entries.groupBy("category").count().collect()}
    assert len(by) == 18 and (by["phone"], by["display"], by["general"]) == (190, 84, 63)
