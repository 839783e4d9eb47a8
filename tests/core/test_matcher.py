"""Extraction in the row against the joins with the lexicon and plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import morphology, text
from spanloom.functions.lookup import lookup
from spanloom.operators import candidates as joined
from spanloom.operators import fuzzy, matcher, patterns
from spanloom.operators.select import without_overlap
from spanloom.operators.tags import aspects, emitted
from spanloom.plans import extract as plan
from spanloom.sources import words as sources
from tests.core import plain
from tests.core.test_spans import LEXICON

PIECES = [*"aB.,-!'’ \n12٣ß…Σ\t_*@", "..", "ab", "http://x.y ", "WWW.z ", "@me ", "-.", "é", "é", "വില", "യുടെ", "gb", "15000k", "ſ", "​", "İ"]
SHOWN = ["row_idx", "start", "end", "category", "canonical", "match_type", "score"]


def texts(n=400, seed=1):
    r = random.Random(seed)
    own = ["The", "picture", "qualitys", "quality", "lens", "lense", "screens", "brightnes", "8", "gb", "15000k", "12", "rs", "വിലയുടെ", "phone", "memorys", "price", "camera", "of"]
    out = ["".join(r.choice(PIECES) for _ in range(r.randrange(40))) for _ in range(n)]
    return out + [" ".join(r.choice(own) for _ in range(r.randrange(30))) for _ in range(n)] + [None, ""]


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "row_idx long, text string")


def lexicon(spark, *lines):
    return sources.lexicon(spark.createDataFrame(list(enumerate(lines)), "line_no long, line string"))


def entries(spark):
    return lexicon(spark, *LEXICON.splitlines(), "general-", "(?P<x>z", "lens", "the lens", "[0-9]+", "pi.*e quality", "(?:qua|bri)[a-z]+")


def shown(df):
    return {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*SHOWN).collect()}


def test_tokens_and_forms_as_plain_models(spark):
    given = texts(2000)
    got = {r.row_idx: r.tokens for r in matcher.with_tokens(frame(spark, given)).collect()}
    assert all(got[i] == plain.tokens(t) for i, t in enumerate(given)) and sum(map(len, got.values())) > 5000
    tokens = sorted({t for ts in got.values() for t in ts} | {"ponies'", "glasses", "bus's", "വിലയുടെ", "x", "’a!", "Up"})
    t = spark.createDataFrame([(x,) for x in tokens], "t string")
    suffixes = (*morphology.CORE_SUFFIXES, "es")
    got = t.select("t", text.normal(F.col("t")).alias("n"), *[morphology.variants(F.col("t"), suffixes, b).alias(f"v{int(b)}") for b in (False, True)]).collect()
    for r in got:
        assert (r.n, r.v0, r.v1) == (plain.normal(r.t), plain.forms(r.t, suffixes), plain.forms(r.t, suffixes, True)), r.t
    row = spark.createDataFrame([(tokens,), (["a", "b"],), ([],)], "ts array<string>").select(matcher.all_normal(F.col("ts")).alias("n"))
    assert [r.n for r in row.collect()] == [[plain.normal(x) for x in tokens], ["a", "b"], []]


def test_a_dictionary_counts_before_the_rules(spark):
    lemmas = {"mice": "mouse", "news": "news"}
    table = spark.createDataFrame(list(lemmas.items()), "form string, lemma string")
    df = spark.createDataFrame([("mice",), ("news",), ("mice's",), ("cars",)], "token string")
    want = {"mice": "mouse", "news": "news", "mice's": "mouse", "cars": "car"}
    assert {r.token: r.lemma for r in morphology.with_lemmas(df, table).collect()} == want
    found = lookup(table, "form", "lemma")
    assert {r.token: r.l for r in df.select("token", morphology.english_lemma(F.col("token"), found).alias("l")).collect()} == want
    docs, lex = frame(spark, ["two mice here"]), lexicon(spark, "camera-", "mouse")
    spans = lambda **how: plan.extract(docs, lex, plan.Config(kinds=("exact",), **how))["spans"].count()
    assert spans(lemmas=tuple(lemmas.items())) == 1 and spans() == 0


def test_candidates_as_plain_loops_and_by_joins(spark, monkeypatch):
    df, lex, stop = frame(spark, texts(200, 2)), entries(spark), ("the", "of", "lens")
    known = [r.asDict() for r in lex.collect()]
    cut = [(r.row_idx, r.tokens) for r in matcher.with_tokens(df).collect()]
    python = lambda raw: None if raw == "(?P<x>z" else re.compile(raw, re.I)
    for basic, suffixes in ((True, ()), (False, morphology.CORE_SUFFIXES)):
        want = plain.candidates(cut, known, suffixes, basic, patterns=python)
        config = plan.Config(basic=basic, suffixes=tuple(suffixes), use_guard=False)
        got = plan.extract(df, lex, config, stop)["candidates"]
        assert {(*x[:6], x[6]) for x in shown(got)} == want and {x[5] for x in want} == {"exact", "fuzzy", "regex"} and len(want) > 800
        monkeypatch.setattr(plan, "small_lexicon", lambda e: False)
        by_join = plan.extract(df, lex, config, stop)["candidates"]
        columns = [c for c in joined.COLUMNS if c != "gen"]
        text_of = lambda rows: sorted(str(tuple(r)) for r in rows.select(*columns, F.col("gen").cast("string")).collect())
        assert text_of(got) == text_of(by_join)
        monkeypatch.undo()


def test_choice_tags_and_aspects_equal_the_joined_ones(spark):
    df, lex, stop = frame(spark, texts(200, 3)), entries(spark), ("the", "of")
    for simple in (False, True):
        got = plan.extract(df, lex, plan.Config(evidence_aware=not simple), stop)
        tokens = matcher.with_tokens(df)
        rows = joined.analysed(tokens, stop)
        spans = without_overlap(joined.guarded(joined.candidates(rows, lex), rows), simple)
        assert shown(got["spans"]) == shown(spans)
        assert {(r.row_idx, tuple(r.tags)) for r in got["tagged"].collect()} == {(r.row_idx, tuple(r.tags)) for r in emitted(tokens, spans).collect()}
        as_set = lambda rows: {(r.row_idx, str(sorted(r.aspects.items()))) for r in rows}
        assert as_set(got["aspects"].collect()) == as_set(aspects(spans, tokens).collect())
        assert got["spans"].count() > 300


def test_one_scan_no_shuffle_and_no_python_but_nfc(spark, tmp_path):
    spark.createDataFrame([(0, "the lens")], "row_idx long, text string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for name, rows in plan.extract(df, entries(spark)).items():
        shown = rows._jdf.queryExecution().executedPlan().toString()
        assert shown.count("FileScan") == 1 and "Exchange" not in shown and "MapIn" not in shown and shown.count("ArrowEvalPython") == 1, name


def test_every_combination_of_forms_is_tried(spark):
    """Tokens of five forms each; the phrase is the last of 625 combinations."""
    suffixes = ("x", "y")
    word = "ക" * 3
    df = spark.createDataFrame([(0, [f"{word}{a}yxyx" for a in "abcd"])], "row_idx long, tokens array<string>")
    forms = [plain.forms(f"{word}{a}yxyx", suffixes) for a in "abcd"]
    assert all(len(f) > 2 for f in forms)
    lines = [" ".join(f[k] for f in forms) for k in range(min(map(len, forms)))]
    lex = lexicon(spark, "camera-", *lines)
    config = plan.Config(kinds=("exact",), suffixes=suffixes)
    got = plan.extract(df, lex, config)["candidates"]
    assert {r.canonical for r in got.collect()} == set(lines)
    rows = joined.analysed(df, (), suffixes)
    assert shown(joined.candidates(rows, lex, ("exact",)).withColumn("x", F.lit(0))) == shown(got)


def test_large_lexicons_are_joined(spark):
    """Over ``MOST_ENTRIES`` entries, of which texts hold a few."""
    n = matcher.MOST_ENTRIES + 500
    lines = [f"word{i} more{i % 7}" if i % 3 else f"word{i}" for i in range(n)]
    lex = lexicon(spark, "camera-", *lines, "[a-z]+77[a-z]*")
    docs = ["a word3 here", "word4 more4 word4 more5", "word5499 end77", "words word1 word1 more1", None]
    assert not matcher.small_lexicon(lex)
    got = plan.extract(frame(spark, docs), lex, plan.Config(kinds=("exact", "regex")))
    assert {(r.row_idx, r.start, r.end, r.canonical) for r in got["spans"].collect()} == {
        (0, 1, 2, "word3"), (1, 0, 2, "word4 more4"), (2, 0, 1, "word5499"), (2, 1, 2, "end77"), (3, 2, 4, "word1 more1"),
    } - ({(2, 0, 1, "word5499")} if 5499 % 3 else set())
    assert got["tagged"].count() == 5


def test_what_patterns_need():
    assert [patterns.required(p) for p in ("th[a-z]{0,3}sh", "(?:ein|eine) [a-z]*ung", "[0-9]+k?", "(abc|abd)", "x?yz+w", "a b", "(?i)abc", "(z", "\\d+ ?gb", "STRASSE")] == [
        "th", "ein", None, "ab", "yz", None, None, None, "gb", "strasse",
    ]
    assert [patterns.tokens_of(p) for p in ("abc", "a b", "a ?b", "[0-9]+k?", "a.c", "(?:x|y z) w", "(?: a){2,3}", ".*", "\\s", "[^x]", "(z", "\\p{L}")] == [
        (1, 1), (2, 2), (1, 2), (1, 1), (1, 2), (2, 3), (3, 4), (1, patterns.ANY_TOKENS), (1, 2), (1, 2), (1, patterns.ANY_TOKENS), (1, patterns.ANY_TOKENS),
    ]


def test_many_patterns_by_their_literals(spark, monkeypatch):
    r = random.Random(8)
    syllables = ["ka", "lo", "mi", "ru", "se", "ſe", "İ", "te", "9"]
    word = lambda n: "".join(r.choice(syllables) for _ in range(n))
    raws = [f"{word(2)}[a-z]*{word(1)}" for _ in range(150)] + [f"{word(1)} ?{word(2)}+" for _ in range(60)] + ["[0-9]+", "(k)a\\1a?", "(?P<s>lo)(?P=s)", "(bad", ".*mi mi.*"]
    rows = [(i, "general", "general", p, p, [], True, False) for i, p in enumerate(dict.fromkeys(raws))]
    lex = spark.createDataFrame(rows, "ord long, category string, original string, raw string, norm string, tokens array<string>, is_regex boolean, is_trigger boolean")
    docs = [" ".join(word(r.randrange(1, 4)) for _ in range(r.randrange(12))) for _ in range(80)] + ["lolo", "kaka", None]
    df = frame(spark, docs)
    cut = [(x.row_idx, [plain.normal(t) for t in x.tokens]) for x in matcher.with_tokens(df).collect()]
    compiled = {p: re.compile(p, re.I) for p in raws if p != "(bad"}
    want = {(i, s, s + n, " ".join(ts[s : s + n]), p) for i, ts in cut for s in range(len(ts)) for n in range(1, min(4, len(ts) - s) + 1) for p, c in compiled.items() if c.fullmatch(" ".join(ts[s : s + n]))}
    rows = joined.analysed(matcher.with_tokens(df), (), (), True)
    hits = lambda rows: {(x.row_idx, x.start, x.start + x.n, x.entry.norm) for x in rows.collect()}
    known = patterns.index(lex)
    assert known.by_gram is not None
    in_row = rows.select("row_idx", F.inline(patterns.in_row(F.col("norms"), known, 4)))
    by_join = patterns.joined(rows, lex, 4)
    assert hits(in_row) == hits(by_join) == {(i, a, b, p) for i, a, b, _, p in want} and len(want) > 100
    assert in_row.count() == by_join.count() == len(want)


def test_similar_words_as_all_pairs(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("aabcde") for _ in range(r.randrange(1, 12)))
    forms = {word() for _ in range(150)} | {"camera", "battery", "വിലയുടെ", ""}
    targets = {word() for _ in range(150)} | {"cameras", "batery", "വിലയുട", "cmaera"}
    forms |= {t[:-1] + "x" for t in list(targets)[:60]} | {t[0] + t[2:3] + t[1:2] + t[3:] for t in list(targets)[:60] if t}
    for cutoff in (0.75, 0.6, 0.95, 0.1):
        got = fuzzy.similar(spark.createDataFrame([(f,) for f in [*forms, *forms]], "form string"), spark.createDataFrame([(t,) for t in targets], "word string"), cutoff)
        want = {(f, t, round(plain.passes(f, t, cutoff), 9)) for f in forms for t in targets if plain.passes(f, t, cutoff)}
        assert {(x.form, x.word, round(x.score, 9)) for x in got.collect()} == want and got.count() == len(want) >= (0 if cutoff > 0.9 else 40)


def test_ablation_shares_one_pass_and_tells_what_parts_do(spark):
    docs = ["the lens is good", "lenses", "the", "lense of 8 gb", "9 phone"]
    df, lex = frame(spark, docs), entries(spark)
    gold = spark.createDataFrame([(0, 1, 2, "camera"), (1, 0, 1, "camera"), (3, 2, 4, "memory")], "row_idx long, start int, end int, category string")
    got = {r.system: r for r in plan.ablation(df, lex, gold, plan.Config(), ("the", "good")).collect()}
    assert set(got) == {f"without_{x}" for x in ("morphology", "stop_filter", "category_guard", "evidence_rank", "exact", "fuzzy", "regex")}
    base = plan.systems(df, lex, plan.ablations(plan.Config()), ("the", "good"))
    for name, config in plan.ablations(plan.Config()).items():
        own = plan.extract(df, lex, config, ("the", "good"))["spans"].select("row_idx", "start", "end", "category")
        assert {tuple(r) for r in base.where(F.col("system") == name).drop("system").collect()} == {tuple(r) for r in own.collect()}, name
    assert got["without_exact"].effect == "helps" and got["without_fuzzy"].effect == "hurts"


def test_stretches_of_any_shape_are_chosen_as_by_one_loop(spark):
    """Candidates of up to five tokens that touch, nest and chain."""
    r, rows, want = random.Random(4), [], {}
    for i in range(150):
        cs = []
        for g in range(r.randrange(25)):
            a = r.randrange(40)
            cs.append((a, a + r.randrange(1, 6), "c", r.choice([0.8, 0.9, 1.0]), r.random() < 0.2, g))
        rows += [(i, a, b, c, str(g), s, "fuzzy", False, f, (0, 0, 0, 0, g)) for a, b, c, s, f, g in cs]
        best = {}
        for c in sorted(cs, key=lambda c: (-c[3], c[5])):
            best.setdefault(c[:2], c)
        taken = []
        for c in sorted(best.values(), key=lambda c: (-c[3], c[0], c[5])):
            if not c[4] and all(c[1] <= t[0] or t[1] <= c[0] for t in taken):
                taken.append(c)
        want[i] = sorted((c[0], c[1], str(c[5])) for c in taken)
    schema = "row_idx long, start int, end int, category string, canonical string, score double, match_type string, is_trigger boolean, filtered boolean, gen struct<a:int,b:int,c:int,d:bigint,e:bigint>"
    got = {}
    for x in without_overlap(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(x.row_idx, []).append((x.start, x.end, x.canonical))
    assert got == {i: w for i, w in want.items() if w}


def test_invalid_configurations():
    with pytest.raises(ValueError):
        plan.Config(kinds=("other",))
