"""More queries over the given tables: variants, choices, tags, alignment, statistics of runs and raters, splits and lexicons."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.ordering import numbered
from ..operators import agreement as agr
from ..operators import audit, candidates, context, decode, metrics, resample, select, splits, tags
from ..sources import words
from .extract import extract, tokenised
from .queries import (
    _BENCH, _KEY, _ROLES, BASE, CAND, CENTRES, CHOSEN, DRAWS, LEX, RATED, RATERS, SCORES, SIMPLE, SPANS, TAGS, TOK,
    _centres, _div, _extracted, _found, _hash, _rated, _rounded, _spans, _tagged, documents, lexicon, query, table, texts,
)

_VARIANTS = f"""{TOK}, {LEX},
    flatv AS (SELECT row_idx, unnest(tokens) AS t, unnest(range(len(tokens))) AS pos FROM tok),
    base AS (SELECT *, CASE WHEN ends_with(t, '''s') AND length(t) > 3 THEN substr(t, 1, length(t) - 2) ELSE t END AS o FROM flatv),
    lemma AS (SELECT row_idx, pos, t, CASE WHEN ends_with(o, 'ies') AND length(o) > 4 THEN substr(o, 1, length(o) - 3) || 'y'
        WHEN ends_with(o, 'ses') AND length(o) > 4 THEN substr(o, 1, length(o) - 2)
        WHEN ends_with(o, 's') AND NOT ends_with(o, 'ss') AND length(o) > 3 THEN substr(o, 1, length(o) - 1) ELSE o END AS v FROM base),
    vars AS (SELECT row_idx, pos, t AS v FROM lemma UNION SELECT row_idx, pos, v FROM lemma),
    part AS (SELECT ord, category, norm, unnest(string_split(norm, ' ')) AS w, unnest(range(len(string_split(norm, ' ')))) AS k,
            len(string_split(norm, ' ')) AS n FROM lex WHERE NOT is_regex),
    found AS (SELECT row_idx, pos - k AS s, ord, any_value(category) AS category, any_value(norm) AS norm, any_value(n) AS n
        FROM vars JOIN part ON v = w GROUP BY row_idx, pos - k, ord HAVING count(DISTINCT k) = any_value(n))"""


@query(f"""WITH {_VARIANTS} SELECT DISTINCT row_idx, s AS "start", s + n AS "end", category, norm AS canonical FROM found""")
def variant_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact candidates of all variants of each token, not of the tokens alone."""
    return _found(spark, sf_dir, "exact", basic=False).select("row_idx", "start", "end", "category", "canonical")


@query(f'WITH {SIMPLE} SELECT row_idx, s AS "start", e AS "end", category, canonical, match_type FROM chosen_simple')
def simple_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice by length, score and place alone."""
    spans = _extracted(spark, sf_dir, replace(BASE, evidence_aware=False))["spans"]
    return spans.select("row_idx", "start", "end", "category", "canonical", "match_type")


@query(f"""WITH {CHOSEN}, i AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY row_idx ORDER BY s) AS island FROM (
        SELECT *, coalesce(lag(e) OVER w = s AND lag(category) OVER w = category, false) AS joined FROM chosen WINDOW w AS (PARTITION BY row_idx ORDER BY s)))
    SELECT row_idx, min(s) AS "start", max(e) AS "end", any_value(category) AS category, string_agg(canonical, ' ' ORDER BY s) AS canonical,
        CASE WHEN count(*) > 1 THEN 'compound' ELSE any_value(match_type) END AS match_type FROM i GROUP BY row_idx, island""")
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen spans with adjacent ones of one category put together."""
    spans = select.merged(_extracted(spark, sf_dir)["spans"])
    return spans.select("row_idx", "start", "end", "category", "canonical", "match_type")


@query(f'WITH {CHOSEN} SELECT row_idx, s AS "start", e AS "end", category FROM chosen')
def strict_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of chosen spans decoded again, in the way that fails on invalid tags."""
    return tags.decoded(_extracted(spark, sf_dir)["tagged"], "raise")


@query(f"""WITH {TAGS}, t AS (SELECT row_idx, pos, gold, lag(gold) OVER (PARTITION BY row_idx ORDER BY pos) AS before FROM tagged)
    SELECT row_idx, pos, gold AS tag FROM t WHERE starts_with(gold, 'I-') AND NOT coalesce(before <> 'O' AND substr(before, 3) = substr(gold, 3), false)""")
def invalid_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tags.invalid(_tagged(spark, sf_dir).select("row_idx", F.col("gold").alias("tags")))
    return found.withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {CHOSEN} SELECT c.row_idx, s AS "start", array_to_string(tokens[greatest(1, s - 3):e + 4], ' ') AS snippet FROM chosen c JOIN tok USING (row_idx)""")
def span_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chosen span with four tokens on either side."""
    got = _extracted(spark, sf_dir)
    rows = got["spans"].select("row_idx", "start", "end").join(got["tagged"].select("row_idx", "tokens"), "row_idx")
    return rows.select("row_idx", "start", tags.snippet(F.col("tokens"), F.col("start"), F.col("end")).alias("snippet"))


_PAIRS = [("gold", "one"), ("gold", "two"), ("one", "two")]
_pair = lambda a, b: f"""SELECT '{a}{b}' AS pair, count(x.row_idx) FILTER (y.row_idx IS NOT NULL) AS "both", count(*) FILTER (y.row_idx IS NULL) AS only_a,
    count(*) FILTER (x.row_idx IS NULL) AS only_b FROM {a}_spans x FULL JOIN {b}_spans y ON x.row_idx = y.row_idx AND x."start" = y."start" AND x."end" = y."end" AND x.category = y.category"""  # noqa: E731


@query(f"""WITH {SPANS}, p AS ({' UNION ALL '.join(_pair(a, b) for a, b in _PAIRS)})
    SELECT *, round({_div('2 * "both"', '2 * "both" + only_a + only_b')}, 9) AS f1 FROM p""")
def span_rater_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact spans of three raters against each other."""
    t = _tagged(spark, sf_dir)
    return _rounded(agr.span_agreement({n: _spans(t, n) for n in ("gold", "one", "two")}), "f1")


@query(f"""WITH {SCORES}, u AS (SELECT 'one' AS system, row_idx % 5 AS seed, * FROM out_one UNION ALL SELECT 'two', row_idx % 5, * FROM out_two),
    r AS (SELECT system, seed, {_div('2 * sum(tp)', '2 * sum(tp) + sum(fp) + sum(fn)')} AS f1 FROM u GROUP BY system, seed)
    SELECT system, round(avg(f1), 9) AS mean, round(stddev_samp(f1), 9) AS sd, round(min(f1), 9) AS min, round(max(f1), 9) AS max, count(*) AS runs FROM r GROUP BY system""")
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two systems' F1 over five runs, each on a fifth of the texts."""
    t = _tagged(spark, sf_dir)
    parts = [metrics.outcomes(_spans(t, "gold"), _spans(t, n)).withColumn("system", F.lit(n)) for n in ("one", "two")]
    rows = parts[0].unionByName(parts[1]).withColumn("seed", F.col("row_idx") % 5)
    runs = metrics.scored(metrics.counts(rows, "system", "seed"))
    return _rounded(audit.seed_summary(runs, "system", "f1"), "mean", "sd", "min", "max")


_ACCENT = "[\\x{00C0}-\\x{024F}]"


@query(f"""WITH {TOK}, c AS (SELECT len(list_filter(tokens, lambda t: regexp_matches(t, '{_ACCENT}'))) AS a,
        len(list_filter(tokens, lambda t: regexp_matches(t, '[A-Za-z]') AND NOT regexp_matches(t, '{_ACCENT}'))) AS b FROM tok)
    SELECT round(100 * sum(a)::DOUBLE / sum(a + b), 9) AS script_tokens, round(100 * avg((a > 0 AND b > 0)::INT), 9) AS mixed_texts,
        round(avg(CASE WHEN a + b > 0 THEN 100 * (1 - greatest(a, b)::DOUBLE / (a + b)) ELSE 0.0 END), 9) AS mean_index FROM c""")
def script_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with letters beyond ASCII as the second script."""
    return _rounded(audit.script_mix(documents(spark, sf_dir), _ACCENT), "script_tokens", "mixed_texts", "mean_index")


@query(f"""WITH {TAGS} SELECT row_idx, count(*) AS n, count(*) FILTER (gold = one) AS agreeing FROM tagged WHERE pos < 50 GROUP BY row_idx""")
def aligned_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 tokens' gold tags beside a prediction of whole texts, cut to them."""
    rows = documents(spark, sf_dir).join(_tagged(spark, sf_dir), "row_idx").where(F.size("tokens") > 0)
    rows = rows.join(texts(spark, sf_dir), "row_idx")
    gold = rows.select("row_idx", F.concat(F.lit(" "), "text").alias("text"), F.slice("tokens", 1, 50).alias("tokens"), F.slice("gold", 1, 50).alias("tags"))
    both = metrics.aligned(gold, rows.select("row_idx", "text", "tokens", F.col("one").alias("tags")))
    same = F.size(F.filter(F.arrays_zip("tags", "predicted"), lambda x: x["tags"] == x["predicted"]))
    return both.select("row_idx", F.size("tokens").cast("long").alias("n"), same.cast("long").alias("agreeing"))


_seen = lambda source, where: f"""SELECT DISTINCT norm FROM w, (SELECT ' ' || array_to_string(tokens, ' ') || ' ' AS t FROM {source} WHERE {where}) WHERE contains(t, ' ' || norm || ' ')"""
_kind = lambda s: f"CASE WHEN {s}.norm IS NOT NULL AND e.norm IS NOT NULL THEN 'both' WHEN {s}.norm IS NOT NULL THEN 'source_only' WHEN e.norm IS NOT NULL THEN 'evaluation_only' ELSE 'neither' END"


_TALK = TOK.replace("cleaned AS", "c_cleaned AS").replace("tok AS", "c_tok AS").replace("doc_id AS row_idx", "conv_id AS row_idx").replace("FROM documents", "FROM conversations").replace("FROM cleaned", "FROM c_cleaned")


@query(f"""WITH {TOK},{_BENCH},{_TALK}, {LEX}, w AS (SELECT DISTINCT norm FROM lex WHERE NOT is_regex),
    s1 AS ({_seen('tok', 'true')}), s2 AS ({_seen('c_tok', 'true')}), e AS ({_seen('b_tok', 'true')}),
    l AS (SELECT w.norm, {_kind('s1')} AS x FROM w LEFT JOIN s1 USING (norm) LEFT JOIN e USING (norm)),
    r AS (SELECT w.norm, {_kind('s2')} AS x FROM w LEFT JOIN s2 USING (norm) LEFT JOIN e USING (norm) WHERE length(w.norm) < 8)
    SELECT norm, l.x AS "left", r.x AS "right", CASE WHEN r.norm IS NULL THEN 'only_left' WHEN l.norm IS NULL THEN 'only_right' WHEN l.x = r.x THEN 'same' ELSE 'changed' END AS status
    FROM l FULL JOIN r USING (norm)""")
def exposure_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two audits of exposure, one over documents and one over conversations and of shorter forms alone, held against each other."""
    only = replace(BASE, kinds=("exact",), longest=5)
    seen = lambda docs: extract(docs, lexicon(spark), only)["candidates"].select(F.col("canonical").alias("norm"))
    forms, docs = lexicon(spark).where("not is_regex"), texts(spark, sf_dir)
    bench = seen(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_idx"), "text"))
    talk = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("row_idx"), "text")
    left = audit.exposure(forms, seen(docs), bench)
    right = audit.exposure(forms.where("length(norm) < 8"), seen(talk), bench)
    return audit.reconciled(left, right, "norm", "exposure")


_POOL = f"""pool AS (SELECT doc_id, role FROM role WHERE role <> 'test' QUALIFY row_number() OVER (ORDER BY CASE role WHEN 'validation' THEN 0 ELSE 1 END, {_hash("'pool'", 'doc_id')}, doc_id) <= 100)"""


@query(f"WITH {_ROLES}, {_POOL} SELECT doc_id FROM pool")
def budget_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.budget_pool(splits.split(table(spark, sf_dir, "labels"), "doc_id"), "doc_id", 100)


@query(f"""WITH {_ROLES} SELECT CASE role WHEN 'train' THEN 'supervised_train' WHEN 'validation' THEN 'supervised_validation' ELSE 'not_used' END AS role, count(*) AS n FROM role GROUP BY ALL""")
def renamed_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = splits.split(table(spark, sf_dir, "labels"), "doc_id")
    named = splits.renamed_roles(roles, {"train": "supervised_train", "validation": "supervised_validation"})
    return named.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def not_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled ids that English documents don't have."""
    return splits.contained(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id")


@query(f"""WITH {TOK}, m AS (SELECT doc_id AS row_idx, row_number() OVER (ORDER BY doc_id DESC) - 1 AS manifest_ord FROM documents WHERE doc_id % 7 = 0)
    SELECT manifest_ord, row_idx, len(tokens) AS n_tokens FROM m JOIN tok USING (row_idx)""")
def manifest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a manifest, in its order, which is that of descending ids."""
    docs = documents(spark, sf_dir)
    manifest = numbered(docs.where("row_idx % 7 = 0").select("row_idx"), "manifest_ord", -F.col("row_idx"))
    rows = splits.in_order(docs, manifest)
    return rows.select("manifest_ord", "row_idx", F.size("tokens").cast("long").alias("n_tokens"))


@query("""WITH w AS (SELECT * FROM (VALUES ('good'), ('plain')) s(system), (VALUES (0), (1), (2)) t(seed)),
    r AS (SELECT CASE quality WHEN 1 THEN 'good' ELSE 'plain' END AS system, toxic AS seed, count(*) AS n FROM labels GROUP BY ALL)
    SELECT system, seed, coalesce(n, 0) AS n FROM w FULL JOIN r USING (system, seed) WHERE coalesce(n, 0) <> 1""")
def incomplete_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand for runs: system and seed without exactly one."""
    system = F.when(F.col("quality") == 1, "good").otherwise("plain")
    runs = table(spark, sf_dir, "labels").select(system.alias("system"), F.col("toxic").cast("int").alias("seed"))
    return splits.complete_runs(runs, ["good", "plain"], [0, 1, 2])


@query(f"""WITH {TAGS}, l AS (SELECT DISTINCT gold AS label FROM tagged) SELECT label, row_number() OVER (ORDER BY label <> 'O', label) - 1 AS id FROM l""")
def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.label_map(_tagged(spark, sf_dir), "gold", "O").withColumn("id", F.col("id").cast("long"))


@query(f"""WITH {TAGS}, f AS (SELECT tok AS token, min(row_idx * 1000000 + pos) AS place FROM flat GROUP BY tok) SELECT token, row_number() OVER (ORDER BY place) + 1 AS id FROM f""")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by their first place; 0 and 1 are kept for padding and unknown ones."""
    return splits.vocabulary(documents(spark, sf_dir))


_U = "(SELECT row_number() OVER (ORDER BY rev) - 1 AS place, rev, count(*) OVER () AS n FROM (SELECT DISTINCT rev FROM cl))"


@query(f"""WITH {RATED}, cl AS (SELECT doc_id % 40 AS rev, A1, A2, A3 FROM rated), places AS {_U},
    w AS (SELECT d.d, ({_hash('d.d', 'p.place')} % p.n)::BIGINT AS place, count(*) AS w FROM range({DRAWS}) d(d), places p GROUP BY ALL),
    x AS (SELECT d, rev, w FROM w JOIN places USING (place)),
    it AS (SELECT d, w, unnest(['A1A2', 'A1A3', 'A2A3']) AS pair, unnest([A1, A1, A2]) AS a, unnest([A2, A3, A3]) AS b FROM x JOIN cl USING (rev)),
    c AS (SELECT d, pair, a, b, sum(w) AS n FROM it GROUP BY ALL),
    po AS (SELECT d, pair, sum(n)::DOUBLE AS n, sum(n) FILTER (a = b)::DOUBLE AS same FROM c GROUP BY d, pair),
    pe AS (SELECT l.d, l.pair, sum(l.n * r.n)::DOUBLE AS c FROM (SELECT d, pair, a AS l, sum(n) AS n FROM c GROUP BY ALL) l JOIN (SELECT d, pair, b AS l, sum(n) AS n FROM c GROUP BY ALL) r USING (d, pair, l) GROUP BY l.d, l.pair),
    k AS (SELECT d, avg((same / n - c / (n * n)) / (1 - c / (n * n))) AS kappa, avg(same / n) AS agreement FROM po JOIN pe USING (d, pair) GROUP BY d),
    lab AS (SELECT d, l, sum(w)::DOUBLE AS n FROM (SELECT d, w, unnest([A1, A2, A3]) AS l FROM x JOIN cl USING (rev)) GROUP BY d, l),
    q AS (SELECT d, sum(n * n) AS nn, sum(n) AS al FROM lab GROUP BY d),
    sf AS (SELECT d, pair, 2 * sum(w * (a = b AND a <> 'O')::INT) AS hit, sum(w * ((a <> 'O')::INT + (b <> 'O')::INT)) AS al FROM it GROUP BY d, pair),
    sp AS (SELECT d, avg(CASE WHEN al > 0 THEN hit::DOUBLE / al ELSE 0 END) AS span_f1 FROM sf GROUP BY d),
    s AS (SELECT d, sum(w)::DOUBLE AS n, sum(w * (3 + 2 * ((A1 = A2)::INT + (A1 = A3)::INT + (A2 = A3)::INT)))::DOUBLE AS sq, sum(w * (A1 = A2 AND A2 = A3)::INT)::DOUBLE AS una FROM x JOIN cl USING (rev) GROUP BY d),
    r AS (SELECT d, kappa, agreement, ((sq - n * 3) / (n * 6) - nn / (al * al)) / (1 - nn / (al * al)) AS fleiss, 1 - (al - (sq - n * 3) / 2) / ((al * al - nn) / (al - 1)) AS alpha, una / n AS unanimous, span_f1
        FROM k JOIN q USING (d) JOIN s USING (d) JOIN sp USING (d))
    SELECT statistic, round(avg(v), 9) AS mean, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high
    FROM (UNPIVOT r ON kappa, agreement, fleiss, alpha, unanimous, span_f1 INTO NAME statistic VALUE v) GROUP BY statistic""")
def agreement_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of six statistics of agreement, over 40 groups of items drawn with replacement; a span is an item that isn't ``O``."""
    rated = _rated(spark, sf_dir).withColumn("rev", F.col("doc_id") % 40)
    place = [F.col("rev").alias("row_idx"), F.col("doc_id").alias("start"), (F.col("doc_id") + 1).alias("end")]
    spans = {r: rated.where(F.col(r) != "O").select(*place, F.substring(r, 3, 100).alias("category")) for r in RATERS}
    drawn = agr.cohen_bootstrap(rated, RATERS, "rev", DRAWS, spans=agr.span_counts(spans))
    names = ["kappa", "agreement", "fleiss", "alpha", "unanimous", "span_f1"]
    long = drawn.select(F.inline(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("v")) for n in names])))
    side = lambda q: F.percentile("v", q)
    return _rounded(long.groupBy("statistic").agg(F.avg("v").alias("mean"), side(0.025).alias("low"), side(0.975).alias("high")), "mean", "low", "high")


@query(f"""WITH RECURSIVE {RATED}, di AS (SELECT doc_id % 40 AS rev, sum((A1 = A2)::INT - (A1 = A3)::INT)::BIGINT AS d FROM rated GROUP BY ALL),
    nz AS (SELECT row_number() OVER (ORDER BY rev) AS k, d FROM di WHERE d <> 0),
    ways AS (SELECT 0::BIGINT AS k, 0::BIGINT AS total, 1::DOUBLE AS p UNION ALL
        SELECT w.k + 1, w.total + s.s * nz.d, sum(w.p / 2) FROM ways w JOIN nz ON nz.k = w.k + 1, (VALUES (1), (-1)) s(s) GROUP BY 1, 2),
    o AS (SELECT coalesce(sum(d), 0)::BIGINT AS observed, count(*) FILTER (d <> 0) AS reviews FROM di)
    SELECT any_value(observed) AS observed, any_value(reviews) AS reviews, round(sum(p) FILTER (abs(total) >= abs(observed)), 9) AS p FROM ways, o WHERE k = reviews""")
def sign_flip_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one rater agrees more often with the first than another does, by all flips of 40 groups' differences."""
    same = lambda r: (F.col("A1") == F.col(r)).cast("long")
    by = _rated(spark, sf_dir).groupBy((F.col("doc_id") % 40).alias("rev")).agg(F.sum(same("A2") - same("A3")).alias("difference"))
    return _rounded(resample.sign_flip(by), "p")


@query(None)
def tokenizer_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document fit into 128 pieces, two of them special, by each of two public tokenizers; held to a plain loop by a test."""
    import public_tokenizers

    files = [str(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")]
    words = documents(spark, sf_dir)
    return words.select("row_idx", F.size("tokens").cast("long").alias("n_tokens"), decode.shared_prefix("tokens", files, 128, (2, 2)).cast("long").alias("n_shared"))


_EVALUATION = "(" + ", ".join(f"'{c}'" for c in words.EVALUATION_CATEGORIES if c not in ("general", "network")) + ")"


@query(f"WITH {LEX} SELECT ord, category, norm FROM lex WHERE category IN {_EVALUATION}")
def taxonomy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the evaluation's categories but for two."""
    kept = [c for c in words.EVALUATION_CATEGORIES if c not in ("general", "network")]
    return words.with_taxonomy(lexicon(spark), kept).select("ord", "category", "norm")


@query(f"""WITH {LEX} SELECT count(*) AS entries, count(*) FILTER (NOT is_regex AND NOT is_trigger) AS literals,
    count(DISTINCT norm) FILTER (NOT is_regex AND NOT is_trigger) AS distinct_literals, count(*) FILTER (is_trigger) AS triggers, count(*) FILTER (is_regex) AS regexes FROM lex""")
def lexicon_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.inventory(lexicon(spark))


@query(f"""WITH {_BENCH}, {LEX}, b AS (SELECT DISTINCT unnest(tokens) AS norm FROM b_tok) SELECT ord, category, norm FROM lex WHERE norm NOT IN (SELECT norm FROM b)""")
def pruned_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon without forms that are tokens of ``benchmark``."""
    bench = tokenised(table(spark, sf_dir, "benchmark"), "item_id", "text")
    seen = bench.select(F.explode("tokens").alias("norm"))
    return words.prune(lexicon(spark), seen).select("ord", "category", "norm")


@query(f"WITH {TOK}, d AS (SELECT DISTINCT unnest(tokens) AS token FROM tok) SELECT token, {' OR '.join(f'contains(token, {chr(39)}{m}{chr(39)})' for m in text.REGEX_MARKS)} AS is_regex FROM d")
def regex_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = documents(spark, sf_dir).select(F.explode("tokens").alias("token")).distinct()
    return tokens.select("token", text.looks_like_regex(F.col("token")).alias("is_regex"))


_CTX = f"""{CENTRES}, own AS (SELECT vec_id, own AS label, max(score) FILTER (own = label) AS c, max(score) FILTER (own <> label) AS o FROM near GROUP BY ALL),
    k AS (SELECT vec_id, c, o, (['exact', 'fuzzy', 'regex'])[vec_id % 3 + 1] AS kind, vec_id % 4 = 0 AS trig, vec_id % 2 + 1 AS len FROM own)"""


@query(f"""WITH {_CTX} SELECT vec_id, CASE WHEN kind = 'exact' AND len > 1 THEN true WHEN trig THEN c >= 0.3 WHEN kind = 'fuzzy' THEN c >= 0.5 WHEN len = 1 THEN c >= 0.4 ELSE true END AS by_context,
    (kind = 'exact' AND len > 1) OR c - o >= 0.1 AS by_margin FROM k""")
def context_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stand for candidates: which of them the thresholds on context and on margin keep."""
    rows, centres = _centres(spark, sf_dir)
    near = context.with_similarities(rows.select("vec_id", "label", "embedding"), centres, "embedding")
    most = lambda keep: F.array_max(F.transform(F.filter("scores", keep), lambda s: s["score"]))
    own, other = most(lambda s: s["category"] == F.col("label")), most(lambda s: s["category"] != F.col("label"))
    kind = F.get(F.array(*[F.lit(k) for k in ("exact", "fuzzy", "regex")]), F.col("vec_id") % 3)
    shaped = near.select(
        "vec_id", own.alias("context"), (own - other).alias("margin"), kind.alias("match_type"), (F.col("vec_id") % 4 == 0).alias("is_trigger"),
        F.lit(0).alias("start"), (F.col("vec_id") % 2 + 1).alias("end"),
    )
    return shaped.select("vec_id", context.context_allowed(0.4, 0.3, 0.5).alias("by_context"), context.margin_allowed(0.1).alias("by_margin"))


@query(f"""WITH {CAND}, sel AS (SELECT DISTINCT row_idx, s, e, category FROM cand WHERE match_type = 'exact' AND NOT filtered),
    three AS (SELECT row_idx, s FROM cand WHERE match_type = 'exact' GROUP BY row_idx, s, e HAVING count(DISTINCT category) > 1)
    SELECT (SELECT count(*) FROM sel) AS unfiltered, (SELECT count(*) FROM three) AS ambiguous""")
def candidate_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact candidates that aren't stop words, and places that entries of several categories claim."""
    found = _found(spark, sf_dir, "exact")
    unfiltered = found.where("not filtered").select("row_idx", "start", "end", "category").distinct().agg(F.count(F.lit(1)).alias("unfiltered"))
    several = found.groupBy("row_idx", "start", "end").agg(F.count_distinct("category").alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("ambiguous"))
    return unfiltered.join(F.broadcast(several))  # one row each


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and source stand for a key that should be one row's."""
    return audit.duplicates(table(spark, sf_dir, "documents"), "lang", "source")


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), k AS (SELECT doc_id, {_KEY} AS key FROM l),
    held AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) > 1 UNION SELECT {_KEY.replace('line', 'text')} FROM benchmark)
    SELECT doc_id, count(*) AS lines, count(*) FILTER (key IN (SELECT key FROM held)) AS quarantined FROM k GROUP BY doc_id""")
def quarantine_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document its lines, and how many of them are lines of another document or texts of ``benchmark``, but for case, form and white space."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    keyed = lines.select("doc_id", text.text_key(F.col("line")).alias("key"))
    repeated = keyed.where("key <> ''").groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("key")
    held = repeated.unionByName(table(spark, sf_dir, "benchmark").select(text.text_key(F.col("text")).alias("key")))
    clean = audit.quarantined(keyed, held).groupBy("doc_id").agg(F.count(F.lit(1)).alias("clean"))
    every = keyed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))
    return every.join(clean, "doc_id", "left").select("doc_id", "lines", (F.col("lines") - F.coalesce("clean", F.lit(0))).alias("quarantined"))


_TAG_LABELS = ["O", "B-a", "I-a", "B-b", "I-b"]
_INTO = [[0.25 if a == b else 0.0 if decode.legal(a, b) else decode.NEVER for a in _TAG_LABELS] for b in _TAG_LABELS]
_FIRST = [0.0 if decode.legal(None, b) else decode.NEVER for b in _TAG_LABELS]
_REACH = lambda j: f"list_transform(range(1, 6), lambda i: acc.total[i] + ({_INTO})[{j}][i])"


@query(f"""WITH {TOK}, flat AS (SELECT row_idx, unnest(tokens) AS t, unnest(range(len(tokens))) AS pos FROM tok),
    sc AS (SELECT row_idx, pos, [{', '.join(f"((length(t) * {3 + 2 * j} + pos * {j + 1} + ascii(t)) % 16) / 8.0 + CASE WHEN pos = 0 THEN {_FIRST[j]} ELSE 0.0 END" for j in range(5))}]::DOUBLE[] AS s FROM flat),
    el AS (SELECT row_idx, list({{'total': s, 'back': []::BIGINT[][]}} ORDER BY pos) AS l FROM sc GROUP BY row_idx),
    v AS (SELECT row_idx, list_reduce(l, lambda acc, y: {{'total': list_transform(range(1, 6), lambda j: list_max({_REACH('j')}) + y.total[j]),
            'back': acc.back || [list_transform(range(1, 6), lambda j: list_position({_REACH('j')}, list_max({_REACH('j')})))]}}) AS x FROM el),
    p AS (SELECT row_idx, list_reduce(list_prepend([list_position(x.total, list_max(x.total))]::BIGINT[], list_reverse(x.back)), lambda path, b: list_prepend(b[path[1]], path)) AS path FROM v)
    SELECT row_idx, array_to_string(list_transform(path, lambda i: ({_TAG_LABELS})[i]), ' ') AS tags FROM p""")
def viterbi_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best legal tags of every text, for scores that follow from the tokens."""
    score = lambda t, i, j: F.pmod(F.length(t) * (3 + 2 * j) + i * (j + 1) + F.ascii(t), F.lit(16)) / F.lit(8.0)
    scores = F.transform("tokens", lambda t, i: F.array(*[score(t, i, j) for j in range(5)]))
    step = [[_INTO[j][i] for j in range(5)] for i in range(5)]
    rows = candidates.settled(documents(spark, sf_dir)).where(F.size("tokens") > 0)
    rows = candidates.settled(rows.select("row_idx", scores.alias("scores")))
    return rows.select("row_idx", F.array_join(decode.best_tags(_TAG_LABELS, step)("scores"), " ").alias("tags"))
