"""Queries over the given tables, each with the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import morphology, text
from ..functions.joins import small
from ..operators import agreement as agr
from ..operators import audit, candidates, context, grid, matcher, metrics, resample, select, splits, tags
from ..sources import tables
from .extract import Config, ablations, extract, systems, tokenised

#: The lexicon of the queries: order, category, form, whether a pattern, whether a trigger.
LEXICON = [
    (0, "camera", "the and", False, False),
    (1, "camera", "erinst", False, False),
    (2, "battery", "of the", False, False),
    (3, "battery", "und der", False, False),
    (4, "price", "avec", False, False),
    (5, "price", "gaja", False, False),
    (6, "display", "und", False, True),
    (7, "display", "of the er", False, False),
    (8, "network", "und", False, False),
    (9, "network", "the and the", False, False),
    (10, "camera", "th[a-z]{0,3}sh", True, False),
    (11, "general", "(?:ein|eine) [a-z]*ung", True, False),
    (12, "memory", "[0-9]+", True, False),
    (13, "price", "[0-9]+k?", True, False),
    (14, "phone", "[0-9]+k?", True, False),
    (15, "general", "avec", False, False),
    (16, "network", "dan", False, False),
    (17, "camera", "elle de la", False, False),
]
STOP = ("the", "of", "und", "der")
SUFFIXES = ("tion", "ung", "ment", "er", "es", "e")
RATERS = ["A1", "A2", "A3"]
DRAWS = 200

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def with_long_places(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("long") for c in ("start", "end") if c in df.columns})

        QUERIES[f.__name__] = with_long_places
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(texts(spark, sf_dir))


def lexicon(spark: SparkSession) -> DataFrame:
    rows = [(o, c, c, f, f, [] if r else f.split(" "), r, t) for o, c, f, r, t in LEXICON]
    return spark.createDataFrame(rows, "ord long, category string, original string, raw string, norm string, tokens array<string>, is_regex boolean, is_trigger boolean")


# Parts of SQL.
_EDGE, _SPACE = text.EDGE.replace("'", "''"), text.SPACE
_STRIP = lambda x, c: f"regexp_replace({x}, '^[{c}]+|[{c}]+$', '', 'g')"
_EDGED = _STRIP(_STRIP(f"regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')", _EDGE), "-")
_DOT = lambda x: f"regexp_replace({x}, '(^|[^\\p{{Nd}}.])\\.([^\\p{{Nd}}.]|$)', '\\1' || chr(1) || '\\2', 'g')"
_DOTS = _DOT(_DOT("regexp_replace(e, '\\.{2,}', chr(1), 'g')"))
TOK = rf"""
    cleaned AS (SELECT doc_id AS row_idx, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
            regexp_replace(nfc_normalize(coalesce(text, '')), '[\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}]', '', 'g'),
            '{text.URL}', ' ', 'g'), '(^|[^\p{{L}}\p{{N}}_])@[A-Za-z0-9_]+', '\1 ', 'g'),
            '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents),
    tok AS (SELECT row_idx, list_filter(list_transform(flatten(list_transform(list_transform(
            regexp_split_to_array(t, '{text.BREAKS}+'), lambda x: {_EDGED}),
            lambda e: CASE WHEN contains(e, '.') AND NOT regexp_full_match(e, '\p{{Nd}}+(?:\.\p{{Nd}}+)+')
                THEN list_transform(string_split({_DOTS}, chr(1)), lambda x: {_STRIP('x', _EDGE)}) ELSE [e] END)),
            lambda x: lower(x)), lambda x: x <> '') AS tokens FROM cleaned)"""
LEX = "lex(ord, category, norm, is_regex, is_trigger) AS (VALUES " + ", ".join(
    f"({o}, '{c}', '{f}', {str(r).lower()}, {str(t).lower()})" for o, c, f, r, t in LEXICON
) + ")"
_words = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_near = lambda r, ws: f"list_has_any(tokens[greatest(1, s + 1 - {r}):s + n + {r}], {_words(ws)})"
_NUM = "[0-9]+(?:\\.[0-9]+)?"
WIN = f"""
    win AS (SELECT row_idx, s, s + n AS e, n, array_to_string(tokens[s + 1:s + n], ' ') AS surface,
            list_bool_and(list_transform(tokens[s + 1:s + n], lambda x: x IN ({_words(STOP)[1:-1]}))) AS filtered,
            CASE WHEN n = 1 AND regexp_full_match(tokens[s + 1], '{_NUM}') THEN {_near(1, candidates.MEMORY_WORDS)} ELSE false END AS by_memory,
            CASE WHEN n = 1 AND regexp_full_match(tokens[s + 1], '{_NUM}') THEN {_near(2, candidates.PRICE_WORDS)} ELSE false END AS by_price
        FROM (SELECT row_idx, tokens, n, unnest(range(len(tokens) - n + 1)) AS s
              FROM tok, (VALUES (1), (2), (3), (4)) AS v(n) WHERE len(tokens) >= n))"""
CAND = f"""{TOK}, {LEX}, {WIN},
    hit AS (
        SELECT win.*, category, norm, norm AS canonical, is_trigger, 'exact' AS match_type, 0 AS a, -n AS b, s AS c, 0 AS d, ord
        FROM win JOIN lex ON NOT is_regex AND surface = norm
        UNION ALL
        SELECT win.*, category, norm, surface, is_trigger, 'regex', 2, ord, -n, s, ord
        FROM win JOIN lex ON is_regex AND regexp_full_match(surface, norm)),
    cand AS (SELECT * FROM hit
        WHERE NOT regexp_full_match(surface, '{_NUM}') OR CASE category WHEN 'phone' THEN false
            WHEN 'memory' THEN by_memory WHEN 'price' THEN by_price ELSE true END)"""
_EVIDENCE = "CASE WHEN match_type = 'exact' AND e - s > 1 THEN 5 WHEN match_type = 'exact' THEN 4 ELSE 3 END"
_GUARD = "NOT (category = 'phone' AND regexp_full_match(surface, '[0-9]+(?:\\.[0-9]+)?k?'))"


def _best(name: str = "", rank: str = _EVIDENCE, guard: str = _GUARD, kinds: str = "'exact', 'regex'", cand: str = "cand") -> str:
    return f"""
    ranked{name} AS (SELECT *, {rank} AS ev FROM {cand} WHERE match_type IN ({kinds}) AND {guard}),
    best{name} AS (SELECT * FROM ranked{name}
        QUALIFY row_number() OVER (PARTITION BY row_idx, s, e ORDER BY ev DESC, a, b, c, d, ord) = 1)"""


def _greedy(name: str = "", stop: str = "NOT filtered") -> str:
    """Greedy choice: a step for each span of a text, in order of preference."""
    return f"""
    ordered{name} AS (SELECT row_idx, list({{'s': s, 'e': e, 'category': category, 'canonical': canonical, 'match_type': match_type}}
            ORDER BY ev DESC, s, a, b, c, d, ord) AS l FROM best{name} WHERE {stop} GROUP BY row_idx),
    picked{name} AS (SELECT row_idx, unnest(list_reduce(list_transform(l, lambda x: [x]),
            lambda acc, y: CASE WHEN len(list_filter(acc, lambda t: t.s < y[1].e AND y[1].s < t.e)) = 0
                THEN acc || y ELSE acc END)) AS x FROM ordered{name}),
    chosen{name} AS (SELECT row_idx, x.s AS s, x.e AS e, x.category AS category, x.canonical AS canonical, x.match_type AS match_type FROM picked{name})"""


BEST = f"{CAND},{_best()}"
CHOSEN = f"{BEST},{_greedy()}"
SIMPLE = f"{CAND},{_best('_simple', 'e - s')},{_greedy('_simple')}"
_LABELS = "(['B-a', 'I-a', 'I-b', 'B-b', 'O'])[length(tok) % 5 + 1]"
TAGS = rf"""{TOK},
    flat AS (SELECT row_idx, unnest(tokens) AS tok, unnest(range(len(tokens))) AS pos FROM tok),
    tagged AS (SELECT row_idx, pos, {_LABELS} AS gold,
            CASE WHEN length(tok) % 7 = 0 THEN 'O' ELSE {_LABELS} END AS one,
            CASE WHEN length(tok) % 3 = 0 THEN 'O' ELSE {_LABELS} END AS two FROM flat)"""
_decode = lambda name, col: f"""
    {name} AS (SELECT row_idx, min(pos) AS "start", max(pos) + 1 AS "end", any_value(cat) AS category FROM (
        SELECT *, sum(CASE WHEN going THEN 0 ELSE 1 END) OVER (PARTITION BY row_idx ORDER BY pos) AS island FROM (
            SELECT row_idx, pos, {col} AS tag, CASE WHEN {col} = 'O' THEN NULL ELSE substr({col}, 3) END AS cat,
                coalesce(starts_with({col}, 'I-') AND lag(CASE WHEN {col} = 'O' THEN NULL ELSE substr({col}, 3) END)
                    OVER (PARTITION BY row_idx ORDER BY pos) = substr({col}, 3), false) AS going FROM tagged))
        GROUP BY row_idx, island HAVING starts_with(arg_min(tag, pos), 'B-'))"""  # noqa: E731
_outcome = lambda name, p: f"""
    {name} AS (SELECT coalesce(g.row_idx, p.row_idx) AS row_idx, coalesce(g.category, p.category) AS category,
            (g.row_idx IS NOT NULL AND p.row_idx IS NOT NULL)::BIGINT AS tp, (g.row_idx IS NULL)::BIGINT AS fp, (p.row_idx IS NULL)::BIGINT AS fn
        FROM gold_spans g FULL JOIN {p} p ON g.row_idx = p.row_idx AND g."start" = p."start" AND g."end" = p."end" AND g.category = p.category)"""  # noqa: E731
SPANS = TAGS + "," + _decode("gold_spans", "gold") + "," + _decode("one_spans", "one") + "," + _decode("two_spans", "two")
SCORES = SPANS + "," + _outcome("out_one", "one_spans") + "," + _outcome("out_two", "two_spans")
_div = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END"
_PRF = f"{_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall, {_div('2 * tp', '2 * tp + fp + fn')} AS f1, tp + fn AS support"
RATED = """
    rated AS (SELECT doc_id, n_chars, A1, CASE WHEN n_chars % 7 = 0 THEN 'O' ELSE A1 END AS A2,
            CASE WHEN doc_id % 5 = 0 THEN 'B-low' ELSE A1 END AS A3
        FROM (SELECT d.doc_id, d.n_chars, CASE WHEN toxic = 1 THEN 'B-tox' WHEN quality = 1 THEN 'O' ELSE 'B-low' END AS A1
              FROM labels l JOIN documents d USING (doc_id)))"""
PAIRED = """
    paired AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, *, count(*) OVER () AS n FROM (
        SELECT doc_id, ((A1 <> 'O') AND A1 = A2)::BIGINT AS tp_a, ((A2 <> 'O') AND A1 <> A2)::BIGINT AS fp_a, ((A1 <> 'O') AND A1 <> A2)::BIGINT AS fn_a,
            ((A1 <> 'O') AND A1 = A3)::BIGINT AS tp_b, ((A3 <> 'O') AND A1 <> A3)::BIGINT AS fp_b, ((A1 <> 'O') AND A1 <> A3)::BIGINT AS fn_b
        FROM rated))"""
_f1 = lambda s: _div(f"2 * tp_{s}", f"2 * tp_{s} + fp_{s} + fn_{s}")
_hash = lambda a, b: f"('0x' || substr(md5('42|' || {a} || '|' || {b}), 1, 8))::BIGINT"
CENTRES = """
    pos AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
    unit AS (SELECT label, vec_id, i, CASE WHEN sqrt(sum(x * x) OVER v) > 0 THEN x / sqrt(sum(x * x) OVER v) ELSE x END AS u
        FROM pos WINDOW v AS (PARTITION BY vec_id)),
    mean AS (SELECT label, i, avg(u) AS m FROM unit GROUP BY label, i),
    centre AS (SELECT label, list(m / l ORDER BY i) AS c FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY label)) AS l FROM mean) GROUP BY label),
    near AS (SELECT vec_id, e.label AS own, c.label AS label, list_cosine_similarity(embedding::DOUBLE[], c) AS score
        FROM embeddings e CROSS JOIN centre c),
    two AS (SELECT *, row_number() OVER v AS nth, lead(score) OVER v AS second FROM near WINDOW v AS (PARTITION BY vec_id ORDER BY score DESC, label))"""


@query(f"WITH {TOK} SELECT row_idx, len(tokens) AS n_tokens, len(list_distinct(tokens)) AS n_distinct FROM tok")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("row_idx", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"))


@query(f"""WITH {TOK}, n AS (SELECT len(tokens) AS n FROM tok) SELECT count(n) AS n, round(avg(n), 6) AS mean, median(n)::DOUBLE AS median,
    round(stddev_samp(n), 6) AS sd, min(n) AS min, max(n) AS max, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.75) AS p75, round(quantile_cont(n, 0.95), 6) AS p95 FROM n""")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = audit.length_stats(documents(spark, sf_dir).select(F.size("tokens").cast("long").alias("n")), "n")
    return got.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "p95")})


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), "text"))


def _found(spark: SparkSession, sf_dir: str, *kinds: str, basic: bool = True) -> DataFrame:
    return extract(texts(spark, sf_dir), lexicon(spark), Config(kinds=kinds, basic=basic, use_guard=False), STOP)["candidates"]


@query(f"WITH {CAND} SELECT row_idx, s AS \"start\", e AS \"end\", category, canonical FROM cand WHERE match_type = 'exact'")
def ngram_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "exact").select("row_idx", "start", "end", "category", "canonical")


@query(f"WITH {CAND} SELECT category, count(*) AS spans, count(DISTINCT row_idx) AS texts FROM cand WHERE match_type = 'exact' GROUP BY category")
def exact_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "exact").groupBy("category").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("row_idx").alias("texts"))


@query(f"WITH {CAND} SELECT row_idx, s AS \"start\", e AS \"end\", category, canonical FROM cand WHERE match_type = 'regex'")
def regex_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "regex").select("row_idx", "start", "end", "category", "canonical")


@query(None)
def fuzzy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "fuzzy").select("row_idx", "start", "end", "category", "canonical", F.round("score", 9).alias("score"))


def _distinct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.explode("tokens").alias("token")).distinct()


_shorter = lambda src: f"SELECT token, {_STRIP(f'substr(f, 1, length(f) - length(x))', _EDGE)} AS f FROM {src}, suffix WHERE ends_with(f, x) AND length(f) > length(x) + 2"


@query(f"""WITH {TOK}, suffix(x) AS (VALUES {', '.join(f"('{s}')" for s in SUFFIXES)}), d AS (SELECT DISTINCT unnest(tokens) AS token FROM tok),
    zero AS (SELECT token, token AS f FROM d), one AS ({_shorter('zero')}), two AS ({_shorter('(SELECT * FROM one WHERE length(f) >= 2) q')})
    SELECT token, f AS root FROM zero UNION SELECT * FROM one WHERE length(f) >= 2 UNION SELECT * FROM two WHERE length(f) >= 2""")
def suffix_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinct_tokens(spark, sf_dir).select("token", F.explode(morphology.suffix_roots(F.col("token"), SUFFIXES)).alias("root"))


@query(f"""WITH {TOK}, d AS (SELECT DISTINCT unnest(tokens) AS token FROM tok),
    b AS (SELECT token, CASE WHEN ends_with(token, '''s') AND length(token) > 3 THEN substr(token, 1, length(token) - 2) ELSE token END AS t FROM d)
    SELECT token, CASE WHEN ends_with(t, 'ies') AND length(t) > 4 THEN substr(t, 1, length(t) - 3) || 'y'
        WHEN ends_with(t, 'ses') AND length(t) > 4 THEN substr(t, 1, length(t) - 2)
        WHEN ends_with(t, 's') AND NOT ends_with(t, 'ss') AND length(t) > 3 THEN substr(t, 1, length(t) - 1) ELSE t END AS lemma FROM b""")
def rule_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinct_tokens(spark, sf_dir).select("token", morphology.english_lemma(F.col("token")).alias("lemma"))


@query(f'WITH {CAND} SELECT row_idx, s AS "start", e AS "end", category, match_type, filtered FROM cand')
def stop_filter_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "exact", "regex").select("row_idx", "start", "end", "category", "match_type", "filtered")


@query(f"""WITH {TOK}, {WIN} SELECT row_idx, s AS "start", surface, by_memory AS memory, by_price AS price, false AS phone
    FROM win WHERE n = 1 AND regexp_full_match(surface, '{_NUM}')""")
def numeric_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates.numbers(documents(spark, sf_dir))
    ok = lambda c: candidates.number_allowed(F.lit(c), F.lit(True), F.col("by_memory"), F.col("by_price")).alias(c)
    return rows.select("row_idx", "start", "surface", ok("memory"), ok("price"), ok("phone"))


@query(f"""WITH {TOK}, d AS (SELECT DISTINCT unnest(tokens) AS token FROM tok)
    SELECT token, NOT regexp_full_match(token, '[0-9]+(?:\\.[0-9]+)?k?') AS phone_allowed FROM d""")
def category_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinct_tokens(spark, sf_dir).select("token", candidates.phone_allowed(F.lit("phone"), F.col("token")).alias("phone_allowed"))


@query(f'WITH {BEST} SELECT row_idx, s AS "start", e AS "end", category, canonical, match_type FROM best')
def best_per_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract(texts(spark, sf_dir), lexicon(spark), Config(kinds=("exact", "regex"), basic=True), STOP)["candidates"]
    return select.best_per_span(rows).select("row_idx", "start", "end", "category", "canonical", "match_type")


BASE = Config(kinds=("exact", "regex"), basic=True)


def _extracted(spark: SparkSession, sf_dir: str, config: Config = BASE) -> dict[str, DataFrame]:
    return extract(texts(spark, sf_dir), lexicon(spark), config, STOP)


@query(f'WITH {CHOSEN} SELECT row_idx, s AS "start", e AS "end", category, canonical, match_type FROM chosen')
def greedy_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir)["spans"].select("row_idx", "start", "end", "category", "canonical", "match_type")


@query(f"""WITH {CHOSEN}, flat AS (SELECT row_idx, unnest(range(len(tokens))) AS pos FROM tok),
    cover AS (SELECT row_idx, unnest(range(s, e)) AS pos, s, category FROM chosen)
    SELECT row_idx, string_agg(CASE WHEN category IS NULL THEN 'O' WHEN pos = s THEN 'B-' || category ELSE 'I-' || category END, ' ' ORDER BY pos) AS tags
    FROM flat LEFT JOIN cover USING (row_idx, pos) GROUP BY row_idx""")
def iob2_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _extracted(spark, sf_dir)["tagged"]
    return rows.where(F.size("tokens") > 0).select("row_idx", F.array_join("tags", " ").alias("tags"))


@query(f"""WITH {CHOSEN}, first AS (SELECT row_idx, category, canonical AS term, min(s) AS s FROM chosen GROUP BY ALL)
    SELECT row_idx, category, string_agg(term, '|' ORDER BY s) AS terms FROM first GROUP BY row_idx, category""")
def aspect_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _extracted(spark, sf_dir)["aspects"]
    return rows.select("row_idx", F.explode("aspects").alias("category", "terms")).withColumn("terms", F.array_join("terms", "|"))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gold``, ``one`` and ``two``: tags by the tokens' lengths, so that a rule in SQL gives the same."""
    label = lambda t: F.get(F.array(*[F.lit(x) for x in ("B-a", "I-a", "I-b", "B-b", "O")]), F.length(t) % 5)
    without = lambda k: lambda t: F.when(F.length(t) % k == 0, "O").otherwise(label(t))
    return documents(spark, sf_dir).select(
        "row_idx", F.transform("tokens", label).alias("gold"), F.transform("tokens", without(7)).alias("one"), F.transform("tokens", without(3)).alias("two")
    )


def _spans(tagged: DataFrame, name: str) -> DataFrame:
    return tags.decoded(tagged.select("row_idx", F.col(name).alias("tags")))


@query(f"WITH {SPANS} SELECT * FROM gold_spans")
def iob2_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(_tagged(spark, sf_dir), "gold")


@query(f"""WITH {SCORES}, per AS (SELECT category, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM out_one GROUP BY category),
    cls AS (SELECT category, {_PRF} FROM per),
    rows AS (SELECT 'class' AS scope, * FROM cls
        UNION ALL SELECT 'micro', NULL, {_PRF} FROM (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM per)
        UNION ALL SELECT 'macro', NULL, avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM cls
        UNION ALL SELECT 'weighted', NULL, sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM cls)
    SELECT scope, category, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM rows""")
def strict_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tagged(spark, sf_dir)
    return _rounded(metrics.metrics(_spans(t, "gold"), _spans(t, "one")), "precision", "recall", "f1")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def _tag_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tagged(spark, sf_dir)
    return metrics.leaderboard(_spans(t, "gold"), {"one": _spans(t, "one"), "two": _spans(t, "two")})


@query(f"""WITH {SCORES}, board AS (SELECT system, {_PRF} FROM (
        SELECT 'one' AS system, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM out_one
        UNION ALL SELECT 'two', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM out_two))
    SELECT system, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM board ORDER BY f1 DESC, system""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_tag_board(spark, sf_dir), "precision", "recall", "f1").orderBy(F.col("f1").desc(), "system")


# The gold of the ablation: what every other word's length leaves of the simple choice, so that no system is the gold.
_GOLD = "SELECT row_idx, s, e, category FROM chosen_simple WHERE (row_idx + s) % 5 <> 0"
_ABLATED = {
    "full": (_best("_full"), _greedy("_full")),
    "without_stop_filter": (_best("_without_stop_filter"), _greedy("_without_stop_filter", "true")),
    "without_category_guard": (_best("_without_category_guard", guard="true"), _greedy("_without_category_guard")),
    "without_evidence_rank": (_best("_without_evidence_rank", "e - s"), _greedy("_without_evidence_rank")),
    "without_exact": (_best("_without_exact", kinds="'regex'"), _greedy("_without_exact")),
    "without_regex": (_best("_without_regex", kinds="'exact'"), _greedy("_without_regex")),
}
_ABLATION = f"""{SIMPLE},{','.join(x for parts in _ABLATED.values() for x in parts)}, gold AS ({_GOLD}),
    found AS ({' UNION ALL '.join(f"SELECT '{n}' AS system, row_idx, s, e, category FROM chosen_{n}" for n in _ABLATED)}),
    hits AS (SELECT system, count(*) AS found, count(g.s) AS tp FROM found f LEFT JOIN gold g USING (row_idx, s, e, category) GROUP BY system),
    board AS (SELECT system, {_PRF} FROM (SELECT system, tp, found - tp AS fp, (SELECT count(*) FROM gold) - tp AS fn FROM hits))"""


def _ablation_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _extracted(spark, sf_dir, Config(kinds=("exact", "regex"), basic=True, evidence_aware=False))["spans"]
    return spans.where("(row_idx + start) % 5 <> 0").select("row_idx", "start", "end", "category")


@query(f"""WITH {_ABLATION} SELECT b.system, round(b.f1, 9) AS f1, round(f.f1 - b.f1, 9) AS contribution,
    CASE WHEN f.f1 > b.f1 THEN 'helps' WHEN f.f1 < b.f1 THEN 'hurts' ELSE 'neutral' END AS effect
    FROM board b, (SELECT f1 FROM board WHERE system = 'full') f WHERE b.system <> 'full'""")
def component_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = ablations(BASE)
    board = metrics.board(_ablation_gold(spark, sf_dir), systems(texts(spark, sf_dir), lexicon(spark), configs, STOP), list(configs))
    return _rounded(metrics.contributions("full", board), "f1", "contribution")


@query(f"""WITH {_ABLATION} SELECT system, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM board ORDER BY board.f1 DESC, board.precision DESC, board.recall DESC, system LIMIT 1""")
def best_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = ablations(BASE)
    board = metrics.board(_ablation_gold(spark, sf_dir), systems(texts(spark, sf_dir), lexicon(spark), configs, STOP), list(configs))
    return _rounded(splits.best_config(board, "system").drop("support"), "precision", "recall", "f1")


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    a1 = F.when(F.col("toxic") == 1, "B-tox").when(F.col("quality") == 1, "O").otherwise("B-low")
    rows = rows.select("doc_id", "n_chars", a1.alias("A1"))
    a2 = F.when(F.col("n_chars") % 7 == 0, "O").otherwise(F.col("A1"))
    a3 = F.when(F.col("doc_id") % 5 == 0, "B-low").otherwise(F.col("A1"))
    return rows.withColumns({"A2": a2, "A3": a3})


@query(f"""WITH {RATED}, p AS (SELECT 'A1A2' AS pair, A1 AS a, A2 AS b FROM rated UNION ALL SELECT 'A1A3', A1, A3 FROM rated UNION ALL SELECT 'A2A3', A2, A3 FROM rated),
    po AS (SELECT pair, count(*) AS n, avg((a = b)::INT) AS po FROM p GROUP BY pair),
    pe AS (SELECT x.pair, sum(x.n * y.n) AS c FROM (SELECT pair, a AS l, count(*) AS n FROM p GROUP BY ALL) x JOIN (SELECT pair, b AS l, count(*) AS n FROM p GROUP BY ALL) y USING (pair, l) GROUP BY x.pair)
    SELECT pair, round(po, 9) AS agreement, round((po - c::DOUBLE / (n * n)) / (1 - c::DOUBLE / (n * n)), 9) AS kappa FROM po JOIN pe USING (pair)""")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(agr.cohen(_rated(spark, sf_dir), RATERS), "agreement", "kappa")


@query(f"""WITH {RATED}, u AS (SELECT doc_id, unnest([A1, A2, A3]) AS l FROM rated), c AS (SELECT doc_id, l, count(*) AS k FROM u GROUP BY ALL),
    s AS (SELECT sum(k * k)::DOUBLE AS sq, count(DISTINCT doc_id)::DOUBLE AS n FROM c), t AS (SELECT l, sum(k)::DOUBLE AS n FROM c GROUP BY l),
    q AS (SELECT sum(n * n) AS nn, sum(n) AS al FROM t), un AS (SELECT avg((A1 = A2 AND A2 = A3)::INT) AS una FROM rated)
    SELECT round(((sq - n * 3) / (n * 6) - nn / (al * al)) / (1 - nn / (al * al)), 9) AS fleiss,
        round(1 - (al - (sq - n * 3) / 2) / ((al * al - nn) / (al - 1)), 9) AS alpha, round(una, 9) AS unanimous, n::BIGINT AS items FROM s, q, un""")
def fleiss_alpha_unanimity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(agr.chance_corrected(_rated(spark, sf_dir), RATERS), "fleiss", "alpha", "unanimous")


@query(f"""WITH {RATED} SELECT A1, A2, A3, count(*) AS n FROM rated WHERE NOT (A1 = A2 AND A2 = A3) GROUP BY ALL ORDER BY n DESC, A1, A2, A3 LIMIT 12""")
def disagreement_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agr.patterns(_rated(spark, sf_dir), RATERS)


@query(f"""WITH {RATED}, d AS (SELECT *, A1 = A2 OR A2 = A3 OR A1 = A3 AS maj FROM rated WHERE NOT (A1 = A2 AND A2 = A3))
    SELECT count(*) AS differing, count(*) FILTER (maj) AS majority, count(*) FILTER (NOT maj) AS all_different, count(DISTINCT doc_id) AS groups FROM d""")
def disagreement_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agr.profile(_rated(spark, sf_dir), RATERS, "doc_id")


@query(f"""WITH {RATED}, c AS (SELECT CASE WHEN A1 = 'O' THEN 'O' ELSE 'A' END AS label, count(*) AS n FROM rated GROUP BY ALL)
    SELECT label, n, round(sqrt(sum(n) OVER () / (count(*) OVER () * n)), 9) AS weight FROM c""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = agr.binary(_rated(spark, sf_dir), RATERS).select(F.col("A1").alias("label"))
    return _rounded(agr.class_weights(labels), "weight")


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rated(spark, sf_dir).withColumnRenamed("doc_id", "row_idx")

    def counted(other: str) -> DataFrame:
        same, gold, got = F.col("A1") == F.col(other), F.col("A1") != "O", F.col(other) != "O"
        bit = lambda c: c.cast("long")
        return rows.select("row_idx", bit(gold & same).alias("tp"), bit(got & ~same).alias("fp"), bit(gold & ~same).alias("fn"))

    return resample.paired_counts(counted("A2"), counted("A3"), rows)


@query(f"""WITH {RATED}, {PAIRED}, dr AS (SELECT d.d, p.place AS slot, ({_hash('d.d', 'p.place')} % p.n)::BIGINT AS place FROM range({DRAWS}) d(d), paired p),
    s AS (SELECT d, {', '.join(f'sum({c}) AS {c}' for c in resample.PAIR)} FROM dr JOIN paired USING (place) GROUP BY d), x AS (SELECT {_f1('a')} - {_f1('b')} AS delta FROM s)
    SELECT round(avg(delta), 9) AS mean, round(quantile_cont(delta, 0.025), 9) AS low, round(quantile_cont(delta, 0.975), 9) AS high FROM x""")
def paired_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resample.interval(resample.bootstrap_deltas(_paired(spark, sf_dir), DRAWS))
    return _rounded(got, "mean", "low", "high")


_swap = lambda c, x, y: f"sum(CASE WHEN w THEN {c}_{y} ELSE {c}_{x} END) AS {c}_{x}"


@query(f"""WITH {RATED}, {PAIRED}, o AS (SELECT {_f1('a')} - {_f1('b')} AS obs FROM (SELECT {', '.join(f'sum({c}) AS {c}' for c in resample.PAIR)} FROM paired)),
    sw AS (SELECT d.d, p.*, {_hash('d.d', 'p.place')} % 2 = 1 AS w FROM range({DRAWS}) d(d), paired p),
    s AS (SELECT d, {', '.join(_swap(c, x, y) for c in ('tp', 'fp', 'fn') for x, y in ('ab', 'ba'))} FROM sw GROUP BY d), x AS (SELECT {_f1('a')} - {_f1('b')} AS delta FROM s)
    SELECT round(any_value(obs), 9) AS observed, round((count(*) FILTER (abs(delta) >= abs(obs) - 1e-12) + 1)::DOUBLE / {DRAWS + 1}, 9) AS two_sided,
        round((count(*) FILTER (delta >= obs - 1e-12) + 1)::DOUBLE / {DRAWS + 1}, 9) AS one_sided FROM x, o""")
def randomization_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(resample.randomization(_paired(spark, sf_dir), DRAWS), "observed", "two_sided", "one_sided")


_BENCH = TOK.replace("cleaned AS", "b_cleaned AS").replace("tok AS", "b_tok AS").replace("doc_id AS row_idx", "item_id AS row_idx").replace("FROM documents", "FROM benchmark").replace("FROM cleaned", "FROM b_cleaned")


@query(f"""WITH {TOK},{_BENCH}, {LEX}, w AS (SELECT DISTINCT norm FROM lex WHERE NOT is_regex),
    s AS (SELECT DISTINCT norm FROM w, (SELECT ' ' || array_to_string(tokens, ' ') || ' ' AS t FROM tok) WHERE contains(t, ' ' || norm || ' ')),
    e AS (SELECT DISTINCT norm FROM w, (SELECT ' ' || array_to_string(tokens, ' ') || ' ' AS t FROM b_tok) WHERE contains(t, ' ' || norm || ' '))
    SELECT norm, CASE WHEN s.norm IS NOT NULL AND e.norm IS NOT NULL THEN 'both' WHEN s.norm IS NOT NULL THEN 'source_only' WHEN e.norm IS NOT NULL THEN 'evaluation_only' ELSE 'neither' END AS exposure
    FROM w LEFT JOIN s USING (norm) LEFT JOIN e USING (norm)""")
def exposure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = lexicon(spark).where("not is_regex")
    only = Config(kinds=("exact",), basic=True, longest=5)
    seen = lambda docs: extract(docs, lexicon(spark), only)["candidates"].select(F.col("canonical").alias("norm"))
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_idx"), "text")
    return audit.exposure(forms, seen(texts(spark, sf_dir)), seen(bench))


_KEY = "trim(regexp_replace(replace(lower(nfc_normalize(coalesce(line, ''))), 'ß', 'ss'), '\\s+', ' ', 'g'))"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
    b AS (SELECT DISTINCT {_KEY.replace('line', 'text')} AS key FROM benchmark)
    SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, {_KEY} AS key FROM l) WHERE key NOT IN (SELECT key FROM b) GROUP BY doc_id""")
def quarantine_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document how many lines no text of ``benchmark`` is, but for case, form and white space."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    keyed = lines.select("doc_id", text.text_key(F.col("line")).alias("key"))
    held = table(spark, sf_dir, "benchmark").select(text.text_key(F.col("text")).alias("key"))
    return audit.quarantined(keyed, held).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))


_COVER = f"""{CHOSEN}, c AS (SELECT DISTINCT row_idx, s, e, category AS other FROM cand WHERE match_type = 'exact'),
    cov AS (SELECT g.row_idx, g.s, g.e, g.category, bool_or(other IS NOT NULL) AS same_place, coalesce(bool_or(other = g.category), false) AS same_category
        FROM chosen g LEFT JOIN c USING (row_idx, s, e) GROUP BY g.row_idx, g.s, g.e, g.category)"""


@query(f"""WITH {_COVER} SELECT category, count(*) AS spans, round(avg(same_place::INT), 8) AS same_place, round(avg(same_category::INT), 8) AS same_category FROM cov GROUP BY category""")
def candidate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _extracted(spark, sf_dir)["spans"].select("row_idx", "start", "end", "category")
    return audit.coverage_by_category(audit.coverage(gold, _found(spark, sf_dir, "exact")))


@query(f"""WITH {CHOSEN}, c AS (SELECT DISTINCT row_idx, s, e, category AS other FROM cand)
    SELECT g.category, other, count(*) AS n FROM chosen g JOIN c USING (row_idx, s, e) WHERE g.category <> other GROUP BY ALL""")
def category_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _extracted(spark, sf_dir)["spans"].select("row_idx", "start", "end", "category")
    return audit.confusions(gold, _found(spark, sf_dir, "exact", "regex"))


def _centres(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    first = rows.select(F.size("embedding")).first()
    size = first[0] if first else 0
    return rows, context.centroids(rows, size, "label", "embedding").withColumnRenamed("label", "category")


@query(f"WITH {CENTRES} SELECT label, i, round(x, 6) AS x FROM (SELECT label, unnest(c) AS x, unnest(range(1, len(c) + 1)) AS i FROM centre)")
def category_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = _centres(spark, sf_dir)[1]
    rows = centres.select(F.col("category").alias("label"), F.posexplode("centroid").alias("i", "x"))
    return rows.select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(f"WITH {CENTRES} SELECT vec_id, label, round(score, 6) AS score, round(second, 6) AS second, round(score - second, 6) AS margin FROM two WHERE nth = 1")
def nearest_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centres = _centres(spark, sf_dir)
    best = context.two_best(rows, centres, "vec_id", "embedding").withColumnRenamed("category", "label")
    return best.select("vec_id", "label", *[F.round(c, 6).alias(c) for c in ("score", "second", "margin")])


@query(f"""WITH {CENTRES} SELECT vec_id, own AS label, round(max(score) FILTER (own = label) - max(score) FILTER (own <> label), 6) AS margin FROM near GROUP BY ALL""")
def category_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centres = _centres(spark, sf_dir)
    near = context.with_similarities(rows.select("vec_id", "label", "embedding"), centres, "embedding")
    most = lambda keep: F.array_max(F.transform(F.filter("scores", keep), lambda s: s["score"]))
    margin = most(lambda s: s["category"] == F.col("label")) - most(lambda s: s["category"] != F.col("label"))
    return near.select("vec_id", "label", F.round(margin, 6).alias("margin"))


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'de' AND doc_id = 4 OR lang = 'de' AND source = 'src4'")
def manifest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return splits.matching_any(docs, ["lang=de", "source=src4"], ["lang=de", "doc_id=4.0"]).select("doc_id", "lang", "source")


_ROLES = f"""r AS (SELECT doc_id, row_number() OVER (ORDER BY {_hash("'split'", 'doc_id')}, doc_id) AS nth, count(*) OVER () AS n FROM labels),
    role AS (SELECT doc_id, CASE WHEN nth <= ceil(n * 0.2) THEN 'test' WHEN nth <= ceil(n * 0.2) + ceil((n - ceil(n * 0.2)) * 0.1) THEN 'validation' ELSE 'train' END AS role FROM r)"""


@query(f"WITH {_ROLES} SELECT role, count(*) AS n FROM role GROUP BY role")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split(table(spark, sf_dir, "labels"), "doc_id").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_ROLES}, two AS (SELECT doc_id, role FROM role UNION ALL SELECT doc_id, 'test' FROM role WHERE doc_id % 9 = 0)
    SELECT doc_id FROM two GROUP BY doc_id HAVING count(DISTINCT role) > 1""")
def split_disjointness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a second manifest, every ninth id as test, puts into another role than the first."""
    roles = splits.split(table(spark, sf_dir, "labels"), "doc_id")
    second = roles.where("doc_id % 9 = 0").select("doc_id", F.lit("test").alias("role"))
    return splits.disjoint(roles.unionByName(second), "doc_id").select("doc_id")


@query("""SELECT doc_id::VARCHAR AS path, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'ok' END AS status FROM documents LEFT JOIN labels l USING (doc_id)""")
def file_hash_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand for files: of labelled ones the hash is known, and every third has changed."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    manifest = docs.select("path", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    found = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("path", F.sha2("text", 256).alias("sha256"))
    return tables.verified(manifest, found)


# Contexts and margins stand for those of a model: numbers of a candidate's place and category, so that SQL says the same.
GRID = [grid.Thresholds(exact=e, trigger=t, margin=m) for e in (0.0, 0.3, 0.6) for t in (0.0, 0.5) for m in (None, 0.0, 0.2)]
_GRID = "grid(config_id, exact, trig, margin) AS (VALUES " + ", ".join(f"({i}, {t.exact}, {t.trigger}, {'NULL' if t.margin is None else t.margin}::DOUBLE)" for i, t in enumerate(GRID)) + ")"
_PHRASE = "match_type = 'exact' AND e - s > 1"


@query(f"""WITH {SIMPLE}, gold AS ({_GOLD}), {_GRID},
    sc AS (SELECT *, ((row_idx * 7 + s * 13 + e + length(category)) % 100) / 100.0 AS context, ((row_idx * 3 + s * 5 + length(category)) % 50) / 100.0 - 0.1 AS mg FROM cand WHERE {_GUARD}),
    ok AS (SELECT config_id, sc.*, {_EVIDENCE} AS ev FROM sc, grid WHERE CASE WHEN {_PHRASE} THEN true WHEN is_trigger THEN context >= trig WHEN e - s = 1 THEN context >= exact ELSE true END
            AND ({_PHRASE} OR margin IS NULL OR mg >= margin)),
    top AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY config_id, row_idx, s, e ORDER BY ev DESC, mg DESC, context DESC, a, b, c, d, ord) = 1),
    lists AS (SELECT config_id, row_idx, list({{'s': s, 'e': e, 'category': category}} ORDER BY ev DESC, mg DESC, context DESC, s, a, b, c, d, ord) AS l FROM top WHERE NOT filtered GROUP BY ALL),
    got AS (SELECT config_id, row_idx, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, y: CASE WHEN len(list_filter(acc, lambda t: t.s < y[1].e AND y[1].s < t.e)) = 0 THEN acc || y ELSE acc END)) AS x FROM lists),
    hits AS (SELECT config_id, count(*) AS n, count(g.s) AS tp FROM got LEFT JOIN gold g ON got.row_idx = g.row_idx AND x.s = g.s AND x.e = g.e AND x.category = g.category GROUP BY config_id),
    board AS (SELECT config_id, exact, trig, margin, {_PRF} FROM (SELECT grid.*, coalesce(tp, 0) AS tp, coalesce(n, 0) - coalesce(tp, 0) AS fp, (SELECT count(*) FROM gold) - coalesce(tp, 0) AS fn FROM grid LEFT JOIN hits USING (config_id)))
    SELECT config_id, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support, exact::DOUBLE AS exact, trig::DOUBLE AS trigger, margin FROM board""")
def grid_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All configurations of a grid of thresholds, in one pass over the texts, against the gold of the ablation."""
    choices = {"gold": Config(kinds=("exact", "regex"), basic=True, evidence_aware=False).choice(), "guarded": BASE.choice()}
    rows = matcher.matched(texts(spark, sf_dir), matcher.small_lexicon(lexicon(spark)), choices, ("candidates", "gold"), STOP)
    size = lambda c: F.length(c["category"])
    number = lambda c: F.col("row_idx") * 7 + c["start"] * 13 + c["end"] + size(c)
    margin = lambda c: F.pmod(F.col("row_idx") * 3 + c["start"] * 5 + size(c), F.lit(50)) / 100 - 0.1
    fit = F.filter("candidates", lambda c: candidates.phone_allowed(c["category"], c["surface"]))
    with_scores = F.transform(fit, lambda c: c.withField("context", F.pmod(number(c), F.lit(100)) / 100).withField("margin", margin(c)))
    true = F.filter("gold", lambda s: (F.col("row_idx") + s["start"]) % 5 != 0)
    rows = candidates.settled(rows.select(with_scores.alias("found"), true.alias("gold")))
    return _rounded(grid.board(rows, GRID, longest=4).drop("fuzzy", "cutoff").withColumn("config_id", F.col("config_id").cast("int")), "precision", "recall", "f1")


@query(ORACLE_SQL["grid_board"].replace("FROM board", "FROM (SELECT *, row_number() OVER (ORDER BY f1 DESC, precision DESC, recall DESC, config_id) AS nth FROM board) WHERE nth = 1"))
def best_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best configuration of the grid."""
    return splits.best_config(grid_board(spark, sf_dir))
