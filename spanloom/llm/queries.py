"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids as op11
from . import exact_dedup as op7
from . import fingerprint as op5
from . import html_text as op6
from . import language_id as op10
from . import mixing as op2
from . import near_dedup as op8
from . import packing as op4
from . import periodic_runs as op12
from . import quality_rules as op13
from . import sentence_spans as op9
from . import token_file as op3
from . import url_filter as op1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The contract's rules, as host, path and verdict.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "block"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every url of ``pages``."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return op1.url_filter(pages, rules).select("page_id", "host", "path", "rule", "verdict")


#: Weights of the domains that ``labels`` tells apart; neither clean domain may shrink.
MIX_TARGETS = {"good": 0.85, "plain": 0.14, "toxic": 0.01}
MIX_KEEP = ("good", "plain")


def domain_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, domain``: toxic, else good or plain by quality; rows with neither label are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "plain")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior, rate and copies of every document under the target weights."""
    docs, labels = _table(spark, sf_dir, "documents"), domain_labels(_table(spark, sf_dir, "labels"))
    mixed = op2.mix(docs.select("doc_id", "text"), labels, MIX_TARGETS, MIX_KEEP, stored=True, with_columns=False)
    return mixed.select(
        "doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(MIX_TARGETS)], "domain", "rate", "copies"
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file is, on each machine alike."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every text of ``documents``, written and read back; id 2 ends a document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return op3.token_file(docs, tokenizer_path(), end_id=2)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place in sequences of 2,048 tokens for every piece of every text; id 0 ends a document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return op4.best_fit(docs, tokenizer_path(), end_id=0)


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text."""
    return op5.edited_fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"), stored=True)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return op6.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on every row of ``documents``."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return op7.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near duplicates of every document."""
    return op8.near_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), stored=True)


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` without sentences of repeated spans."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return op9.span_dedup(docs, stored=True).select("doc_id", "n_sentences", "n_removed", "text")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``, learned from rows that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    model = op10.fit(docs)
    got = op10.language_id(docs.select("doc_id", "text"), model)
    return got.select("doc_id", op10.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector of ``embeddings`` and its distance to the cluster's centroid."""
    found, centres = op11.cluster(_table(spark, sf_dir, "embeddings"))
    digests = F.array(*[F.lit(d) for d in op11.digests(centres)]).cast("array<string>")
    return found.withColumn("centroid_sha256", F.get(digests, F.col("cluster")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of words of every text of ``documents``, after some were given one."""
    return op12.periodic_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"), plant=True)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of every text of ``documents``, and whether the rules learned from ``labels`` keep it."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = op13.learn(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return op13.quality_rules(docs, rules).select("doc_id", *op13.COUNTS[:5], "base_failed", "kept", "rule")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_mixing": op2_mixing,
    "op3_token_file": op3_token_file,
    "op4_packing": op4_packing,
    "op5_fingerprint": op5_fingerprint,
    "op6_html_text": op6_html_text,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_sentence_spans": op9_sentence_spans,
    "op10_language_id": op10_language_id,
    "op11_centroids": op11_centroids,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quality_rules": op13_quality_rules,
}


def _lloyd_sql() -> str:
    """The rounds of ``centroids`` one after the other, as lists of whole numbers."""
    near = lambda r: f"""a{r} AS MATERIALIZED (SELECT p, min(struct_pack(d := list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c := c)) AS best
        FROM kept, c{r} GROUP BY p)"""  # noqa: E731
    floor = "(s - ((s % n) + n) % n) // n"
    move = lambda r: f"""s{r} AS (SELECT best.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{r} JOIN kept USING (p), range(1, 65) t(i) GROUP BY ALL),
    c{r + 1} AS MATERIALIZED (SELECT c{r}.c AS c, coalesce(g.m, c{r}.m) AS m FROM c{r} LEFT JOIN (SELECT c, list(({floor})::BIGINT ORDER BY i) AS m FROM s{r} GROUP BY c) g USING (c))"""  # noqa: E731
    rounds = ",\n    ".join(f"{near(r)},\n    {move(r)}" for r in range(op11.ROUNDS))
    return f"""
    WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS p, vec_id, list_transform(embedding, lambda x: floor({op11.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {op11.SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (SELECT row_number() OVER w - 1 AS c, v AS m FROM kept WINDOW w AS (ORDER BY sha256('{op11.SEED}:' || vec_id) NULLS LAST, v)
        QUALIFY row_number() OVER w <= {op11.K}),
    {rounds},
    {near(op11.ROUNDS)}
    SELECT vec_id, best.c::INTEGER AS cluster, best.d::BIGINT AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia,
        sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
    FROM a{op11.ROUNDS} JOIN kept USING (p) JOIN c{op11.ROUNDS} ON c{op11.ROUNDS}.c = best.c"""


ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": """
        WITH rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'),
            ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        u AS (SELECT page_id, url, split_part(split_part(
                  CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END,
                  '?', 1), '#', 1) AS rest, row_number() OVER () AS r
              FROM pages),
        s AS (SELECT page_id, r,
                  translate(CASE WHEN instr(rest, '/') > 0 THEN substr(rest, 1, instr(rest, '/') - 1) ELSE rest END,
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/')) ELSE '' END AS path
              FROM u),
        m AS (SELECT s.*, h || p AS rule, v,
                  row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS n
              FROM s LEFT JOIN rules
              ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1
    """,
    "op7_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER w = 1 AS kept,
               text_sha256
        FROM d
        WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
    """,
}
ORACLE_SQL["op11_centroids"] = _lloyd_sql()
