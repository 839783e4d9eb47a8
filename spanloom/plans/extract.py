"""The extraction plan: texts to tagged texts."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.morphology import CORE_SUFFIXES
from ..operators import context as ctx
from ..operators.candidates import analysed, candidates, guarded, phone_allowed
from ..operators.matcher import Choice, Search, exploded, lemma_table, matched, once, small_lexicon, with_tokens
from ..operators.metrics import board, contributions
from ..operators.select import merged, with_scores, without_overlap
from ..operators.tags import aspects, aspects_in_row, emitted


@dataclass(frozen=True)
class Config:
    """What an extraction does; thresholds count only where their part is on."""

    kinds: tuple[str, ...] = ("exact", "fuzzy", "regex")
    fuzzy_cutoff: float = 0.75
    longest: int = 4
    #: Base forms of words that count before the rules, as pairs.
    lemmas: tuple[tuple[str, str], ...] = ()
    basic: bool = False
    use_stop: bool = True
    use_context: bool = False
    use_guard: bool = True
    evidence_aware: bool = True
    discover: bool = False
    extend: bool = False
    exact_threshold: float = 0.0
    trigger_threshold: float = 0.0
    fuzzy_threshold: float = 0.0
    margin_threshold: float | None = None
    discover_threshold: float = 0.60
    discover_margin: float = 0.05
    extend_threshold: float = 0.60
    suffixes: tuple[str, ...] = field(default=CORE_SUFFIXES)

    def __post_init__(self) -> None:
        if not 0 < self.fuzzy_cutoff <= 1:
            raise ValueError("fuzzy_cutoff must be over 0 and at most 1")
        if unknown := set(self.kinds) - {"exact", "fuzzy", "regex"}:
            raise ValueError(f"unknown kinds: {sorted(unknown)}")
        if (self.discover or self.extend) and not self.use_context:
            raise ValueError("discovery and extension need the context model")


    def choice(self) -> Choice:
        """What the one pass over texts does of this configuration."""
        search = Search(self.fuzzy_cutoff, self.longest, self.basic, self.suffixes, self.lemmas)
        return Choice(search, self.kinds, self.use_stop, self.use_guard, not self.evidence_aware)

    @property
    def in_row(self) -> bool:
        """Whether a text's spans can be chosen from its candidates alone, without scores of a context model."""
        return not self.use_context and self.margin_threshold is None


def tokenised(texts: DataFrame, row_idx: str = "row_idx", text: str = "text") -> DataFrame:
    """``row_idx, tokens``; null texts have none."""
    return with_tokens(texts.select(F.col(row_idx).alias("row_idx"), F.col(text).alias("text")))


def extract(
    texts: DataFrame,
    entries: DataFrame,
    config: Config = Config(),
    stop: tuple[str, ...] = (),
    encode: ctx.Encode | None = None,
    vector_size: int = 32,
) -> dict[str, DataFrame]:
    """From ``row_idx`` and ``text`` or ``tokens``: ``candidates``, ``spans``, ``tagged`` (all texts, with ``tags``) and ``aspects``.

    Each text depends on itself alone, so the plan also runs on a stream up to the
    selection.  Without a context model every result is one pass over the texts,
    which stay rows of their own, but that words like the lexicon's are found among the distinct
    forms first; a lexicon that is too large for that is joined.
    """
    stop = stop if config.use_stop else ()
    known = small_lexicon(entries)
    if config.in_row and known:
        choice = {"spans": config.choice()}
        keep = ("candidates", "tokens", "spans", "spans_tags")
        rows = matched(texts, known, choice, keep, stop)
        if rows is not None:
            found = with_scores(exploded(rows, "candidates"))
            if config.use_guard:
                found = found.where(phone_allowed(F.col("category"), F.col("surface")))
            tagged = rows.select("row_idx", "tokens", F.col("spans_tags").alias("tags"))
            return {"candidates": found, "spans": with_scores(exploded(rows, "spans")), "tagged": tagged, "aspects": aspects_in_row(rows)}

    texts = with_tokens(texts)
    rows = analysed(texts, stop, config.suffixes, config.basic, lemma_table(texts, config.lemmas))
    in_row = matched(texts, known, {"spans": config.choice()}, ("candidates",), stop) if known else None
    if in_row is not None:
        found = exploded(in_row, "candidates").drop("surface")
    else:
        found = candidates(rows, once(entries), config.kinds, config.fuzzy_cutoff, config.longest)
    found = with_scores(found)
    vectors = centres = None
    if config.use_context:
        encode = encode or ctx.hash_encoder(vector_size)
        vectors = ctx.encoded(texts, encode)
        centres = ctx.lexicon_centroids(entries, encode, vector_size)
        found = ctx.scored(found.drop("context", "other", "margin"), vectors, centres, vector_size)
        found = found.where(ctx.context_allowed(config.exact_threshold, config.trigger_threshold, config.fuzzy_threshold))
    if config.margin_threshold is not None:
        found = found.where(ctx.margin_allowed(config.margin_threshold))
    if config.discover:
        found = found.unionByName(ctx.discovered(rows, vectors, found, centres, config.discover_threshold, config.discover_margin))
    if config.use_guard:
        found = guarded(found, rows)
    spans = without_overlap(found, simple=not config.evidence_aware)
    if config.extend:
        more = with_scores(ctx.extensions(spans, rows, vectors, centres, config.extend_threshold))
        more = without_overlap(more).drop("nth")
        spans = merged(spans.select(*more.columns).unionByName(more))
    return {"candidates": found, "spans": spans, "tagged": emitted(texts, spans), "aspects": aspects(spans, texts)}


#: A configuration's parts, and what it is without each.
PARTS = {
    "morphology": {"basic": True},
    "stop_filter": {"use_stop": False},
    "category_guard": {"use_guard": False},
    "evidence_rank": {"evidence_aware": False},
}


def ablations(config: Config) -> dict[str, Config]:
    """``full`` and, for every part that is on, the configuration without it."""
    out = {"full": config}
    for part, off in PARTS.items():
        if any(getattr(config, k) != v for k, v in off.items()):
            out[f"without_{part}"] = replace(config, **off)
    for kind in config.kinds:
        if len(config.kinds) > 1:
            out[f"without_{kind}"] = replace(config, kinds=tuple(k for k in config.kinds if k != kind))
    if config.use_context:
        out["without_context"] = replace(config, use_context=False, discover=False, extend=False)
    return out


def systems(texts: DataFrame, entries: DataFrame, configs: dict[str, Config], stop: tuple[str, ...] = ()) -> DataFrame:
    """``system, row_idx, start, end, category`` of several configurations without a context model, in one pass over the texts.

    Configurations that search alike share their candidates.
    """
    rows = None
    known = small_lexicon(entries) if all(c.in_row for c in configs.values()) else None
    if known:
        rows = matched(texts, known, {n: c.choice() for n, c in configs.items()}, tuple(configs), stop)
    if rows is None:
        parts = [extract(texts, entries, c, stop)["spans"].select(F.lit(n).alias("system"), "row_idx", "start", "end", "category") for n, c in configs.items()]
        return reduce(DataFrame.unionByName, parts)
    place = lambda n: F.transform(n, lambda s: F.struct(F.lit(n).alias("system"), s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("category")))
    return rows.select("row_idx", F.inline(F.concat(*[place(n) for n in configs]))).select("system", "row_idx", "start", "end", "category")


def ablation(texts: DataFrame, entries: DataFrame, gold: DataFrame, config: Config, stop: tuple[str, ...] = ()) -> DataFrame:
    """``system, f1, contribution, effect``: what each part of a configuration does for its F1 on ``gold``."""
    configs = ablations(config)
    return contributions("full", board(gold, systems(texts, entries, configs, stop), list(configs)))
