"""One scan of the texts: tokens, candidates of a lexicon, and the spans chosen among them, as expressions in the text's own row.

A lexicon of up to ``MOST_ENTRIES`` entries, which is checked, becomes tables that expressions
look up (prefixes of phrases, grams of patterns, words that tokens are like), so texts
never shuffle and no Python reads them, but for NFC.  Larger lexicons are joined (see ``candidates``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import Lookup, lookup
from ..functions.morphology import CORE_SUFFIXES, variants
from ..functions.text import EDGE, SPACE, let, nfc, normal, tokens
from . import lattice, patterns
from .candidates import LONGEST, MEMORY_WORDS, NUMBER, PRICE_WORDS, number_allowed, phone_allowed, settled
from .fuzzy import similar_entries
from .select import chosen_in_row

MOST_ENTRIES = 5_000
KINDS = ("exact", "fuzzy", "regex")
#: A character that may keep a token from being normal.
ABNORMAL = f"[[^a-z0-9 ]&&[’{EDGE}\\p{{Lu}}\\p{{Lt}}{SPACE[1:-1]}]]|^ | $|  "
SPAN = (
    "array<struct<start:int,end:int,category:string,canonical:string,score:double,match_type:string,is_trigger:boolean,"
    "filtered:boolean,gen:struct<a:int,b:int,c:int,d:bigint,e:bigint>,surface:string>>"
)


@dataclass(frozen=True)
class Search:
    """How candidates are found; ``lemmas`` are pairs of a form and its base form, which count before the rules."""

    cutoff: float = 0.75
    longest: int = LONGEST
    basic: bool = False
    suffixes: tuple[str, ...] = CORE_SUFFIXES
    lemmas: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Choice:
    """Which candidates compete, and how: ``simple`` ranks by length, score and place alone."""

    search: Search = field(default_factory=Search)
    kinds: tuple[str, ...] = KINDS
    use_stop: bool = True
    use_guard: bool = True
    simple: bool = False


@dataclass(frozen=True)
class Tables:
    """What expressions look up; None for kinds that aren't searched."""

    phrases: Lookup | None
    index: patterns.Index | None
    similar: Lookup | None


def lemma_table(texts: DataFrame, lemmas: Sequence[tuple[str, str]]) -> Lookup | None:
    """A dictionary of base forms as a table; None without one."""
    if not lemmas:
        return None
    found = lookup(texts.sparkSession.createDataFrame(list(dict(lemmas).items()), "form string, lemma string"), "form", "lemma")
    if found is None:
        raise ValueError("the dictionary of base forms has too many entries")
    return found


def with_tokens(texts: DataFrame) -> DataFrame:
    """``row_idx, tokens`` of ``row_idx, text`` (or ``tokens``); null texts have none."""
    if "tokens" in texts.columns:
        return texts.select("row_idx", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    return texts.select("row_idx", tokens(nfc(F.col("text"))).alias("tokens"))


def small_lexicon(entries: DataFrame, most: int = MOST_ENTRIES) -> DataFrame | None:
    """A lexicon that is small enough for tables, read once, each entry once; None if it is larger."""
    given = once(entries)
    rows = given.limit(most + 1).collect()
    return None if len(rows) > most else entries.sparkSession.createDataFrame(rows, given.schema).coalesce(1)


def once(entries: DataFrame) -> DataFrame:
    """Entries that are alike in category, form and kind once, the first."""
    pick = [F.min_by(c, "ord").alias(c) for c in ("raw", "tokens", "is_trigger")]
    return entries.groupBy("category", "norm", "is_regex").agg(F.min("ord").cast("long").alias("ord"), *pick)


def tables(rows: DataFrame, forms: Column, entries: DataFrame, search: Search, kinds: Sequence[str]) -> Tables | None:
    """The tables for a search in ``rows``; None if one is too large.  Words like the lexicon's are found among the distinct forms first."""
    found = []
    if "exact" in kinds:
        found.append(lookup(lattice.prefixes(entries, search.longest), "phrase", "found"))
    if "regex" in kinds:
        found.append(patterns.index(entries))
    if "fuzzy" in kinds:
        distinct = rows.select(F.explode(F.flatten(forms)).alias("form")).distinct()
        one = F.struct("ord", "category", "norm", "is_trigger", "word", "score")
        by_form = similar_entries(distinct, entries, search.cutoff).groupBy("form").agg(F.sort_array(F.collect_list(one)).alias("like"))
        found.append(lookup(by_form, "form", "like"))
    if any(t is None for t in found):
        return None
    by = dict(zip([k for k in ("exact", "regex", "fuzzy") if k in kinds], found, strict=True))
    return Tables(by.get("exact"), by.get("regex"), by.get("fuzzy"))


def candidates(norms: Column, forms: Column, known: Tables, search: Search, stop: Sequence[str]) -> Column:
    """All candidates of a text as ``SPAN``: each place, category and form of a kind once."""
    stops = F.array(*[F.lit(w) for w in sorted(set(stop))]).cast("array<string>")
    surface_of = lambda start, n: F.array_join(F.slice(norms, start + 1, n), " ")

    def span(start: Column, n: Column, e: Column, canonical: Column, score: Column, kind: str, surface: Column, gen: list[Column]) -> Column:
        filtered = F.forall(F.slice(forms, start + 1, n), lambda f: F.arrays_overlap(f, stops)) if stop else F.lit(False)
        return F.struct(
            start.alias("start"), (start + n).alias("end"), e["category"].alias("category"), canonical.alias("canonical"), score.cast("double").alias("score"),
            F.lit(kind).alias("match_type"), e["is_trigger"].alias("is_trigger"), filtered.alias("filtered"),
            F.struct(*[g.cast(t).alias(c) for g, t, c in zip(gen, ("int", "int", "int", "bigint", "bigint"), "abcde", strict=True)]).alias("gen"), surface.alias("surface"),
        )

    parts, zero = [], F.lit(0)
    if known.phrases:
        parts.append(F.flatten(F.transform(
            F.filter(lattice.in_row(forms, known.phrases, search.longest), lambda h: F.size(h["found"]["entries"]) > 0),
            lambda h: F.transform(h["found"]["entries"], lambda e: span(
                h["start"], h["n"], e, e["norm"], F.lit(1.0), "exact", surface_of(h["start"], h["n"]), [zero, -h["n"], h["start"], h["place"], e["ord"]])),
        )))
    if known.similar:

        def like(fs: Column, i: Column) -> Column:
            """Of the words that a token's forms are like, but are not, each entry once, by the best form."""
            found = F.flatten(F.array_compact(F.transform(fs, known.similar)))
            other = F.array_distinct(F.filter(found, lambda x: ~F.array_contains(fs, x["word"])))
            best = let(other, lambda xs: F.filter(xs, lambda x: ~F.exists(xs, lambda y: (y["ord"] == x["ord"]) & (y["score"] > x["score"]))))
            return F.transform(best, lambda x: span(i, F.lit(1), x, x["norm"], x["score"], "fuzzy", F.get(norms, i), [F.lit(1), i, zero, zero, x["ord"]]))

        parts.append(F.flatten(F.transform(forms, like)))
    if known.index:
        parts.append(F.transform(patterns.in_row(norms, known.index, search.longest), lambda h: span(
            h["start"], h["n"], h["entry"], h["surface"], F.lit(1.0), "regex", h["surface"], [F.lit(2), h["entry"]["ord"], -h["n"], h["start"], h["entry"]["ord"]])))

    def allowed(c: Column) -> Column:
        near = lambda words, r: F.arrays_overlap(
            F.slice(norms, F.greatest(zero, c["start"] - r) + 1, c["end"] + r - F.greatest(zero, c["start"] - r)), F.array(*[F.lit(w) for w in words]))
        number = (c["end"] - c["start"] == 1) & c["surface"].rlike(NUMBER)
        return number_allowed(c["category"], number, near(MEMORY_WORDS, 1), near(PRICE_WORDS, 2))

    none = F.array().cast(SPAN)
    return F.filter(F.concat(*[p.cast(SPAN) for p in parts]) if parts else none, allowed)


def chosen(found: Column, choice: Choice) -> Column:
    """The spans a choice takes of candidates, in order of places."""
    in_it = lambda c: c["match_type"].isin(*choice.kinds) & (phone_allowed(c["category"], c["surface"]) if choice.use_guard else F.lit(True))
    return chosen_in_row(F.filter(found, in_it), choice.simple, not choice.use_stop, choice.search.longest)


def tags(n: Column, spans: Column) -> Column:
    """IOB2 tags of ``n`` tokens with spans in order of places."""
    done = F.aggregate(
        spans,
        F.array().cast("array<string>"),
        lambda acc, s: F.concat(
            acc, F.array_repeat(F.lit("O"), s["start"] - F.size(acc)), F.array(F.concat(F.lit("B-"), s["category"])),
            F.array_repeat(F.concat(F.lit("I-"), s["category"]), s["end"] - s["start"] - 1),
        ),
    )
    return let(done, lambda x: F.concat(x, F.array_repeat(F.lit("O"), n - F.size(x))))


def _forms(norms: Column, search: Search, lemmas: Lookup | None) -> Column:
    return F.transform(norms, lambda t: variants(t, search.suffixes, search.basic, lemmas, normalised=True))


def matched(texts: DataFrame, entries: DataFrame, choices: Mapping[str, Choice], keep: Sequence[str], stop: Sequence[str] = ()) -> DataFrame | None:
    """``row_idx`` of all texts with the columns ``keep``: ``tokens``, ``candidates``, and, by a choice's name, its spans, an
    array as ``SPAN``, and their tags under the name with ``_tags``; None if the lexicon's tables are too large.

    ``entries`` is from ``small_lexicon``; ``texts`` has ``row_idx`` and ``tokens``, or ``text``.  Candidates are those of the first
    choice's search and kinds.  Null and empty texts have no tokens and no spans.
    """
    rows = settled(with_tokens(texts))
    searches = list(dict.fromkeys(c.search for c in choices.values()))
    first = next(iter(choices.values()))
    columns: dict[str, Column] = {}
    norms = F.col("norms")
    rows = settled(rows.withColumn("norms", all_normal(F.col("tokens"))))
    for i, s in enumerate(searches):
        columns[f"forms{i}"] = _forms(norms, s, lemma_table(texts, s.lemmas))
    rows = settled(rows.withColumns(columns))
    found: dict[str, Column] = {}
    for i, s in enumerate(searches):
        kinds = [k for k in KINDS if any(c.search == s and k in c.kinds for c in choices.values())]
        known = tables(rows, F.col(f"forms{i}"), entries, s, kinds)
        if known is None:
            return None
        found[f"found{i}"] = candidates(norms, F.col(f"forms{i}"), known, s, stop)
    rows = settled(rows.withColumns(found).select("row_idx", "tokens", *found))
    at = lambda c: F.col(f"found{searches.index(c.search)}")
    named = [n for n in choices if n in keep or f"{n}_tags" in keep]
    # A choice's name may be that of a column.
    rows = rows.select("row_idx", "tokens", F.filter(at(first), lambda c: c["match_type"].isin(*first.kinds)).alias("candidates") if "candidates" in keep else F.lit(None).alias("candidates"),
                       *[chosen(at(choices[n]), choices[n]).alias(n) for n in named])
    if any(f"{n}_tags" in keep for n in named):
        rows = settled(rows)
        rows = rows.withColumns({f"{n}_tags": tags(F.size("tokens"), F.col(n)) for n in named if f"{n}_tags" in keep})
    return rows.select("row_idx", *keep)


def all_normal(ts: Column) -> Column:
    """``normal`` of every token; texts whose tokens are all normal already are seen at once."""
    return F.when(~F.array_join(ts, " ").rlike(ABNORMAL), ts).otherwise(F.transform(ts, normal))


def exploded(rows: DataFrame, column: str) -> DataFrame:
    """One row per span of a column of ``matched``."""
    return rows.select("row_idx", F.inline(column))
