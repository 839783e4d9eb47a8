"""IOB2 tags from spans and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal


def emitted(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``row_idx, tokens, tags``: the tags of all texts, with or without spans; spans that don't fit are left out."""
    by_row = spans.groupBy("row_idx").agg(F.array_sort(F.collect_list(F.struct("start", "end", "category"))).alias("spans"))
    rows = texts.select("row_idx", "tokens").join(by_row, "row_idx", "left")
    n = F.size("tokens")
    fits = F.filter(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,category:string>>")), lambda s: (s["start"] >= 0) & (s["end"] <= n) & (s["start"] < s["end"]))
    # Span by span, so work follows the tokens; what lies between spans is O.
    rows = rows.withColumn("spans", fits)
    tags = F.aggregate(
        "spans",
        F.array().cast("array<string>"),
        lambda acc, s: F.concat(
            acc,
            F.array_repeat(F.lit("O"), s["start"] - F.size(acc)),
            F.array(F.concat(F.lit("B-"), s["category"])),
            F.array_repeat(F.concat(F.lit("I-"), s["category"]), s["end"] - s["start"] - 1),
        ),
    )
    return rows.select("row_idx", "tokens", tags.alias("tags")).select(
        "row_idx", "tokens", F.concat("tags", F.array_repeat(F.lit("O"), F.size("tokens") - F.size("tags"))).alias("tags")
    )


def invalid(rows: DataFrame) -> DataFrame:
    """``row_idx, pos, tag`` of every I- tag that continues nothing."""
    tag = rows.select("row_idx", F.posexplode("tags").alias("pos", "tag"), "tags")
    before = F.coalesce(F.get("tags", F.col("pos") - 1), F.lit("O"))
    orphan = F.col("tag").startswith("I-") & ~before.isin("O") & (F.substring(before, 3, 1 << 20) == F.substring("tag", 3, 1 << 20))
    return tag.where(F.col("tag").startswith("I-") & ~orphan).select("row_idx", "pos", "tag")


def spans_of(tags: Column | str, on_invalid: str = "drop") -> Column:
    """``array<struct<start, end, category>>`` of the spans in an array of tags; see ``decoded``."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    n = F.size(tags)
    category = lambda t: F.when(t != "O", F.substring(t, 3, 1 << 20))

    def goes_on(i: Column) -> Column:
        here, before = F.get(tags, i), F.get(tags, i - 1)
        return here.startswith("I-") & F.coalesce(category(before) == category(here), F.lit(False))

    # Runs: each from a tag that doesn't go on to the next such tag.
    begins = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~goes_on(i)))
    ends = F.concat(F.slice(begins, F.lit(2), n), F.array(n))
    runs = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"), F.get(tags, a).alias("tag")))
    if on_invalid == "raise":
        ok = F.assert_true(~F.coalesce(F.exists(runs, lambda r: r["tag"].startswith("I-")), F.lit(False)), F.lit("an I- tag continues nothing"))
        runs = F.when(ok.isNull(), runs)
    spans = F.transform(
        F.filter(runs, lambda r: r["tag"].startswith("B-")),
        lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), category(r["tag"]).alias("category")),
    )
    return F.coalesce(spans, F.array().cast("array<struct<start:int,end:int,category:string>>"))


def decoded(rows: DataFrame, on_invalid: str = "drop") -> DataFrame:
    """``row_idx, start, end, category`` of the spans in ``tags``, decoded within the row.

    A span begins with B- and goes on with I- of its category; an I- that
    continues nothing ends what is open and is left out, or, with
    ``on_invalid="raise"``, fails the query.
    """
    return rows.select("row_idx", F.inline(spans_of("tags", on_invalid)))


def term(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans with ``term``: the canonical form, or, of compounds and extensions, the surface."""
    rows = spans.join(texts.select("row_idx", "tokens"), "row_idx")
    surface = F.array_join(F.transform(F.slice("tokens", F.col("start") + 1, F.col("end") - F.col("start")), normal), " ")
    own = F.when(F.col("match_type").isin("compound", "contextual-extension"), surface).otherwise(F.col("canonical"))
    return rows.withColumn("term", normal(own)).drop("tokens")


def aspects(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """``row_idx, aspects``: the distinct terms of each category in order of their first place."""
    rows = term(spans, texts).where("term <> ''")
    by_category = rows.groupBy("row_idx", "category").agg(F.array_sort(F.collect_list(F.struct("start", "end", "term"))).alias("found"))
    terms = F.array_distinct(F.transform("found", lambda x: x["term"]))
    return by_category.groupBy("row_idx").agg(F.map_from_entries(F.collect_list(F.struct("category", terms.alias("terms")))).alias("aspects"))


def aspects_in_row(rows: DataFrame, spans: str = "spans") -> DataFrame:
    """``aspects`` of rows that hold their spans, in order of places, as ``matcher.matched`` gives them."""
    own = lambda s: normal(F.when(s["match_type"].isin("compound", "contextual-extension"), s["surface"]).otherwise(s["canonical"]))
    terms = F.transform(spans, lambda s: F.struct(s["category"].alias("category"), own(s).alias("term")))
    rows = rows.select("row_idx", F.filter(terms, lambda t: t["term"] != "").alias("terms")).where(F.size("terms") > 0)
    of = lambda c: F.array_distinct(F.transform(F.filter("terms", lambda t: t["category"] == c), lambda t: t["term"]))
    categories = F.array_distinct(F.transform("terms", lambda t: t["category"]))
    return rows.select("row_idx", F.map_from_entries(F.transform(categories, lambda c: F.struct(c, of(c)))).alias("aspects"))


def snippet(tokens: Column, start: Column, end: Column, radius: int = 4) -> Column:
    """A span with ``radius`` tokens on either side."""
    left = F.greatest(F.lit(0), start - radius)
    return F.array_join(F.slice(tokens, left + 1, F.least(F.size(tokens), end + radius) - left), " ")
