"""Word sets and sectioned lexicons from text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import looks_like_regex, nfc, normal, strip_space, tokens

# Headers that open a section, and the category that takes another's name.
HEADERS = (
    "memory", "screen", "display", "ui-ux", "camera", "phone", "os", "tablet", "laptop", "battery",
    "software", "processor", "applications", "price", "speaker", "network", "hardware", "design", "general", "game",
)
ALIASES = {"screen": "display"}
#: The categories of the evaluation labels.
EVALUATION_CATEGORIES = (
    "phone", "camera", "price", "software", "display", "network", "design", "os",
    "battery", "memory", "applications", "general", "processor", "speaker", "hardware", "tablet",
)
ENCODINGS = ("utf-8-sig", "windows-1252")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, line`` of a text file of bounded size, decoded as UTF-8, else as Windows-1252.

    The file is read through Spark, so any store that Spark opens will do.
    """
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
    for name in ENCODINGS:
        try:
            text = data.decode(name)
            break
        except UnicodeDecodeError:
            continue
    else:
        raise UnicodeError(f"{path} has none of the encodings {ENCODINGS}")
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line_no long, line string")


def word_set(lines: DataFrame) -> DataFrame:
    """``word``: the distinct normalised lines that aren't blank."""
    return lines.select(normal(nfc(F.col("line"))).alias("word")).where("word <> ''").distinct()


def read_word_sets(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The union of word sets."""
    out = spark.createDataFrame([], "word string")
    for p in paths:
        out = out.unionByName(word_set(read_lines(spark, p)))
    return out.distinct()


def lexicon(lines: DataFrame) -> DataFrame:
    """Entries of a sectioned lexicon: ``ord, category, original, raw, norm, tokens, is_regex, is_trigger``.

    A line of a known header and a dash opens a section, and the header is
    itself an entry, a trigger.  Lines before the first header are left out.
    Entries alike in category, form and kind are one: a trigger if one is, at
    the place of the first.
    """
    raw = strip_space(nfc(F.col("line")))
    head = F.when(raw.endswith("-"), normal(F.substring(raw, F.lit(1), F.length(raw) - 1)))
    rows = lines.select("line_no", raw.alias("raw"), F.when(head.isin(*HEADERS), head).alias("head")).where("raw <> ''")
    # A lexicon is a file of bounded size; its lines have one order.
    rows = rows.withColumn("original", F.last("head", ignorenulls=True).over(Window.orderBy("line_no"))).where(
        "original is not null"
    )
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    is_regex = F.col("head").isNull() & looks_like_regex(F.col("raw"))
    rows = rows.select(
        "line_no",
        F.coalesce(F.try_element_at(alias, F.col("original")), "original").alias("category"),
        "original",
        F.coalesce("head", "raw").alias("raw"),
        F.when(is_regex, F.col("raw")).otherwise(F.coalesce("head", normal(F.col("raw")))).alias("norm"),
        is_regex.alias("is_regex"),
        F.col("head").isNotNull().alias("is_trigger"),
    )
    rows = rows.withColumn("tokens", F.when(F.col("is_regex"), F.array().cast("array<string>")).otherwise(tokens(F.col("norm"))))
    rows = rows.where(F.col("is_regex") | (F.size("tokens") > 0))
    latest = F.struct(F.col("is_trigger"), F.when(F.col("is_trigger"), F.col("line_no")).otherwise(-F.col("line_no")))
    pick = lambda c: F.max_by(c, latest).alias(c)
    return rows.groupBy("category", "norm", "is_regex").agg(
        F.min("line_no").alias("ord"), pick("original"), pick("raw"), pick("tokens"), pick("is_trigger")
    ).select("ord", "category", "original", "raw", "norm", "tokens", "is_regex", "is_trigger")


def inventory(entries: DataFrame) -> DataFrame:
    """Counts of a lexicon: entries, literals, distinct literals, triggers and regexes."""
    literal = ~F.col("is_regex") & ~F.col("is_trigger")
    return entries.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count(F.when(literal, 1)).alias("literals"),
        F.count_distinct(F.when(literal, F.col("norm"))).alias("distinct_literals"),
        F.count(F.when(F.col("is_trigger"), 1)).alias("triggers"),
        F.count(F.when(F.col("is_regex"), 1)).alias("regexes"),
    )


def prune(entries: DataFrame, forms: DataFrame) -> DataFrame:
    """The lexicon without entries whose form is in ``forms`` (``norm``), in the same order."""
    return entries.join(forms.select("norm").distinct(), "norm", "left_anti").select(*entries.columns)


def with_taxonomy(entries: DataFrame, categories: Sequence[str] = EVALUATION_CATEGORIES) -> DataFrame:
    """Entries of the given categories alone."""
    return entries.where(F.col("category").isin(*categories))
