"""Text functions: normal forms, cleaning, tokens and tests on scripts.

White space and digits are those of Unicode, spelled out in the patterns,
because Java's ``\\s`` and ``\\d`` are ASCII.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and patterns that decide which tokens come out.
ZERO_WIDTH = "[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]"
SPACE = "[\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
URL = f"(?i)(?:https?://{NOT_SPACE}+|www\\.{NOT_SPACE}+)"
MENTION = "(?<![\\p{L}\\p{N}_])@[A-Za-z0-9_]+"
EDGE = "!\"#$%&()*+,./:;<=>?@\\[\\\\\\]^_`{|}~“”‘’…।"
BREAKS = SPACE.replace("]", ",;:!?()\\[\\]{}\"“”]", 1)
MALAYALAM = "[\\x{0D00}-\\x{0D7F}]"
REGEX_MARKS = ("(?:", "\\d", "\\s", "\\b", "[", "(?=", "(?<")


def _in_python(f, c: Column, kind: str = "string") -> Column:
    """A function of single values as a pandas UDF, made when it is used: it needs a session."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(f)

    return F.pandas_udf(run, kind)(c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_key(c: Column) -> Column:
    """NFKC, case folded, with single spaces: equal for texts that read the same."""
    return _in_python(lambda t: " ".join(unicodedata.normalize("NFKC", t or "").casefold().split()), c)


def without_zero_width(c: Column) -> Column:
    return F.regexp_replace(c, ZERO_WIDTH, "")


def nfc(c: Column) -> Column:
    """NFC without zero-width characters; null gives the empty string.

    Texts without a character from U+0300 on are in NFC already: of those, Python gets nulls.
    """
    c = F.coalesce(c, F.lit(""))
    foreign = F.when(c.rlike("[\\x{300}-\\x{10FFFF}]"), c)
    composed = _in_python(lambda t: t and unicodedata.normalize("NFC", t), foreign)
    return F.when(composed.isNotNull(), without_zero_width(composed)).otherwise(c)


def compared(c: Column) -> Column:
    """A text in NFC, case as it is, with single spaces: equal for reviews that are the same."""
    return strip_space(F.regexp_replace(nfc(c), f"{SPACE}+", " "))


def strip(c: Column, chars: str) -> Column:
    """Without leading and trailing characters of a class given without brackets."""
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def _links_out(c: Column) -> Column:
    """Without links and mentions; texts that can't have any aren't searched."""
    linked = lambda x: F.contains(x, F.lit("://")) | F.contains(F.lower(x), F.lit("www."))
    c = let(c, lambda x: F.when(linked(x), F.regexp_replace(x, URL, " ")).otherwise(x))
    return let(c, lambda x: F.when(F.contains(x, F.lit("@")), F.regexp_replace(x, MENTION, " ")).otherwise(x))


def clean(c: Column) -> Column:
    """A text in NFC without links and mentions, with single spaces."""
    return strip_space(F.regexp_replace(_links_out(c), f"{SPACE}+", " "))


#: Those of ``BREAKS`` below U+0100, one by one: the engine looks such a class up in a table.  All others are from U+1680 on.
_NEAR_BREAKS = "[" + "".join(f"\\x{ord(x):02X}" for x in "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0,;:!?()[]{}\"") + "]+"


def _chunks(c: Column) -> Column:
    """A text parted at ``BREAKS``; only texts with a character from U+1680 on are searched for all of them."""
    return let(c, lambda x: F.when(x.rlike("[\\x{1680}-\\x{FFFF}]"), F.split(x, f"{BREAKS}+", -1)).otherwise(F.split(x, _NEAR_BREAKS, -1)))


def trim(c: Column, chars: str) -> Column:
    """``strip`` without a pattern, which is faster on short strings."""
    return F.btrim(c, F.lit(re.sub(r"\\(.)", r"\1", chars)))


def tokens(c: Column) -> Column:
    """Lexical tokens, lower-cased, of a text in NFC.

    Texts part at white space and strong punctuation; edges lose signs and
    dashes; dots part tokens where there are several or no digit is beside.
    """

    def parts(chunk: Column) -> Column:
        pieces = F.transform(F.split(chunk, "\\.{2,}|(?<!\\p{Nd})\\.(?!\\p{Nd})"), lambda p: F.lower(trim(p, EDGE)))
        return F.when(F.contains(chunk, F.lit(".")), pieces).otherwise(F.array(F.lower(chunk)))

    def whole(chunks: Column) -> Column:
        dotted = F.exists(chunks, lambda x: F.contains(x, F.lit(".")))
        return F.when(dotted, F.flatten(F.transform(chunks, parts))).otherwise(F.transform(chunks, F.lower))

    chunks = F.transform(_chunks(_links_out(c)), lambda t: trim(trim(t, EDGE), "-"))
    return F.filter(let(chunks, whole), lambda t: t != "")


def normal(c: Column) -> Column:
    """Lower-cased, plain apostrophes, no signs at the edges, single spaces; ``c`` is in NFC."""
    c = strip(strip_space(F.replace(F.lower(c), F.lit("’"), F.lit("'"))), EDGE)
    return F.regexp_replace(c, f"{SPACE}+", " ")


def has_malayalam(c: Column) -> Column:
    return c.rlike(MALAYALAM)


def looks_like_regex(c: Column) -> Column:
    out = F.lit(False)
    for m in REGEX_MARKS:
        out = out | F.contains(c, F.lit(m))
    return out
