"""Quality rules: ordered lists of threshold conjunctions, learned from labelled documents.

``statistics`` counts each text in its own row (nothing shuffles), ``FEATURES`` are ratios of these
counts.  ``learn`` covers the low-quality documents of a sample one rule after the other:
a rule grows, condition by condition, by the gain in information on two thirds of
the sample, and loses its last conditions again where the other third is better told apart
without them.  A rule whose precision on that third, or on all, is under ``PRECISION`` ends the
list, so documents that look clean stay.  ``verdict`` is the list as one Spark conditional.

Bound: about ``FIT_ROWS`` labelled ids, picked by a hash, are learned from; the driver
holds a row of ``FEATURES`` for each.  Everything else covers all rows and whole texts.

Defined results: null and blank texts have no words, all counts are 0 and they fail the base rule. Of an id
labelled several times the lowest label counts, of one with several texts the least
statistics; labels that are null, or of ids that are null or not there, are left out.  Without a low-quality
label the list is empty and the base rule alone decides.  Equal rows are rows of their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, only
from .periodic_runs import names, numbered, words_of

FIT_ROWS = 20_000
#: Words in a window that counts as repeated.
WINDOW = 8
#: Fixed values of the base rule: fewest words, and most words in repeated windows, in percent.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Rules and conditions in one at most, thresholds tried for a feature, documents a rule covers at least, and its precision.
MOST_RULES, MOST_CONDITIONS, THRESHOLDS, LEAST_COVERED, PRECISION = 16, 4, 64, 4, 0.97

#: The symbols of the contract.
SYMBOLS = b"#*$%&|<>"
_CONTINUES = bytes(range(0x80, 0xC0))
_BLANK = BLANKS.encode()
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_most", "n_upper", "n_digits", "n_marks"]


def counts_of(text: bytes | None) -> tuple[int, ...]:
    """``COUNTS`` of a text in UTF-8, in which ASCII bytes stand for themselves alone."""
    text = text or b""
    words = words_of(text)
    n = len(words)
    of = lambda chars: len(text) - len(text.translate(None, chars))
    lines = Counter(line for line in text.split(b"\n") if line.strip(_BLANK))
    return (
        n, len(text.translate(None, _CONTINUES + _BLANK)), of(SYMBOLS), lines.total() - len(lines), repeated_words(words),
        lines.total(), max(Counter(words).values(), default=0), of(_UPPER), of(b"0123456789"), of(b"!?"),
    )


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words (a power of two) that occur twice or more."""
    n = len(words)
    level = window.bit_length() - 1
    found = names(numbered(words), window) if n >= window else []
    if len(found) <= level:  # shorter windows differ already
        return 0
    starts = np.flatnonzero(np.bincount(found[level])[found[level]] > 1)
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return int((np.cumsum(change[:n]) > 0).sum())


def statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``COUNTS`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([counts_of(t) for t in batch["text"]], columns=COUNTS, dtype=np.int64).assign(id=batch["id"].to_numpy())

    # Ids go as text, as pandas holds whole numbers beside nulls as floats.
    rows = only(docs, doc_id, text).toDF("doc_id", "text")
    given = rows.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("binary").alias("text"))
    found = given.mapInPandas(run, "id string, " + ", ".join(f"{c} long" for c in COUNTS))
    return found.select(F.col("id").cast(rows.schema["doc_id"].dataType).alias("doc_id"), *COUNTS)


#: What rules compare, as ratio of two counts that both grow with the text, so that long texts aren't judged by length.
FEATURES = {
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "most_frequent_word": ("n_most", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def feature(name: str) -> Column:
    """A ratio of counts; 0 where there is nothing to divide by."""
    a, b = FEATURES[name]
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``name`` over ``threshold``, or, if ``at_most``, not over it."""

    name: str
    at_most: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.name} {'<=' if self.at_most else '>'} {self.threshold:g}"

    def holds(self, x: np.ndarray) -> np.ndarray:
        return (x <= self.threshold) == self.at_most

    def column(self) -> Column:
        f = feature(self.name)
        return f <= self.threshold if self.at_most else f > self.threshold


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: np.ndarray, names: Sequence[str]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x[:, names.index(c.name)])
    return out


def _thresholds(x: np.ndarray) -> np.ndarray:
    """Middles between neighbouring values, or, of many values, between neighbouring quantiles: rows on neither side are near."""
    values = np.unique(x)
    if len(values) > THRESHOLDS:
        values = np.unique(np.quantile(x, np.linspace(0, 1, THRESHOLDS + 1), method="nearest"))
    return (values[1:] + values[:-1]) / 2


def grown(x: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> Rule:
    """A conjunction that covers low-quality rows: the condition of most gain in information first, until all it covers are bad."""
    rule: Rule = ()
    while len(rule) < MOST_CONDITIONS and bad.any() and not bad.all():
        before = np.log2(bad.mean())
        best, gain = None, 0.0
        for i, name in enumerate(names):
            for t in _thresholds(x[:, i]):
                under = x[:, i] <= t
                for at_most, side in ((True, under), (False, ~under)):
                    p = int(bad[side].sum())
                    if p and (g := p * (np.log2(p / side.sum()) - before)) > gain + 1e-9:
                        best, gain = (Condition(name, at_most, float(t)), side), g
        if best is None:
            break
        rule = (*rule, best[0])
        x, bad = x[best[1]], bad[best[1]]
    return rule


def pruned(rule: Rule, x: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> Rule:
    """The beginning of a rule that tells rows apart best; of equal ones the shortest."""

    def worth(r: Rule) -> float:
        hit = covered(r, x, names)
        p = int(bad[hit].sum())
        return (2 * p - hit.sum()) / hit.sum() if hit.any() else -1.0

    return max((rule[:n] for n in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))


def learned(x: np.ndarray, bad: np.ndarray, prune: np.ndarray, names: Sequence[str]) -> list[Rule]:
    """The list; ``prune`` marks the third on which rules are pruned and judged."""
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        rule = grown(x[~prune], bad[~prune], names)
        if not rule:
            break
        rule = pruned(rule, x[prune], bad[prune], names)
        hit = covered(rule, x, names)
        apart = hit & prune
        if hit.sum() < LEAST_COVERED or not apart.any() or min(bad[hit].mean(), bad[apart].mean()) < PRECISION:
            break
        rules.append(rule)
        x, bad, prune = x[~hit], bad[~hit], prune[~hit]
    return rules


def learn(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", fit_rows: int = FIT_ROWS
) -> list[Rule]:
    """The list for ``labels`` (``doc_id``, ``quality`` 0 or 1) of ``docs``; what the base rule drops is not learned from."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, fit_rows / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_003)) < share * 1_000_003)
    rows = only(docs, doc_id, text).toDF("doc_id", "text").join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")
    names = list(FEATURES)
    of_id = statistics(rows).where(~base_failed()).groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("s")).select("doc_id", "s.*")
    judged = of_id.join(F.broadcast(picked), "doc_id").select(
        *[feature(n).alias(n) for n in names], (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(3)) == 0).alias("prune")
    )
    sample = judged.toPandas()  # about ``fit_rows`` rows
    x = sample[names].to_numpy(dtype=float)
    order = np.lexsort(x.T[::-1])  # the list doesn't depend on the order in which rows come
    x, bad, prune = x[order], sample["bad"].to_numpy(dtype=bool)[order], sample["prune"].to_numpy(dtype=bool)[order]
    return learned(x, bad, prune, names)


def verdict(rules: Sequence[Rule]) -> Column:
    """The first rule that a row meets, as text; null for rows that meet none."""
    out = None
    for rule in rules:
        meets = F.lit(True)
        for c in rule:
            meets = meets & c.column()
        said = F.lit(" and ".join(map(str, rule)))
        out = F.when(meets, said) if out is None else out.when(meets, said)
    return F.lit(None).cast("string") if out is None else out


def quality_rules(docs: DataFrame, rules: Sequence[Rule], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``COUNTS``, ``base_failed``, ``kept`` and ``rule``, what a dropped document meets, of every row."""
    rows = statistics(docs, text, doc_id).withColumn("base_failed", base_failed())
    rows = rows.withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
