import random
import re
import unicodedata

from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.functions.morphology import CORE_SUFFIXES, english_lemma, suffix_roots, variants
from spanloom.functions.similarity import fuzzy_allowed, sequence_ratio
from spanloom.plans.extract import tokenised

# Fixed value: the characters that token edges lose.
EDGE = "!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~“”‘’…।"


def test_tokens_of_mixed_script_texts(spark):
    cases = {
        "Battery life: SUPER!!  camera-യുടെ quality...നല്ലത്": ["battery", "life", "super", "camera-യുടെ", "quality", "നല്ലത്"],
        "see https://x.y/z?q=1 @user_1 a@b.c www.foo.bar end": ["see", "a@b", "c", "end"],
        "ui-ux 3.5 4.5.6 a.b x..y --dash-- ​zero‍": ["ui-ux", "3.5", "4.5.6", "a", "b", "x", "y", "dash", "zero"],
        "nbsp here there ‘quoted’ don't $5": ["nbsp", "here", "there", "quoted", "don't", "5"],
        "": [],
        "...": [],
    }
    rows = [(i, t) for i, t in enumerate(cases)] + [(99, None)]
    got = {r.row_idx: r.tokens for r in tokenised(spark.createDataFrame(rows, "row_idx long, text string")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and got[99] == []


def test_nfc_and_zero_width_characters(spark):
    rows = [("café",), ("plain",), (None,), ("a​b",), ("കൊ",)]
    df = spark.createDataFrame(rows, "text string").select(text.nfc(F.col("text")).alias("text"))
    want = sorted(re.sub("[​-‍]", "", unicodedata.normalize("NFC", t or "")) for (t,) in rows)
    assert sorted(r.text for r in df.collect()) == want


def test_normal_and_tests_on_scripts(spark):
    df = spark.createDataFrame([(" “Don’t  STOP”. ",), ("ഫോൺ",), (r"\d+ gb",), ("(?:a)",)], "t string")
    got = df.select(text.normal(F.col("t")).alias("n"), text.has_malayalam(F.col("t")).alias("m"), text.looks_like_regex(F.col("t")).alias("r"))
    assert [tuple(g) for g in got.collect()] == [("don't stop", False, False), ("ഫോൺ", True, False), ("d+ gb", False, True), ("a", False, True)]


def test_text_key_folds(spark):
    got = spark.createDataFrame([("Straße  X",), ("ﬁ",)], "t string").select(text.text_key(F.col("t")).alias("k")).collect()
    assert [g.k for g in got] == ["strasse x", "fi"]


def _roots(base, suffixes):
    roots, front = {base}, {base}
    for _ in range(2):
        front = {f[: -len(s)] for f in front for s in suffixes if len(f) > len(s) + 2 and f.endswith(s)}
        front = {f for f in front if len(f) >= 2} - roots
        roots |= front
    return roots


def test_suffix_roots_and_variants(spark):
    words = ["ക്യാമറയുടെ", "batteryയുടെ", "ഫോണിന്റെ", "phones", "boss", "batteries", "buses", "camera's", "as"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r for r in df.select("w", suffix_roots(F.col("w")).alias("roots"), variants(F.col("w")).alias("v"), english_lemma(F.col("w")).alias("lemma")).collect()}
    assert all(set(got[w].roots) == _roots(w, CORE_SUFFIXES) for w in words)
    assert "battery" in got["batteryയുടെ"].v and "ക്യാമറ" in got["ക്യാമറയുടെ"].v
    assert [got[w].lemma for w in words[3:]] == ["phone", "boss", "battery", "bus", "camera", "as"]


def test_sequence_ratio_is_not_symmetric_and_gate(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string")
    assert [r.x for r in df.select(sequence_ratio("a", "b").alias("x")).collect()] == [0.25, 0.5]
    rows = [("abc", "abd", 0.89, False), ("abcde", "abcdf", 0.8, True), ("abcdef", "xbcdef", 0.9, False), ("abcdefg", "abcdefh", 0.75, True), ("abcdefg", "abcdefh", 0.74, False), ("camera", "cameraaaaaaaaa", 0.8, False)]
    df = spark.createDataFrame(rows, "a string, b string, r double, ok boolean")
    assert all(g.ok == g.x for g in df.select("ok", fuzzy_allowed(F.col("a"), F.col("b"), F.col("r"), 0.75).alias("x")).collect())


def test_strip_equals_python(spark):
    r = random.Random(1)
    words = ["".join(r.choice(EDGE + "ab") for _ in range(6)) for _ in range(200)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert all(g.s == g.w.strip(EDGE) for g in df.select("w", text.strip(F.col("w"), text.EDGE).alias("s")).collect())
