import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import sentence_spans, shingles
from spanloom.llm.sentence_spans import span_dedup, text_spans

UPPER = {c: c + 32 for c in range(65, 91)}


def sentences(text):
    """Sentences as (text with the white space behind it, words)."""
    out, now, words = [], "", []
    for m in re.finditer(r"([^ \t\n\x0b\x0c\r]+)([ \t\n\x0b\x0c\r]*)", text or ""):
        now, words = now + m[0], [*words, m[1].translate(UPPER)]
        tail = re.search(r"[^0-9A-Za-z\x80-\U0010ffff]*$", m[1])[0]
        if re.search(r"[.!?;:,]", tail) or "\n" in m[2]:
            out.append((now, words))
            now, words = "", []
    return [*out, (now, words)] if words else out


def brute(rows, least, n_words):
    """Per row the text left, sentences, and removed ones."""
    cut = [sentences(t) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, gone = set(), [set() for _ in rows]
    for i in order:
        for a in range(len(cut[i])):
            b, words = a, list(cut[i][a][1])
            while b + 1 < len(cut[i]) and (b - a + 1 < least or len(words) < n_words):
                b += 1
                words += cut[i][b][1]
            if b - a + 1 >= least and len(words) >= n_words:
                if tuple(words) in seen:
                    gone[i] |= set(range(a, b + 1))
                seen.add(tuple(words))
    out = []
    for (d, t), c, g in zip(rows, cut, gone, strict=True):
        lead = re.match(r"[ \t\n\x0b\x0c\r]*", t or "")[0]
        left = lead + "".join(s for k, (s, _) in enumerate(c) if k not in g)
        out.append((d, left if g else t, len(c), len(g)))
    return out


def corpus(seed=1, n=60):
    r = random.Random(seed)
    word = lambda: r.choice(["Über", "alpha", "b", "c3.5", "d-e", "(f)"]) + str(r.randrange(60)) + r.choice(["", "", "", ".", ",", "!***", ";)"])
    passage = [word() for _ in range(55)]
    rows = []
    for i in r.sample(range(1000), n):
        words = [word() for _ in range(r.choice([0, 3, 20, 100]))]
        if r.random() < 0.5:
            words[len(words) // 2 : len(words) // 2] = passage
        rows.append((i, r.choice(["", " \n"]) + "".join(w + r.choice([" ", " ", " ", "\n", "\t "]) for w in words)))
    return rows + [(rows[3][0], rows[3][1])] * 2 + [(2000, None), (2001, ""), (None, rows[5][1]), (None, rows[5][1])]


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, row string, first int").coalesce(1)
    key = lambda x: str(x)
    for least, n_words in ((2, 16), (3, 1)):
        got = span_dedup(df, sentences=least, words=n_words).collect()
        want = brute(rows, least, n_words)
        assert sorted(((g.doc_id, g.text, g.n_sentences, g.n_removed) for g in got), key=key) == sorted(want, key=key)
        assert sorted(g.first for g in got) == list(range(len(rows))) and sum(w[3] for w in want) > 100


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB. ,é\n\t!1", max_size=80))
def test_sentences_partition_the_text(text):
    (got,) = text_spans([text])
    assert len(got.starts) == len(sentences(text))
    bounds = [*got.starts.tolist(), len(got.raw)]
    assert [got.raw[a:b].decode() for a, b in zip(bounds, bounds[1:])] == [s for s, _ in sentences(text)]


def test_long_texts_are_cut_between_words(monkeypatch):
    texts = [t for _, t in corpus(2)]
    want = text_spans(texts)
    monkeypatch.setattr(shingles, "_PART", 64)
    monkeypatch.setattr(sentence_spans, "_PART", 64)
    for a, b in zip(want, text_spans(texts), strict=True):
        assert all((getattr(a, c) == getattr(b, c)).all() for c in ("starts", "first", "last", "hi", "lo"))


def test_empty_table(spark):
    assert span_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
