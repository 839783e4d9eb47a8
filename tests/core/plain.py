"""Plain models of tokens, forms and candidates, to hold the expressions against."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from itertools import product

from spanloom.operators import candidates as joined

# Characters that token edges lose, and those at which texts part.
EDGE = "!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~“”‘’…।"
BREAK = ",;:!?()[]{}\"“”"
#: Endings of base forms, as ending, least length of the word, and what stands in its place; the first that fits counts.
ENDINGS = [("ies", 5, "y"), ("ses", 5, "s"), ("ss", 0, "ss"), ("s", 4, "")]
ZERO_WIDTH = "​‌‍⁠﻿"


def tokens(text):
    text = "".join(c for c in unicodedata.normalize("NFC", text or "") if c not in ZERO_WIDTH)
    text = re.sub(r"(?i:https?://|www\.)[^\s\x1c-\x1f]+", " ", text, flags=re.A if text.isascii() else 0)
    text = re.sub(r"(?<!\w)@[A-Za-z0-9_]+", " ", text)
    out = []
    for chunk in "".join(" " if c in BREAK else c for c in text).split():
        chunk = chunk.strip(EDGE).strip("-")
        parts = [p.strip(EDGE) for p in re.split(r"\.{2,}|(?<!\d)\.(?!\d)", chunk)] if "." in chunk else [chunk]
        out += [p.lower() for p in parts if p]
    return out


def normal(token):
    return " ".join(token.replace("’", "'").lower().strip().strip(EDGE).split())


def is_malayalam(token):
    return any("ഀ" <= c <= "ൿ" for c in token)


def base_form(word, lemmas):
    word = word[:-2] if word.endswith("'s") and len(word) > 3 else word
    if word in lemmas:
        return lemmas[word]
    for ending, least, instead in ENDINGS:
        if word.endswith(ending) and len(word) >= least:
            return word[: len(word) - len(ending)] + instead
    return word


def forms(token, suffixes=(), basic=False, lemmas=()):
    found = {normal(token)}
    if not basic:
        if is_malayalam(normal(token)):
            for _ in range(2):
                found |= {normal(f[: len(f) - len(s)]) for f in found for s in suffixes if f.endswith(s) and len(f) > len(s) + 2 and len(normal(f[: len(f) - len(s)])) > 1}
        found |= {base_form(f, dict(lemmas)) for f in found if not is_malayalam(f)}
    return sorted(found - {""})


def passes(form, word, cutoff):
    """The ratio of a form and a word if it suffices, else 0."""
    a, b = sorted((len(form), len(word)))
    need = max(cutoff, {1: 0.9, 2: 0.9, 3: 0.9, 4: 0.8, 5: 0.8}.get(a, 0))
    if form == word or not form or is_malayalam(form) != is_malayalam(word) or form[0] != word[0] or b - a > max(2, int(b * 0.4 + 0.5)):
        return 0.0
    ratio = SequenceMatcher(None, form, word).ratio()
    return ratio if ratio >= need else 0.0


def candidates(rows, lexicon, suffixes=(), basic=False, cutoff=0.75, longest=4, lemmas=(), patterns=re.compile):
    """Candidates by loops over windows and entries; ``patterns`` gives a compiled pattern or None."""
    out = set()
    compiled = {e["raw"]: patterns(e["raw"]) for e in lexicon if e["is_regex"]}
    for i, ts in rows:
        fs, norms = [forms(t, suffixes, basic, lemmas) for t in ts], [normal(t) for t in ts]
        for n in range(1, longest + 1):
            for s in range(len(ts) - n + 1):
                surface = " ".join(norms[s : s + n])
                phrases = set(product(*fs[s : s + n]))
                near = lambda ws, r, s=s, norms=norms: any(x in ws for x in norms[max(0, s - r) : s + 1 + r])
                for e in lexicon:
                    canonical, kind, score = e["norm"], "exact", 1.0
                    if e["is_regex"]:
                        p = compiled[e["raw"]]
                        hit, canonical, kind = bool(p and p.fullmatch(surface)), surface, "regex"
                    elif not (hit := tuple(e["tokens"]) in phrases) and n == 1 == len(e["tokens"]):
                        score = max((passes(f, e["tokens"][0], cutoff) for f in fs[s]), default=0.0)
                        hit, kind = score > 0, "fuzzy"
                    if hit and n == 1 and re.fullmatch(r"\d+(\.\d+)?", surface):
                        hit = {"phone": False, "memory": near(joined.MEMORY_WORDS, 1), "price": near(joined.PRICE_WORDS, 2)}.get(e["category"], True)
                    if hit:
                        out.add((i, s, s + n, e["category"], canonical, kind, round(score, 9)))
    return out
