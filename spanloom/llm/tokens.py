"""Token ids of whole texts with a file of the tokenizers library.

The library takes about 0.3 s of CPU a MB for a vocabulary of words, mostly to
merge the same words again.  ``Encoder`` therefore keeps the ids of pieces it
has met: for a tokenizer that lower-cases, drops white space and then merges
within pieces of one pattern, and for texts made only of characters on which
Python and the library surely agree, it cuts the pieces itself and asks the
library for each new one.  As no piece holds white space, texts are split there
by Arrow, and Python sees each distinct word of a few texts once.  All other
texts go to the library as they are.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the pattern of pieces for which the short way holds.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters and numbers among ``_SAFE``; all of it is stable under NFC, and
#: lower-casing goes character by character.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ"
_NUMBERS = "0-9²³¹¼½¾"
_SAFE = re.compile("[\t\n\r\x20-\x7e¡-įı-ſ‐-‧‰-⁞€]*")
_CUT = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^\t\n\r {_LETTERS}{_NUMBERS}]+")
_SURROGATE = re.compile("[\ud800-\udfff]")
#: Pieces in each of a worker process's two tables: about 30 MB each at most.
KEPT_PIECES = 150_000
#: Bytes of texts that are encoded together; a longer text is encoded alone or with those before it.
TOGETHER = 1 << 22


class _Pieces(dict):
    """Little-endian 32-bit ids by word, a string of safe characters without white space.

    Words of several pieces are cut and put together again each time; pieces are kept in
    two tables, of which a full one becomes the older one.  The library's model merges each
    new piece in the byte alphabet, where ASCII stands for itself.
    """

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.older, self.merge = {}, tokenizer.model.tokenize
        self.alphabet = _Alphabet(tokenizer.pre_tokenizer)
        # Pieces are asked for once, so the model's own cache would only be filled and emptied.
        if hasattr(tokenizer.model, "_resize_cache"):
            tokenizer.model._resize_cache(0)

    def __missing__(self, piece: str) -> bytes:
        if not piece.isalpha() and len(cut := _CUT.findall(piece)) != 1:
            return b"".join(map(self.__getitem__, cut))
        ids = self.older.get(piece)
        if ids is None:
            found = [t.id for t in self.merge(piece if piece.isascii() else piece.translate(self.alphabet))]
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(self) >= KEPT_PIECES:
            self.older = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class _Alphabet(dict):
    """What the library's pre-tokenizer makes of each character's bytes, for ``str.translate``."""

    def __init__(self, pre_tokenizer) -> None:
        super().__init__()
        self.pre_tokenizer = pre_tokenizer

    def __missing__(self, char: int) -> str:
        self[char] = self.pre_tokenizer.pre_tokenize_str(chr(char))[0][0]
        return self[char]


class Encoder:
    """Encodes with ``Tokenizer.from_file(path)`` and no special tokens."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = _Pieces(self.tokenizer)
        self.special = [t["content"] for t in spec.get("added_tokens") or ()]
        self.short = _cuts_pieces(spec)

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null counts as empty.

        A lone surrogate, which no column of strings can hold, counts as U+FFFD.
        """
        out: list[bytes | None] = [None] * len(texts)
        short, rest = [], []
        for i, t in enumerate(texts):
            if not t:
                out[i] = b""
            elif self.short and _SAFE.fullmatch(t) and not any(s in t for s in self.special):
                short.append(i)
            else:
                rest.append(i)
        for i, ids in zip(short, self._by_words([texts[i].lower() for i in short]), strict=True):
            out[i] = ids
        for i in rest:  # one by one, so a batch of long texts isn't held as objects at once
            whole = texts[i].encode("utf-16", "surrogatepass").decode("utf-16", "replace") if _SURROGATE.search(texts[i]) else texts[i]
            ids = self.tokenizer.encode(whole, add_special_tokens=False).ids
            out[i] = np.array(ids, dtype="<u4").tobytes()
        return out

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """The ids of lower-cased texts of safe characters: their words' ids, joined."""
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        known = words.flatten().dictionary_encode()
        found = map(self.pieces.__getitem__, known.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = pa.array(found, pa.large_binary()).take(known.indices)
        return pc.binary_join(pa.ListArray.from_arrays(words.offsets, ids), pa.scalar(b"", ids.type)).to_pylist()


def together(texts: pa.Array) -> Iterator[slice]:
    """Neighbouring rows of a column whose texts begin within the same ``TOGETHER`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = np.concatenate([[0], ends[:-1]]) // TOGETHER
    cuts = [0, *(np.flatnonzero(np.diff(begin)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield slice(a, b)


def _cuts_pieces(spec: dict) -> bool:
    """Whether a tokenizer file is of the kind for which the short way holds."""
    norm, pre, model = (spec.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    norms = norm.get("normalizers") or [norm]
    pres = pre.get("pretokenizers") or [pre]
    return (
        [n.get("type") for n in norms] == ["NFC", "Replace", "Lowercase"]
        and norms[1].get("pattern") == {"Regex": "\\s+"}
        and norms[1].get("content") == " "
        and [p.get("type") for p in pres] == ["Split", "ByteLevel"]
        and pres[0].get("pattern") == {"Regex": PIECES}
        and (pres[0].get("behavior"), pres[0].get("invert")) == ("Removed", True)
        and not pres[1].get("add_prefix_space")
        and not pres[1].get("use_regex")
        and model.get("type") == "BPE"
    )


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker process's encoder for a file, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
