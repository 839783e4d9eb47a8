import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanloom.llm import tokens
from spanloom.llm.queries import tokenizer_path
from spanloom.llm.token_file import decode_chunk, encode_chunk, token_file
from spanloom.llm.tokens import Encoder

ENC = Encoder(tokenizer_path())


def plain(text):
    return ENC.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aAzZ's'tllé!İſßΣς’“ 9²\n\t  <|>"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_encoder_equals_the_library(texts):
    got = ENC.encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [plain(t) for t in texts]


def test_lone_surrogates_count_as_the_replacement_character():
    got = [np.frombuffer(b, "<u4").tolist() for b in ENC.encode(["a\ud800b", "\udfff", "\U0001f600"])]
    assert got == [plain("a\ufffdb"), plain("\ufffd"), plain("\U0001f600")]


def test_encoder_takes_special_strings_as_the_library_does():
    t = "a<|endoftext|>b c'll ''s <|startoftext|>"
    assert np.frombuffer(ENC.encode([t])[0], "<u4").tolist() == plain(t)


def test_many_new_pieces_and_small_tables(monkeypatch):
    """Tables that are emptied often, and no cache in the library's model: the ids stay the library's."""
    monkeypatch.setattr(tokens, "KEPT_PIECES", 500)
    own, library = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    assert own.pieces.merge("the") is not None and len(own.pieces) == 0
    texts = [" ".join(f"w{i * 7919 % 12_000}x{chr(97 + i % 26)}é word, it's" for i in range(at, at + 300)) for at in range(0, 12_000, 300)] * 2
    got = own.encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(own.pieces) <= 500 and len(own.pieces.older) <= 500


def test_words_of_a_few_texts_are_looked_up_once(monkeypatch):
    """The time of the encoder went into a lookup for each piece, and into whole encodings of pieces beyond ASCII."""
    own, library = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    asked = []
    monkeypatch.setattr(tokens._Pieces, "__getitem__", lambda self, w: asked.append(w) or (self.get(w) or self.__missing__(w)), raising=False)
    monkeypatch.setattr(own, "tokenizer", None)
    texts = ["Élan vital, it's\tthe élan\r\n", "  ", "vital, élan " * 1000, "x²y 12e", "'s!'s", "the"]
    got = own.encode([None, *texts, ""])
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [[], *(library.encode(t, add_special_tokens=False).ids for t in texts), []]
    assert asked.count("élan") == 1 and len(asked) < 30


def test_every_safe_character_is_the_librarys():
    library = Tokenizer.from_file(tokenizer_path())
    safe = [c for c in map(chr, range(0x3000)) if tokens._SAFE.fullmatch(c)]
    texts = [t for c in safe for t in (c, f"Ab{c}cD {c}9{c}'s", f"'{c}{c}ll.{c}")]
    assert len(safe) > 380
    assert [np.frombuffer(b, "<u4").tolist() for b in ENC.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_rows_that_are_encoded_together(monkeypatch):
    monkeypatch.setattr(tokens, "TOGETHER", 10)
    column = pa.array([None, "é" * 4, "abc", "", "x" * 35, None, "y", "z" * 9, "w"])
    parts = list(tokens.together(column))
    assert [column[p].to_pylist() for p in parts] == [[None, "é" * 4, "abc"], ["", "x" * 35], [None, "y", "z" * 9], ["w"]]
    assert list(tokens.together(column[4:6])) == [slice(0, 1), slice(1, 2)]
    assert list(tokens.together(column[:0])) == []


@pytest.mark.parametrize("bits", [False, True])
@settings(max_examples=50, deadline=None)
@given(docs=st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=30), max_size=6), block=st.integers(1, 17))
def test_chunk_round_trip(bits, docs, block):
    raw = [np.array(d, dtype="<u4").tobytes() for d in docs]
    names = [None if i == 0 else i for i in range(len(docs))]
    ids, counts, flat = decode_chunk(encode_chunk(names, raw, block, bits))
    assert ids == names and counts.tolist() == [len(d) for d in docs]
    assert flat.tolist() == [x for d in docs for x in d]


def brute(rows, end):
    out, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*plain(t), end]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("bits", [False, True])
def test_whole_operator_equals_brute_force(spark, bits):
    rows = [(i * 7 % 50, f"Doc {i}: it's the {'very ' * (i % 9)}thing№{i}.", "x", i) for i in range(50)]
    rows += [(100, None, "x", 1), (101, "", "x", 2), (102, "Long " * 30_000, "x", 3), (None, "no id", "x", 4), (5, "tie", "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, n_ids long")
    got = token_file(df, tokenizer_path(), end_id=2, chunk_ids=40, block_ids=16, bits=bits).collect()
    want = brute([r[:2] for r in rows], 2)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_file(df, tokenizer_path(), end_id=2).collect() == []
