import math
import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm.packing import Packer, best_fit
from spanloom.llm.queries import tokenizer_path
from spanloom.llm.tokens import Encoder


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60), st.integers(1, 5))
def test_packer_is_bounded_best_fit(lengths, k):
    packer, used = Packer(16, k), {}
    for n in lengths:
        open_ = {b: 16 - free for free, bins in enumerate(packer.by_free) for b in bins}
        assert len(open_) == packer.n_open <= k and all(used[b] == u for b, u in open_.items())
        fits = [u for u in open_.values() if u + n <= 16]
        b, at = packer.add(n)
        if fits:
            assert b in open_ and at == max(fits)
        else:
            assert b not in used and at == 0
            if len(open_) == k and n < 16:
                now = {b for bins in packer.by_free for b in bins}
                (closed,) = open_.keys() - now
                assert open_[closed] == max(open_.values())
        used[b] = at + n


def test_packer_comes_near_the_bound():
    r = random.Random(1)
    lengths = [min(2048, int(r.lognormvariate(6, 1)) + 1) for _ in range(50_000)]
    packer = Packer(2048, 4096)
    for n in lengths:
        packer.add(n)
    assert packer.n_bins <= 1.01 * math.ceil(sum(lengths) / 2048)


def test_pieces_are_whole_and_places_have_no_gaps(spark):
    enc = Encoder(tokenizer_path())
    rows = [(i, f"Text {i} " + "word soup " * (i * 37 % 900), "c") for i in range(80)]
    rows += [(100, None, "c"), (101, "", "c"), (3, "a repeated id", "c"), (None, "none", "c"), (102, "ü" * 9_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = best_fit(df, tokenizer_path(), 0, with_ids=True).collect()
    want, room = [], defaultdict(list)
    for d, t, _ in rows:
        ids = [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want.append((d, k, a, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), part))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[4])
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    for r in got:
        room[r.sequence_id].append((r.offset, r.length))
    for places in room.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048
    assert len(room) <= 1.1 * math.ceil(sum(r.length for r in got) / 2048)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert best_fit(df, tokenizer_path(), 0).collect() == []
