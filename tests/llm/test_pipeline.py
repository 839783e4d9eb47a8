import zlib
from collections import Counter, defaultdict

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import mixing
from spanloom.llm.common import written
from spanloom.llm.queries import MIX_KEEP, MIX_TARGETS, domain_labels, tokenizer_path
from spanloom.llm.tokens import Encoder
from tests.llm.test_near_dedup import brute as near

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stage = docs.columns, dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]

    def step(name, docs):
        out = written(stage[name](spark, docs, SF), name)
        return out, [tuple(r) for r in out.collect()]

    whole = [tuple(r) for r in docs.collect()]
    at = {c: i for i, c in enumerate(columns)}
    known, rows = step("language_id", docs)
    assert known.columns == columns and set(rows) <= set(whole)
    clean = [r for r in whole if r[at["text"]] and any(c.isalpha() for c in r[at["text"]])]
    assert len(rows) >= 0.99 * len(clean)

    keep = {}
    for r in rows:
        key = r[at["text"]].translate({ord(c): None for c in " \t\n\x0b\x0c\r"})
        best = keep.setdefault(key, r)
        keep[key] = min(best, r, key=lambda x: (-len(x[at["text"]]), x[at["doc_id"]]))
    exact, rows = step("exact_dedup", known)
    assert exact.columns == columns and sorted(rows) == sorted(keep.values())

    want = {d for d, _, _, kept in near([(r[at["doc_id"]], r[at["text"]]) for r in rows]) if kept}
    far, got = step("near_dedup", exact)
    assert far.columns == columns and sorted(got) == sorted(r for r in rows if r[at["doc_id"]] in want)

    mixed, rows = step("mixing", far)
    assert mixed.columns == columns and set(rows) <= set(got)
    labels = domain_labels(spark.read.parquet(f"{SF}/labels.parquet"))
    copies = {r.doc_id: r for r in mixing.mix(far, labels, MIX_TARGETS, MIX_KEEP, stored=True).collect()}
    assert Counter(r[at["doc_id"]] for r in rows) == Counter({d: r.copies for d, r in copies.items() if r.copies})
    assert all(1 <= r.copies <= mixing.MOST for r in copies.values() if r.domain in MIX_KEEP)
    lost = {d for d, r in copies.items() if not r.copies}
    assert all(copies[d].domain == "toxic" for d in lost) and len(lost) < 0.12 * len(got)

    _, pieces = step("packing", mixed)
    enc, want = Encoder(tokenizer_path()), Counter()
    for r in rows:
        ids = [*enc.tokenizer.encode(r[at["text"]], add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want[r[at["doc_id"]], k, a, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert Counter(p[:5] for p in pieces) == want
    room = defaultdict(list)
    for p in pieces:
        room[p[5]].append((p[6], p[3]))
    for places in room.values():
        assert all(o == sum(n for _, n in sorted(places)[:i]) for i, (o, _) in enumerate(sorted(places)))
        assert sum(n for _, n in places) <= 2048


EDGES = [
    (1, "the cat and the dog of the house " * 3, "en", "a", 10), (2, "the cat and the dog of the house " * 3 + " ", "en", "b", 10),
    (2, None, "en", "a", 0), (None, None, None, None, None), (3, "", "de", "a", 0), (4, "12 34", None, "a", 5),
    (5, "one word and the other of the " * 40_000, "en", "a", 9), (5, "one word and the other of the " * 40_000, "en", "a", 9),
    (None, "und der hund mit dem haus und der katze " * 2, "de", None, None), (6, "a", "en", "c", 1),
]


def test_stages_take_edge_cases_and_any_column_names(spark, tmp_path):
    names = ["score", "kept", "rate", "p", "domain", "copies", "n_tokens", "row", "times", "rejected", "lang_pred", "keep_id", "got", "v", "node"]
    docs = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string, n_chars long")
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(-i))
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 1), (6, None, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for whole in (docs, docs.limit(0)):
        now = written(whole, "edges")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = written(stage(spark, now, str(tmp_path)), name)
            assert out.columns == docs.columns, name
            rows = [tuple(r) for r in out.collect()]
            assert all(r[5:] == tuple(-i for i in range(len(names))) for r in rows)
            assert {r[:5] for r in rows} <= {tuple(r)[:5] for r in now.collect()}
            if whole is not docs:
                assert rows == []
            elif name == "language_id":  # null and letterless texts go, repeated rows stay
                assert sorted(str(r[0]) for r in rows) == ["1", "2", "5", "5", "6", "None"]
            elif name == "exact_dedup":
                assert sorted(str(r[0]) for r in rows) == ["2", "5", "6", "None"]
            elif name == "near_dedup":
                assert sorted(str(r[0]) for r in rows) == ["2", "5", "6", "None"]
            now = out
        pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert (pieces.count() > 0) == (whole is docs)


def test_run_is_the_stages_in_turn(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 100
