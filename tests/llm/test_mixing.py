import random
import warnings

import numpy as np
import pytest
from pyspark.sql import Row

from spanloom.llm import mixing
from spanloom.llm.mixing import MOST, fit, mix, rates, resampled, totals
from spanloom.llm.queries import MIX_KEEP, MIX_TARGETS, domain_labels, op2_mixing

DOMAINS = ["a", "b", "c"]


def corpus(spark, n=600):
    r = random.Random(2)
    own = {"a": "apple acorn ash".split(), "b": "bear bee bird".split(), "c": []}
    rows = []
    for i in range(n):
        d = r.choice("aaaaabbbcc")
        words = [f"w{r.randrange(300)}" for _ in range(r.randrange(20, 60))]
        rows.append((i, " ".join(words + r.sample(own[d], min(2, len(own[d])))), d, 1.5))
    docs = spark.createDataFrame([(i, t, x) for i, t, _, x in rows], "doc_id long, text string, s double")
    labels = spark.createDataFrame([(i, d) for i, _, d, _ in rows if i % 2], "doc_id long, domain string")
    return docs, labels, {i: d for i, _, d, _ in rows}


def test_totals_meet_targets_and_classes_are_found(spark):
    docs, labels, truth = corpus(spark)
    want = {"a": 0.3, "b": 0.3, "c": 0.4}
    got = mix(docs, labels, want).collect()
    assert len(got) == 600 and np.mean([r.domain == truth[r.doc_id] for r in got]) > 0.97
    n = sum(r.n_tokens for r in got)
    for k, d in enumerate(want):
        assert sum(r.n_tokens * r.rate * r.p[k] for r in got) / n == pytest.approx(want[d], abs=2e-3)
        assert sum(r.n_tokens * r.copies for r in got if truth[r.doc_id] == d) / n == pytest.approx(want[d], abs=0.06)
    assert all(r.n_tokens == len(r.text.split()) and r.rate >= 0 and int(r.rate) <= r.copies <= int(r.rate) + 1 for r in got)


def test_kept_domains_do_not_shrink(spark):
    docs, labels, truth = corpus(spark)
    mixed = mix(docs, labels, {"a": 0.5, "b": 0.49, "c": 0.01}, keep=("a", "b"))
    rows = mixed.collect()
    assert all(r.copies >= 1 for r in rows if r.domain in "ab") and sum(r.copies for r in rows if r.domain == "c") < 60
    out = resampled(docs, labels, {"a": 0.5, "b": 0.49, "c": 0.01}, keep=("a", "b"))
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)


def test_no_document_is_taken_too_often(spark):
    docs, labels, truth = corpus(spark)
    with pytest.warns(UserWarning, match="out of reach"):
        rows = mix(docs, labels, {"a": 0.01, "b": 0.98, "c": 0.01}, most=2).collect()
    assert max(r.copies for r in rows) == 2 and all(r.rate <= 2 for r in rows)
    optimal(rows, ["a", "b", "c"], {"a": 0.01, "b": 0.98, "c": 0.01}, (), 2)


def optimal(rows, domains, targets, keep, most):
    """What tells the least squares under bounds: no document's gradient points into them."""
    n = np.array([r.n_tokens for r in rows], dtype=float)
    p = np.array([r.p for r in rows])
    x = np.array([r.rate for r in rows])
    own, weight = n @ p, np.array([targets[d] for d in domains]) / sum(targets.values())
    budget = max([n.sum(), *[1.01 * o / w for d, o, w in zip(domains, own, weight, strict=True) if d in keep]])
    off = ((n * x) @ p - weight * budget) / n.sum()
    low = np.array([float(domains[int(q.argmax())] in keep) for q in p])
    slope = p @ off
    used = n > 0
    assert (x >= low - 1e-9).all() and (x <= most + 1e-9).all()
    assert (slope[used & (x < most - 1e-6)] >= -1e-5).all() and (slope[used & (x > low + 1e-6)] <= 1e-5).all()
    return off


def test_the_query_is_at_its_optimum(spark):
    """Clean documents stay whole, so the likely toxic share of texts without evidence stays, too: 1 % is out of reach."""
    rows = [Row(p=[r.p_good, r.p_plain, r.p_toxic], **r.asDict()) for r in op2_mixing(spark, "/root/testdata/sf0.01").collect()]
    off = optimal(rows, list(MIX_TARGETS), MIX_TARGETS, MIX_KEEP, MOST)
    assert abs(off[:2]).max() < 0.05 and 0 < off[2] < 0.04


def test_targets_in_reach_are_met_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = domain_labels(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    for targets, keep in (({"good": 0.84, "plain": 0.13, "toxic": 0.03}, ()), ({"good": 0.7, "plain": 0.1, "toxic": 0.2}, ())):
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            got = mix(docs, labels, targets, keep, stored=True, with_columns=False)
        rows = got.collect()
        off = optimal(rows, list(targets), targets, keep, MOST)
        assert abs(off).max() < 1e-3
        told = {r.domain: r for r in totals(got, targets).collect()}
        n = sum(r.n_tokens for r in rows)
        assert all(told[d].expected / n == pytest.approx(w, abs=1e-3) for d, w in targets.items())
        assert all(told[d].copied == pytest.approx(told[d].expected, rel=0.2, abs=0.01 * n) for d in targets)


def test_least_squares_equals_a_dense_solver(spark):
    r = np.random.RandomState(0)
    p = r.dirichlet([0.5] * 3, 12)
    n = r.randint(100, 1000, 12)
    groups = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(12)], "signature int, n long, p array<double>")
    target = (n @ p * [1.3, 0.9, 0.8]).tolist()
    x = np.array([g.rate for g in rates(groups, target).orderBy("signature").collect()])
    assert (x >= 0).all() and np.abs((n * x) @ p - target).max() / n.sum() < 1e-3
    # A target out of reach: the residual's gradient must not point inwards.
    p2 = np.array([[0.9, 0.1, 0.0]] * 2 + [[0.5, 0.5, 0.0]])
    groups = spark.createDataFrame([(i, 100, p2[i].tolist()) for i in range(3)], "signature int, n long, p array<double>")
    x = np.array([g.rate for g in rates(groups, [0.0, 300.0, 0.0]).orderBy("signature").collect()])
    slope = p2 @ ((100 * x) @ p2 - np.array([0.0, 300.0, 0.0])) / 300
    assert (x >= 0).all() and (np.abs(slope[x > 1e-6]) < 0.02).all() and (slope > -0.02).all()


def test_the_fit_ends_at_the_optimum_and_tells_what_is_left(spark):
    # Nearly alike posteriors and a distant target: many rounds of any first-order method.
    p = np.array([[0.60, 0.30, 0.10], [0.58, 0.30, 0.12], [0.60, 0.28, 0.12], [0.10, 0.10, 0.80]])
    n = np.array([1000, 10, 10, 1000])
    groups = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(4)], "signature int, n long, p array<double>")
    target = (n * [0.9, 6.0, 4.0, 0.01]) @ p
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        x = np.array([g.rate for g in rates(groups, target.tolist()).orderBy("signature").collect()])
    assert (x >= 0).all() and np.abs((n * x) @ p - target).max() / n.sum() <= 1e-4
    with pytest.warns(UserWarning, match="out of reach"):
        rates(groups, [0.0, 2020.0, 0.0])


def test_no_clean_document_is_lost_and_posteriors_are_of_documents(spark):
    got = op2_mixing(spark, "/root/testdata/sf0.01").collect()
    clean = [r for r in got if r.domain in MIX_KEEP]
    assert len(clean) > 800 and all(r.rate >= 1 and r.copies >= 1 for r in clean)
    assert len({(r.p_good, r.p_plain, r.p_toxic) for r in got}) > 27


def test_nulls_repeats_no_labels_and_empty(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "apple", 1), (3, "x " * 100_000, 1), (3, "x " * 100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    none = spark.createDataFrame([], "doc_id long, domain string")
    got = mix(docs, none, {"a": 1, "b": 1}).collect()
    assert len(got) == 5 and sorted(r.n_tokens for r in got) == [0, 0, 1, 100_000, 100_000]
    assert all(list(r.p) == [0.5, 0.5] and r.rate == pytest.approx(1, abs=1e-3) and r.row == 1 for r in got)
    labels = spark.createDataFrame([(1, "a"), (1, "b"), (7, "a"), (None, "a"), (2, None)], "doc_id long, domain string")
    assert len(mix(docs, labels, {"a": 1, "b": 1}).collect()) == 5
    assert mix(docs.limit(0), labels, {"a": 1, "b": 1}).collect() == []
    assert len(fit(docs, none, DOMAINS).prior) == 3


def test_evidence_in_the_row_and_joined_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    labels = domain_labels(spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    targets = {"good": 0.8, "plain": 0.12, "toxic": 0.08}
    found = []
    for most in (mixing.IN_ROW, 0):
        monkeypatch.setattr(mixing, "IN_ROW", most)
        got = mix(docs, labels, targets, stored=True)
        found.append(sorted((r.doc_id, r.n_tokens, *[round(x, 7) for x in r.p], r.domain, round(r.rate, 5)) for r in got.collect()))
        assert got.columns == [*docs.columns, *mixing.ADDED]
    assert found[0] == found[1] and len({r[2] for r in found[0]}) > 3
