"""Mixing documents to target weights of domains by soft membership, in DataFrame operations only.

1. Classifier.  A table of labelled documents gives, for each hashed token, the
   share of each domain's documents that have it.  Tokens that are more
   frequent in one domain than in the rest beyond doubt (a z-score of ``Z``)
   and by a factor of ``LIFT`` are evidence for it, of weight log of the factor.
   A document's posterior of the domains, found within its row, is a multinomial logistic regression,
   fitted to the labelled documents, on its own sums of evidence (as they are, by
   their logarithms and up to ``STRONG``).  ``fit_rows`` bounds the labelled rows
   used; there are at most ``BUCKETS`` weights.
2. Totals.  Tokens of all documents are summed by posterior.
3. Rates.  With tokens ``n_i`` and posterior ``p_i``, rates ``x_i`` minimise the squared
   distance of ``sum(n_i * x_i * p_i)`` to the target totals by projected gradients.
   A round is one aggregate over all documents: the residual of the totals at the
   present rates, and the Gram matrix of the posteriors of documents not at a bound.
   The gradient at a document is the residual along its posterior; scaled by that
   matrix' inverse it is the round's step, and a document's rate is 1 less all steps
   so far, projected to its bounds.  So the rates are fixed by one number per domain,
   which the driver holds, no document has a state of its own, and of all rates that
   minimise the distance these are nearest to 1 (in the metric ``n_i``).  A step that
   doesn't help is halved; rounds end where the gradient is 0 but for rounding.
   Bounds are ``most``, and below 1 where a kept domain is likeliest, so that such a
   document is never lost, and else 0.  Targets out of reach of these bounds are met
   as nearly as can be, with a warning that gives what is left (see ``totals``, too).
4. A document is taken ``floor(rate)`` times, and once more if a hash of it,
   uniform on [0, 1), is under the fraction left: so ``most`` times at most.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, drop, fresh, written

BUCKETS = 1 << 16
FIT_ROWS = 20_000
Z = 5.0
#: Evidence must be so many times as frequent as in the rest, so that a language's common words are none.
LIFT = 4.0
#: And be in this share of the domain's labelled documents, so that words of a few copied documents are none.
LEAST_SHARE = 0.02
#: The regression has each sum of evidence up to here as a term, too.
STRONG = 4.0
#: So many tokens of evidence are looked up within a document's row.
IN_ROW = 4096
#: No document is taken more often.
MOST = 4
#: Totals may be off by so much of all tokens without a warning.
TOLERANCE = 1e-4
#: Weight of the steps' square, so that their matrix has an inverse: totals stay off by it times the steps.
RIDGE = 1e-8
#: The slope at which the fit ends.
SLOPE = 1e-8


def tokens(text: Column) -> Column:
    """Lower-cased words and runs of other signs; white space only parts them."""
    apart = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"([^\p{L}\p{N}\s]+)", " $1 ")
    for b in BLANKS[1:]:
        apart = F.replace(apart, F.lit(b), F.lit(" "))
    return F.array_remove(F.split(apart, " "), "")


def hashed(ts: Column) -> Column:
    """The buckets of a text's tokens, each once."""
    return F.array_distinct(F.transform(ts, lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int")))


def with_buckets(docs: DataFrame, text: str, n: str, buckets: str) -> DataFrame:
    """``docs`` with its number of tokens and their distinct buckets, of which one more says how often tokens repeat: the whole log2 of the mean."""
    ts, own = fresh([*docs.columns, n, buckets], "ts"), fresh([*docs.columns, n, buckets], "own")
    rows = docs.withColumn(ts, tokens(F.col(f"`{text}`"))).withColumn(own, hashed(F.col(ts)))
    times = F.floor(F.log2(F.size(ts) / F.greatest(F.size(own), F.lit(1)) + 1e-9))
    sign = F.lit(BUCKETS) + F.coalesce(times, F.lit(0)).cast("int")
    return rows.withColumns({n: F.size(ts).cast("long"), buckets: F.concat(own, F.array(sign))}).drop(ts, own)


def _constant(values: list, kind: str) -> Column:
    """A constant array, written as one text, so that a plan stays small."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


@dataclass
class Classifier:
    """``weights``: ``bucket`` and a weight per domain (``w0`` ...); ``terms``: of the regression, by term and domain."""

    domains: list[str]
    weights: DataFrame
    terms: np.ndarray | None
    prior: list[float]

    def posterior(self, s: Column) -> Column:
        """Array of the domains' chances from the array of sums; the prior if nothing was labelled."""
        k = len(self.domains)
        if self.terms is None:
            return F.lit(self.prior).cast("array<double>")
        at = [F.get(s, F.lit(i)) for i in range(k)]
        on = [F.lit(1.0), *at, *[F.log1p(x) for x in at], *[F.least(x, F.lit(STRONG)) for x in at]]
        z = F.array(*[sum((F.lit(float(c)) * x for c, x in zip(self.terms[:, d], on, strict=True)), F.lit(0.0)) for d in range(k)])
        e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))

    def with_posterior(self, docs: DataFrame, text: str, n: str, p: str) -> DataFrame:
        """``docs`` with number of tokens and posterior of each document, in the row; ``docs`` reads files.

        With over ``IN_ROW`` tokens of evidence, which would be looked through for each document, tokens are joined.
        """
        b, s = fresh([*docs.columns, n, p], "b"), fresh([*docs.columns, n, p], "s")
        ws = [f"w{i}" for i in range(len(self.domains))]
        rows = self.weights.limit(IN_ROW + 1).collect()
        if len(rows) <= IN_ROW:
            rows.sort(key=lambda r: r["bucket"])
            known = _constant([r["bucket"] for r in rows], "int") if rows else F.array().cast("array<int>")
            held = with_buckets(docs, text, n, b).withColumn(b, F.array_intersect(b, known))

            def total(w: str) -> Column:
                """The weights of a document's evidence, in the order of its buckets."""
                of = _constant([r[w] for r in rows], "double") if rows else F.array().cast("array<double>")
                return F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(of, F.array_position(known, x).cast("int") - 1))

            sums = [F.round(total(w), 9) for w in ws]
            return held.withColumn(s, F.array(*sums)).withColumn(p, self.posterior(F.col(s))).drop(b, s)
        row = fresh([*docs.columns, n, p, b, s], "row")
        docs = docs.withColumn(row, F.monotonically_increasing_id())
        each = with_buckets(docs.select(row, F.col(f"`{text}`").alias(text)), text, n, b).select(row, n, F.explode_outer(b).alias("bucket"))
        sums = each.join(F.broadcast(self.weights), "bucket", "left").groupBy(row).agg(F.max(n).alias(n), F.array(*[_sum(w) for w in ws]).alias(s))
        return docs.join(sums.select(row, n, self.posterior(F.col(s)).alias(p)), row).drop(row)


def _sum(w: str) -> Column:
    """Rounded, so that the order of rows doesn't show."""
    return F.round(F.coalesce(F.sum(w), F.lit(0.0)), 9)


def regression(s: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Multinomial logistic regression with ridge 1 by damped Newton steps; ``own`` has 1 at each row's domain."""
    x = np.hstack([np.ones((len(s), 1)), s, np.log1p(s), np.minimum(s, STRONG)])
    d, k = x.shape[1], own.shape[1]

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ w
        z -= z.max(axis=1, keepdims=True)
        log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return float(-(own * log_p).sum() + (w * w).sum() / 2), np.exp(log_p)

    w = np.zeros((d, k))
    now, p = value(w)
    while True:
        slope = x.T @ (p - own) + w
        bend = np.eye(d * k).reshape(d, k, d, k)
        for a in range(k):
            for b in range(k):
                bend[:, a, :, b] += (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
        move, part = np.linalg.solve(bend.reshape(d * k, d * k), slope.ravel()).reshape(d, k), 1.0
        gain = float((move * slope).sum())
        if gain < 1e-9:
            return w
        while (then := value(w - part * move))[0] > now - 1e-4 * part * gain:
            part /= 2
            if part < 1e-9:
                return w
        w, (now, p) = w - part * move, then


def fit(
    docs: DataFrame, labels: DataFrame, domains: list[str], text: str = "text", doc_id: str = "doc_id", fit_rows: int = FIT_ROWS,
    scratch: list[str] | None = None,
) -> Classifier:
    """A classifier from ``labels`` (``doc_id, domain``): of an id with several, the last by name; others are left out.

    About ``fit_rows`` labelled ids, picked by a hash, are used, and broadcast.
    ``scratch``: see ``written``; the classifier reads one of the tables.
    """
    labels = labels.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("domain").alias("domain"))
    share = min(1.0, fit_rows / max(1, labels.count()))
    picked = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)) < share * 1_000_003)
    known = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(picked), "doc_id")
    known = with_buckets(known, "text", "n", "buckets").select("domain", F.sort_array("buckets").alias("buckets"))
    known = written(known.withColumn("as", F.xxhash64("buckets")).dropDuplicates(["as", "domain"]).drop("as"), "labelled", scratch)
    n = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    total = sum(n.values())
    counts = known.select("domain", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(
        *[F.count(F.when(F.col("domain") == d, 1)).alias(f"c{i}") for i, d in enumerate(domains)]
    )
    every = sum((F.col(f"c{i}") for i in range(len(domains))), F.lit(0))
    weights = []
    for i, d in enumerate(domains):
        n1, n2 = n.get(d, 0), total - n.get(d, 0)
        c1, c2 = F.col(f"c{i}"), every - F.col(f"c{i}")
        if n1 and n2:
            p = (c1 + c2) / total
            z = (c1 / n1 - c2 / n2) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n1 + 1 / n2))
            w = F.log((c1 + 0.5) / (n1 + 1)) - F.log((c2 + 0.5) / (n2 + 1))
            w = F.when((z >= Z) & (c1 >= LEAST_SHARE * n1) & (w >= float(np.log(LIFT))), w).otherwise(0.0)
        else:
            w = F.lit(0.0)
        weights.append(F.greatest(w, F.lit(0.0)).alias(f"w{i}"))
    weights = counts.select("bucket", *weights).where(" or ".join(f"w{i} > 0" for i in range(len(domains))))
    made = Classifier(domains, written(weights, "evidence", scratch), None, [(n.get(d, 0) + 1) / (total + len(domains)) for d in domains])
    rows = known.withColumn("row", F.monotonically_increasing_id()).select("row", "domain", F.explode_outer("buckets").alias("bucket"))
    sums = rows.join(F.broadcast(made.weights), "bucket", "left").groupBy("row", "domain").agg(
        *[_sum(f"w{i}").alias(f"s{i}") for i in range(len(domains))]
    )
    seen = sums.drop("row").collect()  # about ``fit_rows`` at most
    if seen:
        s = np.array([r[1:] for r in seen], dtype=float)
        made.terms = regression(s, np.array([[float(r["domain"] == d) for d in domains] for r in seen]))
    return made


def rates(groups: DataFrame, target: list[float], floor: Column | None = None, most: float = float("inf")) -> DataFrame:
    """``groups`` (``n, p`` and others) with ``rate``: least squares with rates from ``floor`` (default 0) to ``most``.

    ``target`` has token totals.  Targets out of reach are met as nearly as can
    be; if a total is off by over ``TOLERANCE`` of all tokens, a warning gives all.
    """
    floor = F.lit(0.0) if floor is None else floor
    return groups.withColumn("rate", rate(steps(groups, target, floor, most), floor, most))


def _along(at: list[float], p: str = "p") -> Column:
    return sum((F.lit(float(x)) * F.col(p)[i] for i, x in enumerate(at)), F.lit(0.0))


def rate(at: list[float], floor: Column, most: float, p: str = "p") -> Column:
    """``1 - at . p``, projected to the bounds."""
    return F.least(F.greatest(floor, F.lit(1.0) - _along(at, p)), F.lit(float(most)))


def steps(groups: DataFrame, target: list[float], floor: Column, most: float) -> list[float]:
    """The sum ``at`` of all projected-gradient steps: ``rate`` of it is the fit.

    A step's worth is measured by the Lagrangian at the rates it gives, which is
    concave in ``at``, strictly with ``RIDGE``, so that there is one place to end.
    """
    k = len(target)
    total = float(groups.agg(F.sum("n")).first()[0] or 0)
    if not total:
        return [0.0] * k
    goal = np.array(target, dtype=float) / total

    def round_(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Lagrangian, slope, Gram matrix of what is between the bounds, and how far each total is off."""
        p = [F.col("p")[i] for i in range(k)]
        x, dot = rate(at.tolist(), floor, most), _along(at.tolist())
        free = F.when((1 - dot > floor) & (1 - dot < most), F.col("n")).otherwise(F.lit(0))
        sums = [F.sum(F.col("n") * ((x - 1) * (x - 1) / 2 + x * dot)), *[F.sum(F.col("n") * x * q) for q in p]]
        got = groups.agg(*sums, *[F.sum(free * a * b) for a in p for b in p]).first()
        got = np.array(got, dtype=float) / total
        off = got[1 : k + 1] - goal
        return got[0] - at @ goal - RIDGE / 2 * at @ at, off - RIDGE * at, got[k + 1 :].reshape(k, k) + RIDGE * np.eye(k), off

    at = np.zeros(k)
    now = round_(at)
    while np.abs(now[1]).max() > SLOPE:
        move, part = np.linalg.solve(now[2], now[1]), 1.0
        while (then := round_(at + part * move))[0] < now[0] + 1e-4 * part * (now[1] @ move) and part > 1e-9:
            part /= 2
        if then[0] <= now[0] and np.abs(then[1]).max() >= np.abs(now[1]).max():
            break  # rounding hides any gain
        at, now = at + part * move, then
    if np.abs(now[3]).max() > TOLERANCE:
        warnings.warn(f"targets out of reach; totals are off by {now[3].round(6).tolist()} of all tokens", stacklevel=2)
    return at.tolist()


ADDED = ["n_tokens", "p", "domain", "rate", "copies"]


def _decided(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float], keep: tuple[str, ...], text: str, doc_id: str, fit_rows: int, most: float,
    without_text: bool = False,
) -> tuple[DataFrame, list[str]]:
    """``docs``, which reads files, with what is ``ADDED``, and the names under which, which no column of ``docs`` has.

    Texts are read twice, for the totals and for the rates, but never move; ``without_text``,
    they are read once, and ids and posteriors are written between.
    """
    if most < 1:
        raise ValueError("most must be 1 at least")
    domains, scratch, names = list(targets), [], []
    for c in ADDED:
        names.append(fresh([*docs.columns, *names], c))
    n, p, domain, x, copies = names
    model = fit(docs, labels, domains, text, doc_id, fit_rows, scratch)
    signed = model.with_posterior(docs, text, n, p)
    if without_text:
        signed = written(signed.drop(text) if text != doc_id else signed, "posteriors")
    groups = written(signed.groupBy(F.col(p).alias("p")).agg(F.sum(n).alias("n")), "posterior-groups", scratch)
    own = groups.agg(*[F.coalesce(F.sum(F.col("n") * F.col("p")[i]), F.lit(0.0)) for i in range(len(domains))]).first()
    weight = {d: w / sum(targets.values()) for d, w in targets.items()}
    budget = max([sum(own), *[1.01 * t / weight[d] for d, t in zip(domains, own, strict=True) if d in keep]])
    likeliest = lambda c: F.lit(domains)[F.array_position(c, F.array_max(c)).cast("int") - 1]
    floor = lambda c: F.when(likeliest(c).isin(*keep), F.lit(1.0)).otherwise(F.lit(0.0))
    at = steps(groups, [weight[d] * budget for d in domains], floor("p"), most)
    drop(docs.sparkSession, [t for t in scratch if "/evidence-" not in t])
    got = signed.withColumn(domain, likeliest(p)).withColumn(x, rate(at, floor(p), most, p))
    chance = F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.col(n), F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return got.withColumn(copies, (F.floor(x) + (chance < F.col(x) - F.floor(x)).cast("long")).cast("long")), names


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float],
    keep: tuple[str, ...] = (),
    text: str = "text",
    doc_id: str = "doc_id",
    fit_rows: int = FIT_ROWS,
    most: float = MOST,
    stored: bool = False,
    with_columns: bool = True,
) -> DataFrame:
    """Every document with its posterior, rate and number of copies.

    ``labels`` has ``doc_id, domain``; ``targets`` has weights by domain, which
    are divided by their sum.  The mixture has as many tokens as the input has,
    or, if that is more, as are needed so that no domain in ``keep`` shrinks
    (with 1 % to spare).  A document whose likeliest domain is in ``keep`` is taken
    once at least, and none over ``most`` times, even where that puts the targets out
    of reach.  Added: ``n_tokens`` long, ``p`` array of double (as
    ``targets`` is ordered), ``domain`` (the likeliest), ``rate`` double and
    ``copies`` long; input columns of those names are replaced.  With
    ``with_columns=False`` of the input only the id is returned, as ``doc_id``,
    and no text shuffles.  Null and empty texts have no tokens and no evidence;
    very long texts are cut into tokens whole; repeated rows are rows of their own
    with the same rate; without labelled
    rows all posteriors are alike; an empty table gives an empty one.
    ``stored``: ``docs`` reads files, so that its rows have the same place each time.
    """
    if text in ADDED or doc_id in ADDED:
        raise ValueError(f"the text and id columns may not be named as one of {ADDED}")
    docs = docs.drop(*ADDED)
    if not stored:
        docs = written(docs, "documents")
    if not with_columns:
        docs = docs.select(*dict.fromkeys([doc_id, text]))
    got, names = _decided(docs, labels, targets, keep, text, doc_id, fit_rows, most, without_text=not with_columns)
    columns = [F.col(f"`{c}`") for c in docs.columns] if with_columns else [F.col(f"`{doc_id}`").alias("doc_id")]
    return got.select(*columns, *[F.col(n).alias(a) for n, a in zip(names, ADDED, strict=True)])


def resampled(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float], keep: tuple[str, ...] = (), text: str = "text", doc_id: str = "doc_id",
    fit_rows: int = FIT_ROWS, most: float = MOST, stored: bool = False,
) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it, with all its columns, whatever their names, and no others."""
    if not stored:
        docs = written(docs, "documents")
    got, names = _decided(docs, labels, targets, keep, text, doc_id, fit_rows, most)
    copies = F.col(names[-1])
    times = F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<long>"))
    return got.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(times).alias(names[-1])).drop(names[-1])


def totals(mixed: DataFrame, targets: dict[str, float]) -> DataFrame:
    """``domain, input, expected, copied``: of ``mix``'s documents the tokens by posterior as they are, at their rates, and as copied."""
    sums = lambda w, i: F.sum(F.col("n_tokens") * w * F.col("p")[i])
    each = [
        F.struct(F.lit(d).alias("domain"), *[sums(w, i).alias(n) for n, w in (("input", F.lit(1)), ("expected", F.col("rate")), ("copied", F.col("copies")))])
        for i, d in enumerate(targets)
    ]
    return mixed.agg(F.array(*each).alias("x")).select(F.inline("x"))
