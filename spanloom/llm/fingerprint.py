"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame operations only.

A text's paragraphs (its lines, cut after sentences, so that an edit in a line
leaves the rest) are hashed to 64-bit digests.  Its sketch has ``3 * GROUP`` cells; each distinct digest is put into one cell of
each third.  A cell has a count, the XOR of its digests and the XOR of their
check hashes.  Subtracting two versions' sketches leaves the digests in which
they differ: a cell with count 1 or -1 and a fitting check holds one digest,
which is taken out of its other cells, and so on until all cells are empty.

If a sketch is too small for the difference, peeling stops early.  The pair
is then tried again with 4, 16, 64 ... times as many cells: its digests are
dealt by another hash to that many sketches of the same size, and of these only
the ones that failed are dealt again.  ``IN_ROW`` attempts are made where the row is;
then each open part is a row of its own, so work grows in proportion to the paragraphs and no row grows.

Likeness of two fingerprints is ``1 - d / (m + n)`` for ``d`` digests that
differ and ``m`` and ``n`` distinct paragraphs; two texts with the same
paragraphs have likeness 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

GROUP = 16
CELLS = 3 * GROUP
ROUNDS = 24
ATTEMPTS = 12
#: Attempts made within a row: with 1, 4 and 16 sketches.
IN_ROW = 3
#: A sketch with fewer empty cells isn't peeled: it holds more digests than it can give back, but for rare luck.
LEAST_EMPTY = 4
#: Odd bits of 64 from which on a part is dealt again before it is sketched: about 49 digests differ.
MOST_ODD = 25
FOUND = "array<struct<d:bigint,s:int>>"
#: Where texts are cut: at line feeds, and at the space after a mark.
CUTS = "\n| (?<=[.!?;\u2026\u3002\uff01\uff1f] )"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def paragraphs(text: Column) -> Column:
    """The lines of a text, cut after a sentence's mark and a space; null counts as empty, which is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), CUTS)


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text."""
    return F.array_distinct(F.transform(paragraphs(text), lambda p: F.xxhash64(p)))


def _hash(d: Column) -> Column:
    return F.xxhash64(d, F.lit(7))


def _check(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(0xFFFFFFFF))


def _place(hashed: Column, i: int) -> Column:
    """The cell within third ``i``, of bits that the check doesn't use."""
    return F.shiftrightunsigned(hashed, 32 + 4 * i).bitwiseAND(F.lit(GROUP - 1).cast("long")).cast("int")


def _placed(ds: Column, sign: int) -> Column:
    """Digests with their check hashes, how they count, and their cells in each third; each is hashed once."""
    hashed = F.transform(ds, lambda d: F.struct(d.alias("d"), _hash(d).alias("w")))
    return F.transform(
        hashed, lambda x: F.struct(x["d"].alias("d"), _check(x["w"]).alias("h"), F.lit(sign).alias("s"), *[_place(x["w"], i).alias(f"p{i}") for i in range(3)])
    )


def _found(ds: Column, sign: int) -> Column:
    """Digests with their check hashes, how they count, and their cells as bits of one number."""
    hashed = F.transform(ds, lambda d: F.struct(d.alias("d"), _hash(d).alias("w")))
    bit = lambda w, i: F.call_function("shiftleft", F.lit(1 << (i * GROUP)).cast("long"), _place(w, i))
    bits = lambda w: bit(w, 0).bitwiseOR(bit(w, 1)).bitwiseOR(bit(w, 2))
    return F.transform(hashed, lambda x: F.struct(x["d"].alias("d"), _check(x["w"]).alias("h"), F.lit(sign).alias("s"), bits(x["w"]).alias("m")))


def _cell(c: Column, k: Column, h: Column, m: Column) -> Column:
    return F.struct(c.alias("c"), k.alias("k"), h.alias("h"), m.alias("m"))


def _cells(items: Column) -> Column:
    """The cells of placed digests: ``array<struct<c int, k long, h long, m long>>``, ``m`` the cell's own bit.

    Digests are dealt to fours of cells first, so that each is looked at 8 times a third and not 16.
    """
    none = F.lit(0).cast("long")

    def third(i: int) -> Column:
        p = f"p{i}"
        own = lambda j: F.struct(F.lit(j).alias("j"), F.lit(1 << (i * GROUP + j)).cast("long").alias("m"))
        fours = F.array(*[F.struct(F.lit(g).alias("g"), F.array(*[own(4 * g + j) for j in range(4)]).alias("own")) for g in range(GROUP // 4)])
        put = lambda a, x: _cell(a["c"] + x["s"], a["k"].bitwiseXOR(x["d"]), a["h"].bitwiseXOR(x["h"]), a["m"])
        cell = lambda few, o: F.aggregate(F.filter(few, lambda x: x[p] == o["j"]), _cell(F.lit(0), none, none, o["m"]), put)
        four = lambda g: F.filter(items, lambda x: F.shiftright(x[p], 2) == g["g"])
        return F.flatten(F.transform(fours, lambda g: let(four(g), lambda few: F.transform(g["own"], lambda o: cell(few, o)))))

    return F.concat(*[third(i) for i in range(3)])


def sketch(ds: Column) -> Column:
    """The cells of a set of digests."""
    return let(_placed(ds, 1), _cells)


def as_text(cells: Column) -> Column:
    """A sketch as a string: cells by ``.``, each ``count:digests:checks`` in hex, empty ones empty."""
    one = lambda c: F.when(c["c"] == 0, F.lit("")).otherwise(F.concat_ws(":", F.hex(c["c"]), F.hex(c["k"]), F.hex(c["h"])))
    return F.array_join(F.transform(cells, one), ".")


def peel(cells: Column) -> Column:
    """``struct<cells, found>``: what is left but for empty cells, and the digests found, with ``s`` 1 for the first version's, -1 for the second's.

    With fewer than ``LEAST_EMPTY`` empty cells nothing is tried, as there are too many digests for the cells.
    """
    filled = lambda cs: F.filter(cs, lambda c: (c["c"] != 0) | (c["k"] != 0))

    def step(state: Column, _: Column) -> Column:
        alone = F.filter(state["cells"], lambda c: (F.abs(c["c"]) == 1) & (_check(_hash(c["k"])) == c["h"]))
        once = lambda cs, s: F.array_distinct(F.transform(F.filter(cs, lambda c: c["c"] == s), lambda c: c["k"]))
        pure = let(alone, lambda cs: F.concat(_found(once(cs, 1), 1), _found(once(cs, -1), -1)))
        # A cell is changed only by those digests that lie in it.
        out = lambda a, x: _cell(a["c"] - x["s"], a["k"].bitwiseXOR(x["d"]), a["h"].bitwiseXOR(x["h"]), a["m"])
        less = lambda c, ps: F.aggregate(ps, c, lambda a, x: F.when(x["m"].bitwiseAND(a["m"]) == 0, a).otherwise(out(a, x)))

        def without(ps: Column) -> Column:
            left = filled(F.transform(state["cells"], lambda c: less(c, ps)))
            found = F.transform(ps, lambda x: F.struct(x["d"].alias("d"), x["s"].alias("s")))
            more = F.struct(left.alias("cells"), F.concat(state["found"], found).alias("found"), F.lit(True).alias("on"))
            stop = F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(False).alias("on"))
            return F.when(F.size(ps) > 0, more).otherwise(stop)

        return F.when(state["on"], let(pure, without)).otherwise(state)

    none = F.array().cast(FOUND)
    start = lambda cs: F.struct(cs.alias("cells"), none.alias("found"), (F.size(cs) <= CELLS - LEAST_EMPTY).alias("on"))
    return let(filled(cells), lambda cs: F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start(cs), step))


def _peeled(items: Column) -> Column:
    """``struct<ok, found>`` of signed digests: their cells are the sketch of the first version less that of the second."""

    def judged(done: Column) -> Column:
        # A wrong peel would repeat a digest; then this attempt counts as failed.
        once = F.size(F.array_distinct(F.transform(done["found"], lambda x: x["d"]))) == F.size(done["found"])
        return F.struct(((F.size(done["cells"]) == 0) & once).alias("ok"), done["found"].alias("found"))

    return let(peel(_cells(items)), judged)


def _hopeless(items: Column) -> Column:
    """Whether more digests seem to differ than a sketch gives back: an odd sketch of 64 bits has ``MOST_ODD`` bits set.

    A bit tells whether an odd number of digests falls on it, so those of both versions are gone.
    """
    bit = lambda d: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(d, 58).cast("int"))
    odd = F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(bit(x["d"])))
    return F.bit_count(odd) >= MOST_ODD


def _attempt(state: Column, k: Column) -> Column:
    """Attempt ``k`` at the open parts of a pair: each is dealt to 4, but for the first, and peeled unless that is hopeless."""
    digit = lambda d: F.call_function("shiftright", d, k * 2 - 2).bitwiseAND(F.lit(3).cast("long"))
    dealt = lambda p: F.transform(F.array(*[F.lit(j).cast("long") for j in range(4)]), lambda j: F.filter(p, lambda x: digit(x["d"]) == j))
    parts = F.when(k == 0, state["open"]).otherwise(F.flatten(F.transform(state["open"], dealt)))
    none = F.struct(F.lit(False).alias("ok"), F.array().cast(FOUND).alias("found"))
    tried = F.transform(parts, lambda p: F.struct(p.alias("p"), F.when(_hopeless(p), none).otherwise(_peeled(p)).alias("t")))

    def judged(ts: Column) -> Column:
        still = F.transform(F.filter(ts, lambda t: ~t["t"]["ok"]), lambda t: t["p"])
        found = F.flatten(F.transform(F.filter(ts, lambda t: t["t"]["ok"]), lambda t: t["t"]["found"]))
        return F.struct(still.alias("open"), F.concat(state["found"], found).alias("found"))

    return let(tried, judged)


def _decoded(a: Column, b: Column, first: int, attempts: int) -> Column:
    """``struct<open, found>``: the parts that every attempt from ``first`` on failed at, and the digests found in the others."""
    whole = F.array(F.concat(_placed(a, 1), _placed(b, -1)))
    start = F.struct(whole.alias("open"), F.array().cast(FOUND).alias("found"))
    done = F.aggregate(F.sequence(F.lit(first), F.lit(first + attempts - 1)), start, _attempt)
    side = lambda p, s: F.transform(F.filter(p, lambda x: x["s"] == s), lambda x: x["d"])
    both = lambda p: F.struct(side(p, 1).alias("a"), side(p, -1).alias("b"))
    return let(done, lambda t: F.struct(F.transform(t["open"], both).alias("open"), t["found"].alias("found")))


def differences(pairs: DataFrame, keys: list[str], attempts: int = ATTEMPTS, sizes: bool = False) -> DataFrame:
    """Per pair the differing digests: ``keys`` with ``only_a`` and ``only_b``, arrays of long, or how many where ``sizes``.

    ``pairs`` has ``keys``, unique, and arrays of digests ``a`` and ``b``.
    Should every attempt at a part fail, which needs about ``4 ** attempts * GROUP``
    differing paragraphs, set difference gives the same.
    """
    counted = (lambda ds: F.size(ds).cast("long")) if sizes else (lambda ds: ds)
    side = lambda s: counted(F.transform(F.filter("done.found", lambda x: x["s"] == s), lambda x: x["d"]))
    done, rest = [], pairs.select(*keys, "a", "b")
    for first in range(0, attempts, IN_ROW):
        tried = rest.withColumn("done", _decoded(F.col("a"), F.col("b"), first, min(IN_ROW, attempts - first)))
        tried = written(tried.select(*keys, side(1).alias("only_a"), side(-1).alias("only_b"), F.col("done.open").alias("open")), "sketch-pairs")
        done.append(tried.select(*keys, "only_a", "only_b"))
        still = tried.where(F.size("open") > 0)
        if still.isEmpty():
            break
        # Each open part is a row of its own from here on.
        rest = still.select(*keys, F.explode("open").alias("p")).select(*keys, "p.a", "p.b").repartition(F.xxhash64("a", "b"))
    else:
        less = lambda x, y: counted(F.array_except(x, y))
        done.append(rest.select(*keys, less("a", "b").alias("only_a"), less("b", "a").alias("only_b")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    if len(done) == 1:
        return out
    joined = F.sum if sizes else (lambda c: F.flatten(F.collect_list(c)))
    return out.groupBy(*keys).agg(joined("only_a").alias("only_a"), joined("only_b").alias("only_b"))


def followers(docs: DataFrame, row: str, doc_id: str) -> DataFrame:
    """``row`` and ``next``: the row after it by descending id, null ids last, equal ids by row; the first after the last.

    Only ids are sorted, in ranges; between ranges a table with one row per range is used.
    """
    spark = docs.sparkSession
    order = [F.col("id").desc_nulls_last(), F.col("row")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(row).alias("row"))
    dealt = written(ids.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "ranges")
    heads = dealt.groupBy("range").agg(
        F.max_by("row", F.struct("id", -F.col("row"))).alias("head"), F.min_by("row", "row").alias("any"), F.count("id").alias("ids")
    )
    # In a range of null ids alone, any order by row holds.
    heads = heads.select("range", F.when(F.col("ids") > 0, F.col("head")).otherwise(F.col("any")).alias("head"))
    ranges = Window.orderBy("range")
    after = heads.select(
        F.col("range").alias("of"),
        F.coalesce(
            F.lead("head").over(ranges),
            F.first("head").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("after"),
    )
    within = dealt.withColumn("next", F.lead("row").over(Window.partitionBy("range").orderBy(*order)))
    return within.join(F.broadcast(after), F.col("range") == F.col("of")).select(
        F.col("row").alias(row), F.coalesce("next", "after").alias("next")
    )


def edited_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", stored: bool = False) -> DataFrame:
    """Fingerprints of every text and of its edited text, and what they are like.

    The edited text has its last ``floor(n_chars / 3)`` code points replaced by
    the first as many, or all, of the next document's.  The result has
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.  Null texts count as empty.  Repeated rows and
    equal ids are documents of their own, null ids come last; one document
    alone follows itself; an empty table gives an empty one.  Very long texts are
    hashed whole, and their differences peeled in as many sketches as they need.
    Other columns are not used.  ``stored``: ``docs`` reads files, so its rows have the same
    place each time; otherwise it is written first.
    """
    docs = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    if not stored:
        docs = written(docs, "documents")
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    sizes = docs.select("row", "id", F.length("text").cast("long").alias("n"))
    edges = written(sizes.join(followers(docs, "row", "id"), "row").withColumn("cut", F.expr("cast(n div 3 as int)")), "followers")
    # Both joins deal out the same rows of docs by row, so that is done once.
    texts = docs.select("row", "text")
    to = edges.select(F.col("row").alias("before"), F.col("next").alias("row"), "cut")
    heads = texts.join(to, "row").select(
        F.col("before").alias("row"), F.expr("substring(text, 1, cut)").alias("head"), digests(F.col("text")).alias("next_digests")
    )
    edited = F.concat(F.expr("substring(text, 1, cast(n as int) - cut)"), F.col("head"))
    base = texts.join(edges, "row").join(heads, "row").withColumn("edited", edited)
    base = written(
        base.select(
            "row", "id", "n", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("changed"), F.col("next_digests").alias("following"),
        ),
        "digests",
    )
    pair = lambda which, other: F.struct(F.lit(which).alias("which"), F.col(other).alias("b"))
    pairs = base.select("row", F.col("own").alias("a"), F.explode(F.array(pair(0, "changed"), pair(1, "following"))).alias("x"))
    pairs = pairs.select("row", "x.which", "a", "x.b")
    differ = differences(pairs, ["row", "which"], sizes=True).select("row", "which", (F.col("only_a") + F.col("only_b")).alias("d"))
    by_row = differ.groupBy("row").agg(
        F.max(F.when(F.col("which") == 0, F.col("d"))).alias("d0"), F.max(F.when(F.col("which") == 1, F.col("d"))).alias("d1")
    )
    near = lambda d, other: 1 - F.col(d) / (F.size("own") + F.size(other))
    return base.join(by_row, "row").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_chars"),
        "edited_sha256",
        as_text(sketch(F.col("own"))).alias("fingerprint"),
        as_text(sketch(F.col("changed"))).alias("edited_fingerprint"),
        near("d0", "changed").alias("near_edited"),
        near("d1", "following").alias("near_next"),
    )
