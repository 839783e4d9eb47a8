"""Near duplicates by a chosen-path set similarity join.

1. Every whole text becomes its set of five-word shingles, ``COORDS`` minwise
   tokens (least values under as many hashes) and an odd sketch.  Documents of
   equal sets are one vertex from here on.
2. Trees.  The root of each of ``TREES`` independent trees branches documents by
   their minwise token at a coordinate of its own; a node below picks by a hash of
   its path a coordinate, and every second node another one.  A pair at the
   threshold of 3/4 so stays together along 9/8 paths a level.  Nodes of one
   document end, and of nodes with the same documents one is kept.
3. Nodes of at most ``BLOCK`` documents are compared exhaustively, larger ones of
   the first level in random parts of that size.  Likely pairs are confirmed on
   full sets, and links join documents to components.
4. Larger nodes whose documents are in several components by then are compared
   exhaustively, too, by pairs of blocks, so that no task needs more than two
   blocks of a node at once; but those of over ``LEAF`` documents branch on first,
   to ``DEPTH`` at most.  Only pairs of different components count: other links
   change nothing.

Comparison within a node is by odd sketches (see ``node_pairs``), which give few
pairs besides the links, so only about as many pairs as documents are confirmed.
Of links beyond doubt by the sketch a spanning forest is confirmed; if ever one of
its pairs is no link, the comparison is repeated without that shortcut.

Nodes of at most ``LEAF`` documents are compared in the first ``SMALL_TREES`` trees
alone: where a pair's nodes are small, these miss it at the threshold with a chance of
``0.25 ** SMALL_TREES``, one in 17 million.  Where its nodes are larger, and mixed,
down to ``DEPTH``, all trees miss 1 pair in 20,000 (simulated on 40,000).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, fresh, join_groups, written
from .components import components
from .node_pairs import node_pairs
from .shingles import minwise, odd_sketches, shingle_sets

COORDS = 96
TREES = 24
SMALL_TREES = 12
BLOCK = 2048
LEAF = 4 * BLOCK
DEPTH = 6
PAIRS_PER_SALT = 5_000


def signed(docs: DataFrame) -> DataFrame:
    """``row, doc_id, n_shingles, set_id, sig, sketch`` from ``row, doc_id, text``; the last three are null for empty sets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(part.column(2).to_pylist())
                sig = iter(minwise(sets, COORDS).view(np.int32))
                sketch = iter(odd_sketches(sets))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(sig) if len(s) else None for s in sets], pa.list_(pa.int32())),
                        pa.array([next(sketch) if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["row", "doc_id", "n_shingles", "set_id", "sig", "sketch"],
                )

    return docs.mapInArrow(rows, "row long, doc_id long, n_shingles long, set_id binary, sig array<int>, sketch binary")


def _roots(sig: Column, trees: int) -> Column:
    """A document's nodes on the first level, one for each tree."""
    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(t, F.get(sig, t)))


def _branches(node: Column, sig: Column) -> Column:
    """The nodes to which a document goes from ``node``."""
    pick = lambda i: F.pmod(F.xxhash64(node, F.lit(i)), F.lit(COORDS)).cast("int")
    to = lambda i: F.xxhash64(node, pick(i), F.get(sig, pick(i)))
    second = (F.pmod(F.xxhash64(node, F.lit(0)), F.lit(2)) == 0) & (pick(1) != pick(2))
    return F.when(second, F.array(to(1), to(2))).otherwise(F.array(to(1)))


def _met(at: DataFrame, total: int, block: int, leaf: int, scratch: list[str]) -> DataFrame:
    """``v, node, n`` (and ``comp``, if given) of documents that aren't alone in their node.

    Of nodes with the same documents one is kept, unless they are large: those may
    branch, each in its way.  With ``tree``, nodes of at most ``leaf`` documents of trees
    from ``SMALL_TREES`` on are left out; with ``comp``, nodes all of whose documents are
    in one component end here.
    """
    known, first = "comp" in at.columns, "tree" in at.columns
    apart = [F.min("comp").alias("c1"), F.max("comp").alias("c2")] if known else []
    same = [F.bit_xor(F.xxhash64("v", F.lit(i))).alias(f"h{i}") for i in (1, 2)]
    tree = [F.min("tree").alias("tree")] if first else []
    sizes = at.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *same, *apart, *tree).where("n > 1")
    sizes = sizes.where((F.col("tree") < SMALL_TREES) | (F.col("n") > leaf)) if first else sizes
    sizes = sizes.where("c1 <> c2") if known else sizes
    one = sizes.groupBy("n", "h1", "h2", F.when(F.col("n") > block, F.col("node")).alias("large")).agg(F.min("node").alias("node"))
    sizes = written(one.select("node", "n"), "node-sizes", scratch)
    return written(join_groups(at.drop("tree"), sizes, "node", "n", total), "node-members", scratch)


def _with_comp(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, "v", "left").withColumn("comp", F.coalesce("comp", "v"))


def _by_blocks(met: DataFrame, block: int) -> DataFrame:
    """``v, key, comp``: a document goes to the pairs of its block with every block of its node."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("v", "node"), blocks).cast("int")
    rows = met.select("v", "node", "n", "comp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    # A block with itself is in its pairs with others.
    rows = rows.where((F.col("own") != F.col("other")) | (F.col("n") <= block))
    key = F.when(F.col("own") == F.col("other"), F.col("node")).otherwise(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")))
    return rows.select("v", key.alias("key"), "comp")


def _deeper(met: DataFrame, reps: DataFrame, comps: DataFrame, block: int, leaf: int, depth: int, scratch: list[str]) -> DataFrame:
    """``v, key, comp``: what is left to compare in and below the larger nodes of the first level."""
    at = written(_with_comp(met.where(F.col("n") > block).select("v", "node"), comps), "nodes", scratch)
    met, ends = _met(at, at.count(), block, leaf, scratch), []
    for _ in range(1, depth):
        ends.append(_by_blocks(met.where(F.col("n") <= leaf), block))
        met = met.where(F.col("n") > leaf)
        if met.isEmpty():
            break
        at = met.select("v", "node", "comp").join(reps.select("v", "sig"), "v")
        at = written(at.select("v", F.explode(_branches(F.col("node"), F.col("sig"))).alias("node"), "comp"), "nodes", scratch)
        met = _met(at, at.count(), block, leaf, scratch)
    ends.append(_by_blocks(met, block))
    return reduce(DataFrame.unionByName, ends)


def _likely(members: DataFrame, reps: DataFrame, percent: int, forest: bool) -> DataFrame:
    """``a, b, sure``, each pair once, from ``v, key, comp``: likely links of different components under one key."""
    rows = members.join(reps.select("v", "sketch"), "v").select("key", "v", "sketch", "comp")
    rows = rows.repartition("key").sortWithinPartitions("key")
    pairs = rows.mapInArrow(lambda batches: node_pairs(batches, percent, forest), "a long, b long, sure boolean")
    return pairs.groupBy("a", "b").agg(F.bool_or("sure").alias("sure"))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of the pairs whose full sets have ``100 * intersection >= percent * union``.

    ``texts`` has ``v, text``.  A document in many pairs is repeated once for
    every ``PAIRS_PER_SALT`` of them, so that no task gets them all.
    """

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                ta, tb = part.column(2), shingle_sets(part.column(3).to_pylist())
                good = []
                for i, x in enumerate(a):
                    if x != last[0]:
                        last = (x, shingle_sets([ta[i].as_py()])[0])
                    # Both are sorted and distinct, so repeats in the merged array are the intersection.
                    both = np.sort(np.concatenate([last[1], tb[i]]), kind="stable")
                    same = int((both[1:] == both[:-1]).sum())
                    good.append(100 * same >= percent * (len(both) - same) > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()).filter(pa.array(good, pa.bool_())) for c in (a, b)], names=["a", "b"]
                )

    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    salts = F.ceil(F.col("n") / PAIRS_PER_SALT).cast("int")
    dealt = join_groups(pairs, counts, "a", "n", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
    first = texts.join(counts.withColumnRenamed("a", "v"), "v").select(
        F.col("v").alias("a"), F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    )
    second = texts.join(pairs.select(F.col("b").alias("v")).distinct(), "v", "left_semi").select(
        F.col("v").alias("b"), F.col("text").alias("text_b")
    )
    rows = dealt.join(second, "b").join(first, ["a", "salt"]).select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(linked, "a long, b long")


def _joined(
    members: DataFrame, so_far: tuple[DataFrame, DataFrame] | None, reps: DataFrame, texts: DataFrame, percent: int, scratch: list[str]
) -> tuple[DataFrame, DataFrame]:
    """All links and components once the links within ``members`` are added."""
    links = None
    for forest in (True, False):
        pairs = written(_likely(members, reps, percent, forest), "pairs", scratch)
        if so_far and pairs.isEmpty():
            return so_far
        links = written(confirmed(pairs.select("a", "b"), texts, percent), "links", scratch)
        if not forest or pairs.where("sure").join(links, ["a", "b"], "left_anti").isEmpty():
            break
    links = so_far[0].union(links) if so_far else links
    return links, written(components(links, scratch), "components", scratch)


def near_dedup(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    percent: int = 75,
    trees: int = TREES,
    block: int = BLOCK,
    leaf: int = LEAF,
    depth: int = DEPTH,
    stored: bool = False,
    keep_only: bool = False,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Two documents are linked if ``100 * intersection >= percent * union`` of
    their shingle sets; ``component_id`` is the smallest id reachable and
    ``kept`` marks the row of that id.  Documents without words have an empty
    set and are linked with nothing.  Of rows that repeat the smallest id the
    first is kept; null ids come after all others, and a component of null ids
    alone has a null ``component_id`` and keeps one row.  An empty table gives an
    empty one.  ``stored``: ``docs`` reads files, so that its rows have the same
    place each time; otherwise it is written first.  With ``keep_only`` the
    kept rows of ``docs`` are returned, with its columns; their names may be any.
    Very long texts are hashed in parts and read whole.
    """
    if not stored:
        docs = written(docs, "documents")
    row = fresh(docs.columns, "row")
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    narrow = placed.select(F.col(row).alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    spark, scratch, last = docs.sparkSession, [], []
    base = written(signed(narrow), "shingled", last)
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    sets = base.where("set_id is not null").groupBy("set_id").agg(
        F.min(first).alias("first"), F.min_by("sig", first).alias("sig"), F.min_by("sketch", first).alias("sketch"), F.count(F.lit(1)).alias("n")
    )
    reps = sets.select("set_id", "n", "first", F.col("first.row").alias("v"), "sig", "sketch", _roots(F.col("sig"), trees).alias("roots"))
    reps = written(reps, "distinct-sets", scratch)

    texts = narrow.select(F.col("row").alias("v"), "text")
    at = reps.select("v", F.posexplode("roots").alias("tree", "node"))
    met = _met(at, trees * reps.count(), block, leaf, scratch)
    parts = F.pmod(F.xxhash64("v", "node"), F.ceil(F.col("n") / block)).cast("int")
    key = F.when(F.col("n") > block, F.xxhash64("node", parts)).otherwise(F.col("node"))
    links, comps = _joined(met.select("v", key.alias("key"), F.col("v").alias("comp")), None, reps, texts, percent, scratch)
    if not met.where(F.col("n") > block).isEmpty():
        ends = written(_deeper(met, reps, comps, block, leaf, depth, scratch), "end-members", scratch)
        links, comps = _joined(ends, (links, comps), reps, texts, percent, scratch)

    joined = reps.join(comps, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    best = joined.groupBy("comp").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("size"))
    classes = join_groups(joined.select("set_id", "n", "comp"), best, "comp", "size", reps.count()).select("set_id", "n", "best")
    classes = written(classes, "classes", last)
    drop(spark, scratch)
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    got = join_groups(base.where("set_id is not null").drop("sig", "sketch"), classes, "set_id", "n", base.count()).unionByName(
        base.where("set_id is null").drop("sig", "sketch").withColumn("n", F.lit(1).cast("long")).withColumn("best", own)
    )
    got = got.select("row", "doc_id", "n_shingles", F.col("best.id").alias("component_id"), (F.col("best.row") == F.col("row")).alias("kept"))
    if not keep_only:
        return got.drop("row")
    dropped = written(got.where("not kept").select(F.col("row").alias(row)), "dropped")
    drop(spark, last)
    return placed.join(dropped, row, "left_anti").drop(row)
