"""Connected components of a graph given by links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_size, join_groups, written


def _mapped(rows: DataFrame, key: str, to: DataFrame, name: str, total: int) -> DataFrame:
    """``rows`` with ``name``, what ``to`` (``v``, ``parent``) gives for ``key``; a key of very many rows is no hot task."""
    to = to.select(F.col("v").alias(key), F.col("parent").alias(name))
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    if total <= hot_size(total) or sizes.where(F.col("_n") > hot_size(total)).isEmpty():
        return rows.join(to, key)
    return join_groups(rows, to.join(sizes, key), key, "_n", total).drop("_n")


def _roots(parent: DataFrame, total: int, scratch: list[str] | None) -> DataFrame:
    """``v, parent`` with every parent replaced by the root above it, by pointer jumping."""
    parent = written(parent, "parents", scratch)
    while True:
        up = _mapped(parent, "parent", parent, "up", total)
        up = written(up.select("v", F.col("up").alias("parent"), (F.col("up") != F.col("parent")).alias("moved")), "parents", scratch)
        parent = up.select("v", "parent")
        if up.where("moved").isEmpty():
            return parent


def components(links: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """``(v long, comp long)`` for every vertex of ``links`` (``a long, b long``): the least vertex it is joined to.

    Each round a vertex hooks onto its least neighbour, if that is less; the trees this
    gives become one vertex each, named by their least, and only links between trees
    go on, so rounds shrink.  Tables are written on the way; only counts go to the
    driver.  ``scratch``: see ``written``.
    """
    first = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = written(first.distinct(), "edges", scratch)
    own = edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct()
    comps = written(own.withColumn("comp", F.col("v")), "components", scratch)
    n = comps.count()
    edges = edges.where("a <> b")
    while total := edges.count():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a"))
        parent = _roots(both.groupBy("v").agg(F.least("v", F.min("w")).alias("parent")), n, scratch)
        edges = _mapped(_mapped(edges, "a", parent, "x", total).select("x", "b"), "b", parent, "y", total)
        edges = edges.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = written(edges, "edges", scratch)
        sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
        to = sizes.join(parent.withColumnRenamed("v", "comp"), "comp", "left")
        to = to.select("comp", "n", F.coalesce("parent", "comp").alias("to"))
        comps = written(join_groups(comps, to, "comp", "n", n).select("v", F.col("to").alias("comp")), "components", scratch)
    return comps
