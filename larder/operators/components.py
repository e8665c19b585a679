"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import Scratch


def star_links(pairs: DataFrame, key: str, node: str, *, salts: int = 32) -> DataFrame:
    """Links (u, v) that join all nodes with the same key, in number as the rows.

    A hot key is cut into ``salts`` parts by a hash of the node: each node is linked
    to the least node of its part, and those to the least of the key, so no task
    holds a whole key.  Null keys link nothing.
    """
    p = pairs.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(node).alias("v"))
    p = p.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(salts)))
    heads = p.groupBy("k", "s").agg(F.min("v").alias("u"))
    inner = p.join(heads, ["k", "s"])
    outer = heads.join(heads.groupBy("k").agg(F.min("u").alias("_least")), "k").select(F.col("_least").alias("u"), F.col("u").alias("v"))
    return inner.where("u != v").select("u", "v").unionByName(outer.where("u != v").select("u", "v"))


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the links (u, v BIGINT); root is one node of the set.

    Rounds of hooking (each node takes the least neighbour as parent) and
    shortcutting (parent of parent, twice) over parent tables; the links are then
    carried over to the parents, loops and repetitions dropped, until none is left.
    Nodes are compared by xxhash64, which is one-to-one on BIGINT, so that chains of
    rising numbers do not become long chains of parents; every table is written to
    the shared folder.
    """
    spark = links.sparkSession
    h = links.select(F.xxhash64("u").alias("x"), F.xxhash64("v").alias("y"), "u", "v")
    nodes = h.select(F.col("x").alias("h"), F.col("u").alias("node")).unionByName(h.select(F.col("y").alias("h"), F.col("v").alias("node"))).distinct()
    edges = _tidy(h.select("x", "y"))
    edges = scratch.keep(edges, "edges")
    levels = []
    while not edges.isEmpty():
        hook = edges.groupBy("a").agg(F.min("b").alias("p"))
        parents = scratch.keep(hook, "hook")
        up = parents.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        once = parents.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"))
        up2 = once.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        jumped = scratch.keep(once.join(up2, "p", "left").select("a", F.coalesce("pp", "p").alias("p")), "parents")
        pa = jumped.select("a", F.col("p").alias("x"))
        pb = jumped.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(pa, "a").join(pb, "b", "left").select("x", F.coalesce("pb", "b").alias("y"))
        after = scratch.keep(_tidy(moved), "edges")
        scratch.drop(edges)
        scratch.drop(parents)
        edges = after
        levels.append(jumped)
    found = nodes.withColumn("r", F.col("h"))
    for level in levels:
        found = found.join(level.select(F.col("a").alias("r"), "p"), "r", "left").select("h", "node", F.coalesce("p", "r").alias("r"))
    roots = nodes.select(F.col("h").alias("r"), F.col("node").alias("root"))
    return scratch.keep(found.join(roots, "r").select("node", "root"), "components") if levels else spark.createDataFrame([], "node bigint, root bigint")


def _tidy(pairs: DataFrame) -> DataFrame:
    return pairs.where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
