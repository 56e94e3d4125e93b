"""Weighted points in the plane and graphs as edge tables: rectangle queries, top-k, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.storage import materialize
from textloom.operators.corpus import running_total
from textloom.operators.sequence import smaller_neighbours


def inside(x: tuple[int, int], y: tuple[int, int], z: tuple[float, float] | None = None) -> Column:
    """Points ``x, y`` (and weight ``w``) in a box, borders included; plain comparisons, so they are pushed into the scan."""
    box = F.col("x").between(*x) & F.col("y").between(*y)
    return box & F.col("w").between(*z) if z else box


def top_k(points: DataFrame, x: tuple[int, int], y: tuple[int, int], k: int, *tie: str) -> DataFrame:
    """The k heaviest points of a rectangle. Each task keeps k rows; nothing is sorted as a whole."""
    return points.where(inside(x, y)).orderBy(F.desc("w"), *tie).limit(k)


def count_in(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """``box_id, x1, x2, y1, y2`` -> number of points in each box. The boxes are a stated query set, broadcast after a look at their number."""
    if boxes.limit(100_001).count() > 100_000:
        raise ValueError("more than 100,000 boxes: ask in several calls")
    hit = points.join(F.broadcast(boxes), F.expr("x between x1 and x2 and y between y1 and y2"))
    n = hit.groupBy("box_id").agg(F.count(F.lit(1)).alias("n"))
    return boxes.select("box_id").join(n, "box_id", "left").fillna(0, ["n"])


def adjacent(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``src, dst`` -> whether the edge exists."""
    found = edges.select("src", "dst", F.lit(True).alias("_e")).distinct()
    return pairs.join(found, ["src", "dst"], "left").select("src", "dst", F.col("_e").isNotNull().alias("adjacent"))


def neighbours_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Targets of each asked ``src``."""
    return edges.join(nodes, "src", "left_semi").select("src", "dst").distinct()


def sources_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sources of each asked ``dst``."""
    return edges.join(nodes, "dst", "left_semi").select("src", "dst").distinct()


def levels(tree: DataFrame, root: str | int) -> DataFrame:
    """``node, parent`` -> ``node, parent, depth``: one join per level, breadth first, down to the deepest node below the root.

    A node that is reached on two levels raises ``ValueError``: the rows are no tree, and on a cycle they would have no end.
    """
    front = materialize(tree.where(F.col("node") == F.lit(root)).withColumn("depth", F.lit(0)), "level")
    out, d = front, 0
    while True:
        d += 1
        front = materialize(tree.join(front.select(F.col("node").alias("parent")), "parent").select("node", "parent").withColumn("depth", F.lit(d)), "level")
        if front.isEmpty():
            return out
        if not front.join(out.select("node"), "node", "left_semi").isEmpty():
            raise ValueError("not a tree: a node is reached on two levels")
        out = out.unionByName(front)
        if d % 16 == 0:  # the plan stays short however deep the tree is
            out = materialize(out, "levels")


def louds(nodes: DataFrame) -> DataFrame:
    """``node, ix, degree`` (ix: breadth-first number from 0) -> the ``start`` and ``stop`` of each node's unary block in the level-order bit string."""
    rows = running_total(nodes.withColumn("one", F.lit(0)), (F.col("degree") + 1).cast("long"), "ix", "start", group="one")
    return rows.select("node", "ix", "degree", "start", (F.col("start") + F.col("degree")).alias("stop"))


def parentheses(bits: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Balanced parentheses ``i, bit`` (1 opens) -> ``i, excess, match, enclose`` of every opening one.

    The excess is a running total of +1 and -1. The parenthesis that closes position i is the next one of smaller excess; the pair that
    encloses it opens right after the nearest smaller excess before it.
    """
    rows = running_total(bits.withColumn("one", F.lit(0)), (2 * F.col("bit") - 1).cast("long"), "i", "before", group="one")
    rows = rows.select("i", "bit", (F.col("before") + 2 * F.col("bit") - 1).alias("v"))
    near = materialize(smaller_neighbours(rows, block).select("i", "prev", "next"), "neighbours")
    # Steps are of one, so the nearest smaller excess is v - 1, and the pair around it opens right after the one smaller than that.
    out = rows.where("bit = 1").join(near, "i").join(near.select(F.col("i").alias("prev"), F.col("prev").alias("_p")), "prev", "left")
    around = F.when(F.col("v") > 1, F.coalesce(F.col("_p") + 1, F.lit(0).cast("long")))
    return out.select("i", F.col("v").alias("excess"), F.col("next").alias("match"), around.alias("enclose"))


def matched(pairs: DataFrame) -> DataFrame:
    """``i, excess, match, enclose`` -> ``close, open``: the partner of every closing parenthesis."""
    return pairs.where("match is not null").select(F.col("match").alias("close"), F.col("i").alias("open"))
