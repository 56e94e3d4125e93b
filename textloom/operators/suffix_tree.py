"""Navigation in suffix trees given as tables (``suffix.parents``: ``shard, lb, rb, depth, parent_lb, parent_rb, parent_depth``).

Every operator answers all nodes, or a table of questions, at once. Ways up the tree are followed by doubled jumps: after k rounds a pointer leads 2^k nodes
up, so a path of any length takes rounds in its logarithm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.storage import materialize
from textloom.operators.corpus import running_total
from textloom.operators.sequence import range_minimum
from textloom.operators.suffix import latest

_NODE = ["shard", "lb", "rb"]


def _jumps(parents: DataFrame) -> DataFrame:
    return parents.select(*_NODE, F.col("parent_lb").alias("_ul"), F.col("parent_rb").alias("_ur"))


def _twice(jumps: DataFrame) -> DataFrame:
    further = jumps.select("shard", F.col("lb").alias("_ul"), F.col("rb").alias("_ur"), F.col("_ul").alias("_vl"), F.col("_ur").alias("_vr"))
    return materialize(jumps.join(further, ["shard", "_ul", "_ur"]).select(*_NODE, F.col("_vl").alias("_ul"), F.col("_vr").alias("_ur")), "jumps")


def node_depths(parents: DataFrame) -> DataFrame:
    """``shard, lb, rb, node_depth``: edges between each node and the root."""
    rows = materialize(_jumps(parents).withColumn("_d", F.when(F.col("_ul").isNull(), 0).otherwise(1).cast("long")), "depths")
    while not rows.where("_ul is not null").isEmpty():
        up = rows.select("shard", F.col("lb").alias("_ul"), F.col("rb").alias("_ur"), F.col("_ul").alias("_vl"), F.col("_ur").alias("_vr"), F.col("_d").alias("_e"))
        joined = rows.join(up, ["shard", "_ul", "_ur"], "left")
        rows = materialize(joined.select(*_NODE, F.col("_vl").alias("_ul"), F.col("_vr").alias("_ur"), (F.col("_d") + F.coalesce("_e", F.lit(0))).alias("_d")), "depths")
    return rows.select(*_NODE, F.col("_d").alias("node_depth"))


def ancestors(parents: DataFrame, asked: DataFrame) -> DataFrame:
    """``shard, lb, rb, up`` -> the node ``up`` edges above (``anc_lb, anc_rb``); null beyond the root."""
    out = asked.select(*_NODE, "up", F.col("lb").alias("_al"), F.col("rb").alias("_ar"))
    most = asked.agg(F.coalesce(F.max("up"), F.lit(0)).alias("n")).first()["n"]
    jumps, bit = _jumps(parents).where("parent_lb is not null"), 1
    while bit <= most:
        step = jumps.select("shard", F.col("lb").alias("_al"), F.col("rb").alias("_ar"), F.col("_ul").alias("_bl"), F.col("_ur").alias("_br"))
        takes = F.col("up").bitwiseAND(bit) > 0
        joined = out.join(step, ["shard", "_al", "_ar"], "left")
        out = materialize(joined.select(*_NODE, "up", F.when(takes, F.col("_bl")).otherwise(F.col("_al")).alias("_al"), F.when(takes, F.col("_br")).otherwise(F.col("_ar")).alias("_ar")), "ancestors")
        bit *= 2
        if bit <= most:
            jumps = _twice(jumps)
    return out.select(*_NODE, "up", F.col("_al").alias("anc_lb"), F.col("_ar").alias("anc_rb"))


def traversals(parents: DataFrame, depths: DataFrame) -> DataFrame:
    """``shard, lb, rb, preorder, postorder, level_order``: numbers from 0 in the orders of a depth-first walk, bottom up, and by levels.

    Numbered in two levels: running totals over the nodes that begin (end) at each rank, then among these few.
    """

    def numbered(rows: DataFrame, at: str, then, group: str, name: str) -> DataFrame:
        per = rows.groupBy(group, at).agg(F.count(F.lit(1)).alias("_k"))
        base = running_total(per, F.col("_k"), at, "_base", group=group).select(group, at, "_base")
        within = F.row_number().over(Window.partitionBy(group, at).orderBy(then)) - 1
        return rows.withColumn("_w", within).join(base, [group, at]).withColumn(name, (F.col("_base") + F.col("_w")).cast("long")).drop("_w", "_base")

    rows = numbered(parents.select(*_NODE), "lb", F.desc("rb"), "shard", "preorder")
    rows = materialize(numbered(rows, "rb", F.desc("lb"), "shard", "postorder"), "walks")
    # Levels first: nodes before each level, then left bounds within it.
    rows = rows.join(depths, _NODE)
    sizes = rows.groupBy("shard", "node_depth").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("node_depth").rowsBetween(Window.unboundedPreceding, -1)  # a row for each level
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    level = rows.withColumn("_level", F.concat_ws("/", "shard", "node_depth"))
    level = running_total(level, F.lit(1).cast("long"), "lb", "_w", group="_level").join(sizes, ["shard", "node_depth"])
    return level.select(*_NODE, "preorder", "postorder", (F.col("_before") + F.col("_w")).cast("long").alias("level_order"))


def _holding(tree: DataFrame, asked: DataFrame) -> DataFrame:
    """``shard, _x, _d, ...`` -> the node of depth ``_d`` that holds rank ``_x``: nodes of one depth are disjoint, so it is the last that begins at or before it."""
    none, names = F.lit(None).cast("long"), [c for c in asked.columns if c not in ("shard", "_x", "_d")]
    starts = tree.select("shard", F.col("depth").alias("_d"), F.col("lb").alias("_x"), *(none.alias(c) for c in names), F.col("lb").alias("_lb"))
    both = asked.select("shard", "_d", "_x", *names, none.alias("_lb")).withColumn("_q", F.lit(True)).unionByName(starts.withColumn("_q", F.lit(False)))
    hit = latest(both, ["shard", "_d"], "_x", "_lb", "_at").where("_q")
    ends = tree.select("shard", F.col("depth").alias("_d"), F.col("lb").alias("_at"), F.col("rb").alias("_end"))
    return hit.join(ends, ["shard", "_d", "_at"]).where("_x <= _end").select("shard", "_x", "_d", *names, "_at", "_end")


def lca(tree: DataFrame, lcps: DataFrame, pairs: DataFrame, width: int = 1 << 16) -> DataFrame:
    """``shard, x, y`` (ranks, x < y) -> the lowest common ancestor of the two leaves, ``lb, rb, depth``: its depth is the least LCP after x up to y."""
    wide = F.col("shard") * (1 << 40)
    seq = lcps.select((wide + F.col("rank")).alias("i"), F.col("lcp").alias("v"))
    asked = pairs.select("shard", "x", "y", F.struct("shard", "x", "y").alias("range_id"), (wide + F.col("x") + 1).alias("lo"), (wide + F.col("y")).alias("hi"))
    least = range_minimum(seq, asked.select("range_id", "lo", "hi"), width=width).select("range_id.*", "v")
    hit = _holding(tree, least.select("shard", F.col("x").alias("_x"), F.col("v").alias("_d"), "y"))
    return hit.select("shard", F.col("_x").alias("x"), "y", F.col("_at").alias("lb"), F.col("_end").alias("rb"), F.col("_d").alias("depth"))


def leaves(tree: DataFrame, lcps: DataFrame) -> DataFrame:
    """``shard, rank, parent_lb, parent_rb, parent_depth``: the inner node above each leaf, whose depth is the larger LCP on either side."""
    after = lcps.select("shard", (F.col("rank") - 1).alias("rank"), F.col("lcp").alias("_after"))
    deep = lcps.join(after, ["shard", "rank"], "left").select("shard", F.col("rank").alias("_x"), F.greatest("lcp", F.coalesce("_after", F.lit(0))).alias("_d"))
    return _holding(tree, deep).select("shard", F.col("_x").alias("rank"), F.col("_at").alias("parent_lb"), F.col("_end").alias("parent_rb"), F.col("_d").alias("parent_depth"))


def children(parents: DataFrame, leaf: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``shard, parent_lb, parent_rb, lb, rb, ordinal, byte, sibling_lb``: inner nodes and leaves below each node, from left to right.

    ``ordinal`` counts from 1; ``byte`` is the first one of the edge, which no other child has, so a node has at most 256 children; ``sibling_lb`` is where the next begins.
    """
    up = ["parent_lb", "parent_rb", "parent_depth"]
    rows = parents.where("parent_lb is not null").select("shard", *up, "lb", "rb").unionByName(leaf.select("shard", *up, F.col("rank").alias("lb"), F.col("rank").alias("rb")))
    at = suffixes.select("shard", F.col("rank").alias("lb"), "ptr")
    first = suffixes.select("shard", "ptr", "byte")
    rows = rows.join(at, ["shard", "lb"]).withColumn("ptr", F.col("ptr") + F.col("parent_depth")).join(first, ["shard", "ptr"])
    by = Window.partitionBy("shard", "parent_lb", "parent_rb").orderBy("lb")
    return rows.select("shard", "parent_lb", "parent_rb", "lb", "rb", F.row_number().over(by).alias("ordinal"), "byte", F.lead("lb").over(by).alias("sibling_lb"))
