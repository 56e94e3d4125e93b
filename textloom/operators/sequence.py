"""Rank, select and range queries over a sequence: a table of integer positions ``i`` (from 0, without gaps) and symbols ``sym``.

Each bulk operator takes a table of queries and answers all of them in one join or aggregation; none walks the sequence row by row.
Running counts per symbol are two-level (see ``corpus.running_total``), so a symbol that makes up a third of the sequence is many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.storage import materialize
from textloom.operators.corpus import running_total


def ranked(seq: DataFrame) -> DataFrame:
    """Adds ``rank``: occurrences of the row's own symbol before it. That is inverse select: position -> (rank, symbol)."""
    return running_total(seq, F.lit(1).cast("long"), "i", "rank", group="sym")


def access(seq: DataFrame, at: DataFrame) -> DataFrame:
    """``i`` -> ``i, sym``."""
    return at.join(seq, "i").select("i", "sym")


def rank(seq: DataFrame, asked: DataFrame) -> DataFrame:
    """``i, sym`` -> occurrences of ``sym`` before position i; 0 for symbols that don't occur."""
    # Questions and occurrences of a symbol go into one running count; a question counts for nothing and comes before its position.
    q = asked.select((2 * F.col("i")).alias("_o"), "sym", F.col("i"), F.lit(0).cast("long").alias("_w")).distinct()
    s = seq.select((2 * F.col("i") + 1).alias("_o"), "sym", F.lit(None).cast("long").alias("i"), F.lit(1).cast("long").alias("_w"))
    return running_total(q.unionByName(s), F.col("_w"), "_o", "rank", group="sym").where("i is not null").select("i", "sym", "rank")


def select(seq: DataFrame, asked: DataFrame) -> DataFrame:
    """``k, sym`` -> position of the k-th occurrence, counted from 1; no row if there are fewer."""
    return ranked(seq).withColumn("k", F.col("rank") + 1).join(asked, ["k", "sym"]).select("k", "sym", "i")


def lex_count(seq: DataFrame, lo: int, hi: int, symbol) -> DataFrame:
    """Of positions [lo, hi): occurrences of the symbol before lo, and smaller and greater symbols within."""
    within = (F.col("i") >= lo) & (F.col("i") < hi)
    s = F.lit(symbol)
    return seq.where(F.col("i") < hi).agg(F.count_if((F.col("i") < lo) & (F.col("sym") == s)).alias("rank"), F.count_if(within & (F.col("sym") < s)).alias("smaller"), F.count_if(within & (F.col("sym") > s)).alias("greater"))


def lex_smaller_count(seq: DataFrame, i: int, symbol) -> DataFrame:
    """Before position i: occurrences of the symbol, and of all smaller ones."""
    return seq.where(F.col("i") < i).agg(F.count_if(F.col("sym") == F.lit(symbol)).alias("rank"), F.count_if(F.col("sym") < F.lit(symbol)).alias("smaller"))


def interval_symbols(seq: DataFrame, lo: int, hi: int) -> DataFrame:
    """Distinct symbols of [lo, hi) with their ranks at both ends."""
    before = F.count_if(F.col("i") < lo).alias("rank_lo")
    return seq.where(F.col("i") < hi).groupBy("sym").agg(before, F.count(F.lit(1)).alias("rank_hi")).where("rank_hi > rank_lo")


def _cut(ranges: DataFrame, width: int) -> DataFrame:
    """Ranges [lo, hi] cut at multiples of ``width``: ``_b`` numbers the piece, ``_whole`` tells whether it is a whole block."""
    b = F.col("_b")
    cut = ranges.where("lo <= hi").withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    return cut.withColumn("_whole", (b * width >= F.col("lo")) & ((b + 1) * width - 1 <= F.col("hi")))


def _symbols_in(seq: DataFrame, ranges: DataFrame, *keys: str, width: int = 1 << 16) -> DataFrame:
    """``*keys, sym, freq``: occurrences of each symbol in each range.

    Whole blocks are answered from counts per block and symbol; only the two ends of a range meet single positions. All joins are on the block.
    """
    cut, rows = _cut(ranges, width), seq.withColumn("_b", F.floor(F.col("i") / width))
    per = rows.groupBy("_b", "sym").agg(F.count(F.lit(1)).alias("_n"))
    whole = cut.where("_whole").join(per, "_b").select(*keys, "sym", "_n")
    ends = cut.where("not _whole").join(rows, "_b").where("i between lo and hi").groupBy(*keys, "sym").agg(F.count(F.lit(1)).alias("_n"))
    return whole.unionByName(ends).groupBy(*keys, "sym").agg(F.sum("_n").alias("freq"))


def quantile_freq(seq: DataFrame, ranges: DataFrame) -> DataFrame:
    """``range_id, lo, hi, q``: the q-th smallest symbol (from 0) of positions [lo, hi], and how often it stands there.

    Only one row per range and distinct symbol is ordered.
    """
    n = _symbols_in(seq, ranges, "range_id", "q")
    up_to = F.sum("freq").over(Window.partitionBy("range_id").orderBy("sym"))
    return n.withColumn("_u", up_to).where((F.col("_u") > F.col("q")) & (F.col("_u") - F.col("freq") <= F.col("q"))).select("range_id", "sym", "freq")


def intersect(seq: DataFrame, ranges: DataFrame, least: int) -> DataFrame:
    """Symbols that stand in at least ``least`` of the ranges [lo, hi], with their occurrences in all of them."""
    per = _symbols_in(seq, ranges, "range_id")
    return per.groupBy("sym").agg(F.count(F.lit(1)).alias("n_ranges"), F.sum("freq").alias("freq")).where(F.col("n_ranges") >= least)


def range_search_2d(seq: DataFrame, lo: int, hi: int, low, high) -> DataFrame:
    """Points (i, sym) in a rectangle, borders included."""
    return seq.where(F.col("i").between(lo, hi) & F.col("sym").between(low, high)).select("i", "sym")


def symbol_bounds(seq: DataFrame, asked: DataFrame) -> DataFrame:
    """``c`` -> the largest symbol not above it and the smallest not below it. The alphabet is joined, not the sequence."""
    alphabet = seq.select("sym").distinct()
    return neighbours(alphabet.select(F.col("sym").alias("value")), asked.select(F.col("c").alias("x"))).select(F.col("x").alias("c"), F.col("predecessor").alias("lte"), F.col("successor").alias("gte"))


def unique_range_values(seq: DataFrame, lo: int, hi: int, low, high) -> DataFrame:
    """Distinct symbols of [low, high] that stand at positions [lo, hi]."""
    return range_search_2d(seq, lo, hi, low, high).select("sym").distinct()


def range_minimum(seq: DataFrame, ranges: DataFrame, value: str = "v", width: int = 1 << 16) -> DataFrame:
    """``range_id, lo, hi`` -> position and value of the leftmost minimum of [lo, hi]; whole blocks are answered from their own minima."""
    cut, rows = _cut(ranges, width), seq.select("i", F.col(value).alias("v"), F.floor(F.col("i") / width).alias("_b"))
    least = F.min(F.struct("v", "i")).alias("m")
    whole = cut.where("_whole").join(rows.groupBy("_b").agg(least), "_b").select("range_id", "m")
    ends = cut.where("not _whole").join(rows, "_b").where("i between lo and hi").groupBy("range_id").agg(least)
    return whole.unionByName(ends).groupBy("range_id").agg(F.min("m").alias("m")).select("range_id", "m.i", "m.v")


def _nearest_block(asked: DataFrame, low: DataFrame, fan: int, before: bool) -> DataFrame:
    """``i, v, _b`` -> ``i, v, _t``: the nearest block before (or after) ``_b`` whose minimum is below v; none without any.

    Up and down a tree of minima with ``fan`` children a node: one equi-join a level.
    """
    nearest = F.array_max if before else F.array_min
    step = lambda ok: nearest(F.filter(F.transform("_a", lambda m, k: F.when((m < F.col("v")) & ok(k), k)), lambda k: k.isNotNull()))
    levels, top = [], low.select(F.col("_b").alias("_n"), "_m")
    most = int(low.agg(F.coalesce(F.max("_b"), F.lit(0)).alias("n")).first()["n"])
    while True:
        pieces = top.select(F.floor(F.col("_n") / fan).alias("_g"), (F.col("_n") % fan).alias("_k"), "_m").groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_m"))).alias("_map"))
        levels.append(pieces.select("_g", F.transform(F.sequence(F.lit(0), F.lit(fan - 1)), lambda k: F.try_element_at("_map", k.cast("long"))).alias("_a")))
        top = top.groupBy(F.floor(F.col("_n") / fan).alias("_n")).agg(F.min("_m").alias("_m"))
        most //= fan
        if not most:
            break
    open_, found = asked.select("i", "v", F.col("_b").alias("_n")), None
    for k, level in enumerate(levels):
        at = open_.withColumns({"_g": F.floor(F.col("_n") / fan), "_c": F.col("_n") % fan}).join(level, "_g")
        at = materialize(at.select("i", "v", "_g", step(lambda k: k < F.col("_c") if before else k > F.col("_c")).alias("_hit")), "climb")
        hit = at.where("_hit is not null").select("i", "v", (F.col("_g") * fan + F.col("_hit")).alias("_n"))
        for below in reversed(levels[:k]):
            hit = hit.join(below.withColumnRenamed("_g", "_n"), "_n").select("i", "v", (F.col("_n") * fan + step(lambda k: F.lit(True))).alias("_n"))
        found = hit if found is None else found.unionByName(hit)
        open_ = at.where("_hit is null").select("i", "v", F.col("_g").alias("_n"))
    return found.select("i", "v", F.col("_n").alias("_t"))


def smaller_neighbours(seq: DataFrame, block: int = 1 << 16) -> DataFrame:
    """``i, v`` -> ``i, v, prev, next``: nearest positions with a smaller value before and after, null without any.

    Blocks of consecutive positions are solved in parallel by a stack. What a block leaves open is looked up in a tree of block
    minima, and then in the one block found, by binary search in its running minima. A block that very many rows point to is answered in several tasks.
    """

    def f(t: pa.Table) -> pa.Table:
        i, v = t.column("i").to_numpy(), t.column("v").to_numpy()
        o = np.argsort(i)
        i, v = i[o].tolist(), v[o].tolist()
        prev: list[int | None] = [None] * len(v)
        nxt: list[int | None] = [None] * len(v)
        stack: list[int] = []
        for k, x in enumerate(v):
            while stack and v[stack[-1]] > x:
                nxt[stack.pop()] = i[k]
            j = len(stack)
            while j and v[stack[j - 1]] == x:
                j -= 1
            prev[k] = i[stack[j - 1]] if j else None
            stack.append(k)
        return pa.table({"i": pa.array(i, pa.int64()), "v": pa.array(v, pa.float64()), "prev": pa.array(prev, pa.int64()), "next": pa.array(nxt, pa.int64())})

    rows = seq.select("i", F.col("v").cast("double").alias("v"), F.floor(F.col("i") / block).alias("_b"))
    rows = materialize(rows, "values")
    inside = rows.select("_b", "i", "v").groupBy("_b").applyInArrow(f, "i long, v double, prev long, next long")
    inside = materialize(inside.withColumn("_b", F.floor(F.col("i") / block)), "inside")
    low = rows.groupBy("_b").agg(F.min("v").alias("_m"))
    values = rows.select("_b", F.col("i").alias("_i"), F.col("v").alias("_v"))
    p = _last_below(_nearest_block(inside.where("prev is null"), low, FAN, True), values, True)
    n = _last_below(_nearest_block(inside.where("next is null"), low, FAN, False), values, False)
    both = inside.join(p.withColumnRenamed("at", "_p"), "i", "left").join(n.withColumnRenamed("at", "_n"), "i", "left")
    return both.select("i", "v", F.coalesce("prev", "_p").alias("prev"), F.coalesce("next", "_n").alias("next"))


FAN, QUESTIONS = 16, 1 << 20


def _last_below(asked: DataFrame, values: DataFrame, last: bool) -> DataFrame:
    """``i, v, _t`` -> ``i, at``: the last (or first) position of block ``_t`` with a value below v."""

    def f(q: pa.Table, t: pa.Table) -> pa.Table:
        i, v = t.column("_i").to_numpy(), t.column("_v").to_numpy()
        o = np.argsort(i)[::-1] if last else np.argsort(i)
        low = np.minimum.accumulate(v[o])
        # The running minima never rise: the first of them below v is where the value stands.
        k = np.searchsorted(-low, -q.column("v").to_numpy(), "right")
        return pa.table({"i": q.column("i"), "at": pa.array(i[o][k] if q.num_rows else i[:0])})

    asked = materialize(asked, "open")
    salts = asked.groupBy("_t").agg(F.ceil(F.count(F.lit(1)) / QUESTIONS).alias("_salts"))
    q = asked.join(salts, "_t").select("_t", F.pmod(F.xxhash64("i"), "_salts").alias("_s"), "i", "v")
    t = values.join(salts.withColumnRenamed("_t", "_b"), "_b").select(F.col("_b").alias("_t"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)).alias("_s"), "_i", "_v")
    return q.groupBy("_t", "_s").cogroup(t.groupBy("_t", "_s")).applyInArrow(f, "i long, at long")


def neighbours(values: DataFrame, asked: DataFrame) -> DataFrame:
    """Predecessor and successor: ``x`` -> largest value not above and smallest value not below; null beyond the ends.

    Values and questions are merged in one order and filled from both sides, in blocks of the value's high bits; what a block
    does not hold comes from the ends of the nearest blocks that have values.
    """
    shift = 1 << 12
    both = values.select(F.col("value").alias("x"), F.lit(True).alias("_v")).distinct().unionByName(asked.select("x", F.lit(False).alias("_v")).distinct()).withColumn("_b", F.floor(F.col("x") / shift))
    ends = both.groupBy("_b").agg(F.max(F.when(F.col("_v"), F.col("x"))).alias("_hi"), F.min(F.when(F.col("_v"), F.col("x"))).alias("_lo"))
    # Two levels: blocks within a group of them, and a row for each group.
    ends = ends.withColumn("_g", F.floor(F.col("_b") / shift))
    groups = ends.groupBy("_g").agg(F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"))
    around = lambda rows, by: rows.select("*", F.last("_hi", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"), F.first("_lo", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)).alias("_above"))
    outer = around(groups, Window.orderBy("_g")).select("_g", F.col("_below").alias("_below2"), F.col("_above").alias("_above2"))
    ends = around(ends, Window.partitionBy("_g").orderBy("_b")).join(outer, "_g").select("_b", F.coalesce("_below", "_below2").alias("_below"), F.coalesce("_above", "_above2").alias("_above"))
    w = Window.partitionBy("_b").orderBy("x")
    value = F.when(F.col("_v"), F.col("x"))
    both = both.withColumn("_p", F.max(value).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_s", F.min(value).over(w.rangeBetween(0, Window.unboundedFollowing)))
    return both.where(~F.col("_v")).join(ends, "_b").select("x", F.coalesce("_p", "_below").alias("predecessor"), F.coalesce("_s", "_above").alias("successor"))
