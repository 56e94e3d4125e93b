"""Suffix order as a table: ranks, BWT, LCP, and what follows from them.

The order itself comes from ``suffix_sort``; these operators take its rows ``shard, rank, ptr, byte, bwt, head``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.storage import materialize
from textloom.operators import suffix_sort

#: Positions that one task takes in order.
BLOCK = 1 << 16


def suffix_array(docs: DataFrame) -> DataFrame:
    """``shard, rank, ptr, byte, bwt, head``: every suffix of every shard of ``shard, doc_id, text`` in order."""
    text = materialize(suffix_sort.blocks(docs), "text-blocks")
    return suffix_sort.rows(materialize(suffix_sort.pages(text, suffix_sort.ranks(text)), "pages"))


def latest(rows: DataFrame, keys: list[str], by: str, value: str, name: str) -> DataFrame:
    """Adds the last ``value`` that is not null at or before each row in order of ``by``; values must not fall along that order.

    Two levels: blocks of ``BLOCK`` positions, and a row for each block that carries on what the blocks before it reached.
    """
    rows = rows.withColumn("_block", F.floor(F.col(by) / BLOCK))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*keys, "_block").agg(F.max(value).alias("_top")).withColumn("_base", F.max("_top").over(earlier)).drop("_top")
    within = Window.partitionBy(*keys, "_block").orderBy(by).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_in", F.max(value).over(within)).join(base, [*keys, "_block"]).withColumn(name, F.coalesce("_in", "_base")).drop("_in", "_base", "_block")


def lcp(suffixes: DataFrame, text: DataFrame | None = None) -> DataFrame:
    """``shard, rank, lcp``: bytes that each suffix shares with the one before it in order. ``text`` are the streams' blocks, if they are at hand.

    Only where the bytes before the two differ are they compared: by their heads, then by windows that grow from 256 bytes to 16 KB. Elsewhere both
    are followed up by the suffixes one byte further left, which are neighbours as well and share one byte more.
    """
    s = suffixes.select("shard", "rank", "ptr", "bwt", "head")
    before = s.select("shard", (F.col("rank") + 1).alias("rank"), F.col("ptr").alias("q"), F.col("bwt").alias("_w"), F.col("head").alias("_y"))
    pairs = s.join(before, ["shard", "rank"], "left")
    n = common_prefix(F.col("head"), F.col("_y"))
    compared = F.col("q").isNull() | (F.col("bwt") != F.col("_w"))
    more = compared & F.col("q").isNotNull() & (n == F.least(F.octet_length("head"), F.octet_length("_y")))
    pairs = materialize(pairs.select("shard", "rank", "ptr", "q", compared.alias("_c"), F.when(compared, F.when(F.col("q").isNull(), 0).otherwise(n)).cast("long").alias("lcp"), more.alias("_more")), "lcp")
    done = pairs.where("_c and not _more").select("shard", "ptr", "lcp")
    open_ = pairs.where("_more").select("shard", "ptr", "q", "lcp")
    size = 256
    pieces = materialize(_blocks(suffixes) if text is None else _pieces(text), "bytes")
    while not open_.isEmpty():
        windows = _windows(pieces, size)
        step = open_
        for at, name in (("ptr", "x"), ("q", "y")):
            w = windows.select("shard", F.col("_c").alias(f"_c{name}"), F.col("_bytes").alias(f"_{name}"))
            step = step.withColumn(f"_p{name}", F.col(at) + F.col("lcp")).withColumn(f"_c{name}", F.floor(F.col(f"_p{name}") / size)).join(w, ["shard", f"_c{name}"])
            step = step.withColumn(f"_{name}", F.substring(F.col(f"_{name}"), (F.col(f"_p{name}") % size + 1).cast("int"), F.lit(size)))
        step = materialize(step.select("shard", "ptr", "q", "lcp", "_x", "_y").mapInArrow(_compare(size), "shard long, ptr long, q long, lcp long, _more boolean"), "lcp")
        done = done.unionByName(step.where("not _more").select("shard", "ptr", "lcp"))
        open_ = step.where("_more").select("shard", "ptr", "q", "lcp")
        size = min(size * 8, 1 << 14)
    at = pairs.select("shard", "rank", "ptr").join(done.select("shard", "ptr", (F.col("lcp") + F.col("ptr")).alias("_end")), ["shard", "ptr"], "left")
    return latest(at, ["shard"], "ptr", "_end", "_reach").select("shard", "rank", (F.col("_reach") - F.col("ptr")).alias("lcp"))


def _blocks(suffixes: DataFrame) -> DataFrame:
    """``shard, _b, _piece``: the stream in pieces of 256 bytes."""

    def f(t: pa.Table) -> pa.Table:
        shard, b, ptr, byte = (t.column(c).to_numpy() for c in ("shard", "_b", "ptr", "byte"))
        order = np.lexsort((ptr, shard))
        shard, b, byte = shard[order], b[order], byte[order].astype(np.uint8)
        first = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (shard[1:] != shard[:-1])])
        pieces = [byte[lo:hi].tobytes() for lo, hi in zip(first, np.r_[first[1:], len(b)])]
        return pa.table({"shard": pa.array(shard[first]), "_b": pa.array(b[first]), "_piece": pa.array(pieces, pa.binary())})

    rows = suffixes.select("shard", F.floor(F.col("ptr") / 256).alias("_b"), "ptr", "byte", F.floor(F.col("ptr") / BLOCK).alias("_block"))
    return rows.groupBy("shard", "_block").applyInArrow(f, "shard long, _b long, _piece binary")


def _pieces(text: DataFrame) -> DataFrame:
    """The same from blocks of a multiple of 256 bytes."""

    def f(it):
        for batch in it:
            for s, b, n, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "blk", "size", "data"))):
                at = range(0, n, 256)
                first = b * (suffix_sort.BLOCK // 256)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([s] * len(at)), "_b": pa.array([first + i for i in range(len(at))]), "_piece": pa.array([data[1 + o : 1 + min(n, o + 256)] for o in at], pa.binary())})

    return text.mapInArrow(f, "shard long, _b long, _piece binary")


def _windows(pieces: DataFrame, size: int) -> DataFrame:
    """``shard, _c, _bytes``: the ``2 size`` bytes from each multiple of ``size`` on."""
    n = size // 256
    own = pieces.withColumn("_c", F.floor(F.col("_b") / n))
    both = own.unionByName(own.where("_c > 0").withColumn("_c", F.col("_c") - 1))
    joined = F.array_sort(F.collect_list(F.struct("_b", F.hex("_piece").alias("_h"))))
    return both.groupBy("shard", "_c").agg(F.unhex(F.array_join(F.transform(joined, lambda x: x["_h"]), "")).alias("_bytes"))


def _compare(size: int):
    schema = pa.schema([("shard", pa.int64()), ("ptr", pa.int64()), ("q", pa.int64()), ("lcp", pa.int64()), ("_more", pa.bool_())])

    def f(it):
        for t in it:
            shared = []
            for x, y in zip(t.column("_x").to_pylist(), t.column("_y").to_pylist()):
                n = min(len(x), len(y))
                differ = np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)
                at = int(differ.argmax()) if n else 0
                shared.append(at if n and differ[at] else n)
            n = np.array(shared, np.int64)
            yield pa.RecordBatch.from_arrays([t.column("shard"), t.column("ptr"), t.column("q"), pa.array(t.column("lcp").to_numpy() + n), pa.array(n == size)], schema=schema)

    return f


def common_prefix(a: Column, b: Column) -> Column:
    """Bytes at the start that two binaries share: half the hexadecimal digits before the first that differ."""
    ha, hb = F.hex(a), F.hex(b)
    n = F.least(F.octet_length(a), F.octet_length(b))
    at = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), lambda acc, i: F.when((acc == i) & (F.substring(ha, 2 * i + 1, F.lit(2)) == F.substring(hb, 2 * i + 1, F.lit(2))), acc + 1).otherwise(acc))
    return F.when(n > 0, at).otherwise(0)


def lf_mapping(suffixes: DataFrame) -> DataFrame:
    """``shard, rank, lf, psi``: ranks of the suffixes one byte to the left and to the right (cyclic)."""
    size = suffixes.groupBy("shard").agg(F.count(F.lit(1)).alias("_n"))
    s = suffixes.join(F.broadcast(size), "shard").select("shard", "rank", "ptr", "_n")
    at = suffixes.select("shard", F.col("ptr").alias("_p"), F.col("rank").alias("_r"))
    left = s.withColumn("_p", F.pmod(F.col("ptr") - 1, "_n")).join(at, ["shard", "_p"]).select("shard", "rank", F.col("_r").alias("lf"))
    right = s.withColumn("_p", F.pmod(F.col("ptr") + 1, "_n")).join(at, ["shard", "_p"]).select("shard", "rank", F.col("_r").alias("psi"))
    return left.join(right, ["shard", "rank"])


def c_array(symbols: DataFrame, symbol: str = "byte") -> DataFrame:
    """``shard, symbol, n, smaller``: occurrences of each symbol and of all smaller ones. The alphabet's 256 rows a shard are windowed, not the text."""
    n = symbols.groupBy("shard", symbol).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("shard").orderBy(symbol).rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("smaller", F.coalesce(F.sum("n").over(by), F.lit(0)).cast("long"))


def _nearest_smaller(v: list[int]) -> tuple[list[int], list[int]]:
    """Places of the nearest smaller values before and after each one; -1 and len(v) without any."""
    prev, after, stack = [-1] * len(v), [len(v)] * len(v), []
    for k, x in enumerate(v):
        while stack and v[stack[-1]] > x:
            after[stack.pop()] = k
        if stack:
            prev[k] = prev[stack[-1]] if v[stack[-1]] == x else stack[-1]
        stack.append(k)
    return prev, after


def nodes(lcps: DataFrame, block: int = 1 << 16) -> DataFrame:
    """``shard, lb, rb, depth``: inner nodes of the suffix tree, the intervals [lb, rb] of ranks with a common prefix of ``depth`` bytes.

    The interval of a value reaches from the nearest smaller one before it to the nearest smaller one after it. Blocks of ranks are solved in
    parallel. Values whose interval leaves the block, the first and last of each distinct one, are solved together: a few rows for each block.
    """
    schema = "shard long, lb long, rb long, depth long"

    def table(shard: int, rows) -> pa.Table:
        lb, rb, depth = zip(*rows) if rows else ((), (), ())
        return pa.table({"shard": pa.array([shard] * len(lb), pa.int64()), "lb": pa.array(lb, pa.int64()), "rb": pa.array(rb, pa.int64()), "depth": pa.array(depth, pa.int64())})

    def inside(t: pa.Table) -> pa.Table:
        o = np.argsort(t.column("rank").to_numpy())
        at, v = t.column("rank").to_numpy()[o].tolist(), t.column("lcp").to_numpy()[o].tolist()
        if at[0] == 0:
            v[0] = -1  # nothing reaches beyond the first suffix
        prev, after = _nearest_smaller(v)
        within = [p >= 0 and n < len(v) for p, n in zip(prev, after)]
        closed = {(at[prev[k]], at[after[k]] - 1, x) for k, x in enumerate(v) if within[k]}
        left = [k for k, w in enumerate(within) if not w]
        left = [k for i, k in enumerate(left) if i in (0, len(left) - 1) or not v[left[i - 1]] == v[k] == v[left[i + 1]]]
        return table(t.column("shard")[0].as_py(), [*closed, *((at[k], None, v[k]) for k in left)])

    def across(t: pa.Table) -> pa.Table:
        o = np.argsort(t.column("lb").to_numpy())
        at, v = t.column("lb").to_numpy()[o].tolist(), t.column("depth").to_numpy()[o].tolist()
        prev, after = _nearest_smaller(v)
        ends = [*at, at[-1] + 1]
        return table(t.column("shard")[0].as_py(), list({(at[prev[k]], ends[after[k]] - 1, x) for k, x in enumerate(v) if x >= 0}))

    rows = lcps.select("shard", "rank", "lcp", F.floor(F.col("rank") / block).alias("_b"))
    found = materialize(rows.groupBy("shard", "_b").applyInArrow(inside, schema), "nodes")
    return found.where("rb is not null").unionByName(found.where("rb is null").groupBy("shard").applyInArrow(across, schema))


def parents(tree: DataFrame, block: int = 1 << 16) -> DataFrame:
    """``shard, lb, rb, depth, parent_lb, parent_rb, parent_depth``: the smallest interval around each node, null for the root.

    In order of left bounds, a node's parent is the last one before it that reaches as far. Nodes without one in their block of left bounds
    are solved together with those that reach beyond the end of theirs.
    """
    names = ["lb", "rb", "depth", "parent_lb", "parent_rb", "parent_depth"]
    schema = "shard long, " + ", ".join(f"{n} long" for n in names) + ", state int"
    KNOWN, ASKED, REACHES = 0, 1, 2

    def enclose(t: pa.Table, last: bool) -> pa.Table:
        states = t.column("state").to_pylist() if last else [ASKED] * t.num_rows
        rows = sorted(zip(*(t.column(c).to_pylist() for c in names[:3]), states), key=lambda r: (r[0], -r[1], r[2]))
        stack: list[tuple] = []
        out = []
        for r in rows:
            while stack and stack[-1][1] < r[0]:
                stack.pop()
            up = stack[-1][:3] if stack else (None, None, None)
            if r[3] == ASKED:
                out.append((*r[:3], *up, KNOWN if stack or last else ASKED))
            stack.append(r)
        if not last:
            asked = {r[:3] for r in out if r[6] == ASKED}
            out += [(*r[:3], None, None, None, REACHES) for r in stack if r[:3] not in asked]
        cols = {"shard": pa.array([t.column("shard")[0].as_py()] * len(out), pa.int64())} | {n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(names)}
        return pa.table(cols | {"state": pa.array([r[6] for r in out], pa.int32())})

    rows = tree.select("shard", *names[:3], F.floor(F.col("lb") / block).alias("_b"))
    found = materialize(rows.groupBy("shard", "_b").applyInArrow(lambda t: enclose(t, False), schema), "parents")
    rest = found.where(f"state <> {KNOWN}").groupBy("shard").applyInArrow(lambda t: enclose(t, True), schema)
    return found.where(f"state = {KNOWN}").unionByName(rest).drop("state")


def links(tree: DataFrame, psi: DataFrame) -> DataFrame:
    """``shard, lb, rb, depth, link_lb, link_rb``: the node that each inner node becomes without its first byte (suffix link).

    Its interval holds the suffixes that follow those at both ends, one byte less deep. Intervals of one depth are disjoint, so it is the last of
    that depth that begins at or before one of them. The nodes that link to a node are its Weiner links.
    """
    p = psi.select("shard", F.col("rank").alias("lb"), F.col("psi").alias("_at"))
    asked = tree.where("depth > 0").join(p, ["shard", "lb"]).select("shard", (F.col("depth") - 1).alias("_d"), "_at", "lb", "rb", F.lit(None).cast("long").alias("_lb"))
    none = F.lit(None).cast("long")
    starts = tree.select("shard", F.col("depth").alias("_d"), F.col("lb").alias("_at"), none.alias("lb"), none.alias("rb"), F.col("lb").alias("_lb"))
    hit = latest(asked.unionByName(starts), ["shard", "_d"], "_at", "_lb", "link_lb").where("lb is not null")
    to = tree.select("shard", F.col("depth").alias("_d"), F.col("lb").alias("link_lb"), F.col("rb").alias("link_rb"))
    hit = hit.join(to, ["shard", "_d", "link_lb"]).where("_at <= link_rb")
    return hit.select("shard", "lb", "rb", (F.col("_d") + 1).alias("depth"), "link_lb", "link_rb")
