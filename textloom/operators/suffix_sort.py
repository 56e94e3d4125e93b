"""Suffix sorting of whole corpora in packed blocks.

A stream per shard is ``0xFF text 0xFF text ... 0xFA``; no byte of UTF-8 is as large as these two, so the order of suffixes is exact
across documents. Rows of the tables here are blocks of about a million positions held as binary arrays: the JVM moves few large rows, and
NumPy orders them.

1. Suffixes are ordered by their first ``HEAD`` bytes, and each gets the number of smaller ones as its rank.
2. In each round, those whose rank is shared are ordered by (rank, rank of the suffix ``length`` further on), which doubles the length compared; the
   rest is left alone. Long copies need log2(length / HEAD) rounds.

Both are one step, ``_place``: keys are cut into ranges at sampled splitters, each range is ordered in one task, and ranks are
numbers of rows in the ranges before, plus the place within. A key that makes up more than a range is a splitter twice; its rows are
equal, so they need no order and are dealt to as many tasks as wanted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.storage import discard, materialize
from textloom.operators.corpus import places

U = np.uint64
HEAD = 16
#: Positions in a block, rows in a range of keys, suffixes in a page of the result, keys sampled for each range, and ranges at most.
BLOCK, RANGE, PAGE, SAMPLES, RANGES = 1 << 20, 1 << 20, 1 << 16, 32, 1 << 17
SEP, END = 0xFF, 0xFA

_BLOCKS = "shard long, blk long, size long, data binary"
_STATE = "shard long, blk long, size long, rank binary, open binary, n_open long"
_PIECE = "p int, salt int, shard long, blk long, k1 binary, k2 binary, pos binary"
_PLACED = "p int, salt int, shard long, blk long, pos binary, old binary, place binary, shared binary, n long, low long, high long, begin long"
_PAGES = "shard long, page long, n long, first_key long, next_key long, ptr binary, bwt binary, head binary"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """By keys into the session's number of partitions. A group is a block of megabytes, and work for a second: groups must not be joined because their bytes are few."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys)


def _bin(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _table(spec: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in spec.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, cols)})


def _batches(spec: str, rows: list[tuple]):
    yield from _table(spec, rows).to_batches()


def blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``shard, blk, size, data``: the streams in blocks; ``data`` has one byte more before (cyclic) and ``HEAD`` more after (zeros beyond the end)."""
    docs = docs.where("text is not null").select(F.col("shard").cast("long").alias("shard"), "doc_id", "text")
    at = places(docs)
    last = at.groupBy("shard").agg(F.max("local_doc_ix").alias("_last"))
    at = at.join(F.broadcast(last), "shard").select("shard", "doc_id", "data_offset", (F.col("local_doc_ix") == F.col("_last")).alias("ends"))

    def cut(it):
        for batch in it:
            out = []
            for shard, at, text, ends in zip(*(batch.column(c).to_pylist() for c in ("shard", "data_offset", "text", "ends"))):
                data = bytes([SEP]) + text.encode("utf-8", "surrogatepass") + (bytes([END]) if ends else b"")
                stop = at + len(data)
                for b in range(max(0, (at - HEAD) // block), (stop - 1) // block + 1 + (stop % block == 0)):
                    lo, hi = max(at, b * block - 1), min(stop, (b + 1) * block + HEAD)
                    if lo < hi:
                        out.append((shard, b, lo - b * block, data[lo - at : hi - at]))
            yield from _batches("shard long, blk long, at long, part binary", out)

    def join(t: pa.Table) -> pa.Table:
        at, parts = t.column("at").to_numpy(), t.column("part").to_pylist()
        order = np.argsort(at)
        data = b"".join(parts[i] for i in order)
        blk = t.column("blk")[0].as_py()
        if at.min() >= 0:  # only the first block has nothing before it: the stream ends where it begins
            data = bytes([END]) + data
        size = min(block, len(data) - 1)
        return _table(_BLOCKS, [(t.column("shard")[0].as_py(), blk, size, data.ljust(size + 1 + HEAD, b"\0"))] if size > 0 else [])

    parts = docs.join(at, ["shard", "doc_id"]).mapInArrow(cut, "shard long, blk long, at long, part binary")
    return _dealt(parts, "shard", "blk").groupBy("shard", "blk").applyInArrow(join, _BLOCKS)


def _heads(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(data, np.uint8)[1:]
    h = np.zeros(size + 8, U)
    for i in range(8):
        h = h << U(8) | b[i : i + size + 8].astype(U)
    return h[:size], h[8 : 8 + size]


class _Splitters:
    """Borders between the ranges of keys (k1, k2) of each shard. Range 2 j + 1 holds the keys equal to border j, if that is hot, and 2 j those below it."""

    def __init__(self, shard: np.ndarray, k1: np.ndarray, k2: np.ndarray, step: int):
        self.of: dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.n = 0
        for s in np.unique(shard).tolist():
            mine = np.flatnonzero(shard == s)
            order = mine[np.lexsort((k2[mine], k1[mine]))][step - 1 :: step]
            a, b = k1[order], k2[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
            times = np.diff(np.r_[np.flatnonzero(new), len(a)])
            self.of[s] = (self.n, a[new], b[new], times > 1)
            self.n += 2 * int(new.sum()) + 2  # even, as odd ranges are those of hot keys

    def cut(self, shard: int, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first row, range, whether it is a hot key's) of the runs of one range in sorted keys."""
        none = np.zeros(0, np.int64)
        if not len(k1):
            return none, none, none.astype(bool)
        first, a, b, hot = self.of.get(shard, (self.n, none.astype(U), none.astype(U), none.astype(bool)))
        # Of each border, the first key that is not below it, and the first above it.
        left, right = np.searchsorted(k1, a, "left"), np.searchsorted(k1, a, "right")
        for j in np.flatnonzero(left != right).tolist():
            lo, hi = left[j], right[j]
            left[j], right[j] = lo + np.searchsorted(k2[lo:hi], b[j], "left"), lo + np.searchsorted(k2[lo:hi], b[j], "right")
        starts = np.unique(np.r_[0, left[hot], right])
        starts = starts[starts < len(k1)]
        at = np.searchsorted(right, starts, "right")
        inside = np.minimum(at, max(0, len(a) - 1))
        equal = (at < len(a)) & hot[inside] & (left[inside] <= starts) if len(a) else np.zeros(len(starts), bool)
        return starts, first + 2 * at + equal, equal


def _place(keys: DataFrame, n: int, range_rows: int, grouped: bool, made: list[str]) -> tuple[DataFrame, dict[tuple[int, int], tuple[int, int]]]:
    """``keys`` has blocks ``shard, blk, k1, k2, pos`` of keys (two unsigned words). Returns pieces with each position's place in its range.

    With ``grouped``, places are counted from the first row of the same k1 in the range. For each shard and range there is (the rows in ranges before it,
    those of them that have the k1 with which it begins).
    """
    spark, label = keys.sparkSession, "places"
    ranges = min(RANGES, -(-n // range_rows))
    if ranges > 1:
        every = max(1, n // (ranges * SAMPLES))

        def sample(it):
            for batch in it:
                out = []
                for s, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("shard", "blk", "k1", "k2"))):
                    k1, k2 = np.frombuffer(x, U), np.frombuffer(y, U)
                    at = np.random.default_rng([s & 0xFFFF, b & 0xFFFFFFFF, len(k1)]).integers(0, max(1, len(k1)), -(-len(k1) // every)) if len(k1) else []
                    out += [(s, int(k1[i].astype(np.int64)), int(k2[i].astype(np.int64))) for i in at]
                yield from _batches("shard long, k1 long, k2 long", out)

        # About ranges x SAMPLES keys of 16 bytes, at most RANGES x SAMPLES and one for each block.
        got = keys.select("shard", "blk", "k1", "k2").mapInArrow(sample, "shard long, k1 long, k2 long").toPandas()
        splitters = _Splitters(got["shard"].to_numpy(), got["k1"].to_numpy().view(U), got["k2"].to_numpy().view(U), SAMPLES)
    else:
        splitters = _Splitters(np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U), 1)
    whole = spark.sparkContext.broadcast(splitters)

    def cut(it):
        for batch in it:
            for s, b, x, y, z in zip(*(batch.column(c).to_pylist() for c in ("shard", "blk", "k1", "k2", "pos"))):
                k1, k2, pos = np.frombuffer(x, U), np.frombuffer(y, U), np.frombuffer(z, np.uint32)
                order = np.lexsort((k2, k1))
                k1, k2, pos = k1[order], k2[order], pos[order]
                starts, p, hot = whole.value.cut(s, k1, k2)
                out = []
                for lo, hi, i, h in zip(starts.tolist(), [*starts[1:].tolist(), len(k1)], p.tolist(), hot.tolist()):
                    out.append((i, b & 0x7FFFFFFF if h else 0, s, b, _bin(k1[lo:hi]), _bin(k2[lo:hi]), _bin(pos[lo:hi])))
                yield from _batches(_PIECE, out)

    def order(t: pa.Table) -> pa.Table:
        p, salt = t.column("p")[0].as_py(), t.column("salt")[0].as_py()
        out = []
        shards = t.column("shard").to_numpy()
        for s in np.unique(shards).tolist():
            rows = np.flatnonzero(shards == s).tolist()
            blk, pos = ([t.column(c)[i].as_py() for i in rows] for c in ("blk", "pos"))
            x, y = ([np.frombuffer(t.column(c)[i].as_py(), U) for i in rows] for c in ("k1", "k2"))
            sizes = [len(v) for v in x]
            k1, k2 = np.concatenate(x), np.concatenate(y)
            by = np.lexsort((k2, k1))
            a, b = k1[by], k2[by]
            fresh = np.r_[True, a[1:] != a[:-1]]
            first = np.flatnonzero(fresh | np.r_[True, b[1:] != b[:-1]])
            size = np.diff(np.r_[first, len(a)])
            begin = np.flatnonzero(fresh)
            base = np.repeat(begin, np.diff(np.r_[begin, len(a)])) if grouped else 0
            place, shared = np.empty(len(a), np.int64), np.empty(len(a), np.uint8)
            place[by] = np.repeat(first, size) - base
            # A hot key's rows are equal to those in other tasks.
            shared[by] = 1 if p & 1 else np.repeat(size > 1, size)
            cuts = np.cumsum([0, *sizes]).tolist()
            ends = (int(a[0].astype(np.int64)), int(a[-1].astype(np.int64)), int(begin[-1]))
            for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
                out.append((p, salt, s, blk[k], pos[k], _bin(k1[lo:hi]), _bin(place[lo:hi]), _bin(shared[lo:hi]), hi - lo, *ends))
        return _table(_PLACED, out)

    placed = materialize(_dealt(keys.mapInArrow(cut, _PIECE), "p", "salt").groupBy("p", "salt").applyInArrow(order, _PLACED), label, made)
    # A row for each range.
    sizes = placed.groupBy("shard", "p").agg(F.sum("n").alias("n"), F.max("low").alias("low"), F.max("high").alias("high"), F.max("begin").alias("begin")).orderBy("shard", "p").collect()
    whole.unpersist()
    spans: dict[tuple[int, int], tuple[int, int]] = {}
    total: dict[int, int] = {}
    last: dict[int, tuple[int, int]] = {}  # the largest k1 of a shard so far, and the place where it began
    for r in sizes:
        s, before = r["shard"], total.get(r["shard"], 0)
        begun = last[s][1] if s in last and last[s][0] == r["low"] else before
        spans[s, r["p"]] = (before, before - begun)
        last[s] = (r["high"], begun if r["high"] == r["low"] else before + r["begin"])
        total[s] = before + r["n"]
    return placed, spans


def _keys_of_heads(it):
    for batch in it:
        out = []
        for s, b, n, d in zip(*(batch.column(c).to_pylist() for c in ("shard", "blk", "size", "data"))):
            k1, k2 = _heads(d, n)
            out.append((s, b, _bin(k1), _bin(k2), _bin(np.arange(n, dtype=np.uint32))))
        yield from _batches("shard long, blk long, k1 binary, k2 binary, pos binary", out)


def _first_state(placed: DataFrame, spans: dict) -> DataFrame:
    def f(t: pa.Table) -> pa.Table:
        s, b = t.column("shard")[0].as_py(), t.column("blk")[0].as_py()
        n = sum(t.column("n").to_pylist())
        rank, open_ = np.empty(n, np.int64), np.zeros(n, np.uint8)
        for p, pos, place, shared in zip(*(t.column(c).to_pylist() for c in ("p", "pos", "place", "shared"))):
            at = np.frombuffer(pos, np.uint32)
            rank[at] = np.frombuffer(place, np.int64) + spans[s, p][0]
            open_[at] = np.frombuffer(shared, np.uint8)
        return _table(_STATE, [(s, b, n, _bin(rank), _bin(open_), int(open_.sum()))])

    return _dealt(placed.select("shard", "blk", "n", "p", "pos", "place", "shared"), "shard", "blk").groupBy("shard", "blk").applyInArrow(f, _STATE)


def _shifted(state: DataFrame, length: int, block: int) -> DataFrame:
    """Blocks of keys (rank, rank of the suffix ``length`` further on) of the positions that are open."""
    jump, rest = divmod(length, block)

    def send(it):
        for batch in it:
            out = []
            for s, b, n, rank, open_, k in zip(*(batch.column(c).to_pylist() for c in ("shard", "blk", "size", "rank", "open", "n_open"))):
                if k:
                    out.append((s, b, -1, rank, open_))
                if b >= jump and rest < n:
                    out.append((s, b - jump, 0, rank[8 * rest :], None))
                if b > jump and rest:
                    out.append((s, b - jump - 1, block - rest, rank[: 8 * rest], None))
            yield from _batches("shard long, blk long, at long, rank binary, open binary", out)

    def meet(t: pa.Table) -> pa.Table:
        at = t.column("at").to_pylist()
        if -1 not in at:
            return _table("shard long, blk long, k1 binary, k2 binary, pos binary", [])
        own = at.index(-1)
        rank = np.frombuffer(t.column("rank")[own].as_py(), np.int64)
        pos = np.flatnonzero(np.frombuffer(t.column("open")[own].as_py(), np.uint8))
        further = np.full(len(rank), -1, np.int64)
        for i, a in enumerate(at):
            if a >= 0:
                more = np.frombuffer(t.column("rank")[i].as_py(), np.int64)[: max(0, len(rank) - a)]
                further[a : a + len(more)] = more
        row = (t.column("shard")[0].as_py(), t.column("blk")[0].as_py(), _bin(rank[pos].astype(U)), _bin((further[pos] + 1).astype(U)), _bin(pos.astype(np.uint32)))
        return _table("shard long, blk long, k1 binary, k2 binary, pos binary", [row])

    sent = state.mapInArrow(send, "shard long, blk long, at long, rank binary, open binary")
    return _dealt(sent, "shard", "blk").groupBy("shard", "blk").applyInArrow(meet, "shard long, blk long, k1 binary, k2 binary, pos binary")


def _next_state(state: DataFrame, placed: DataFrame, spans: dict) -> DataFrame:
    """Ranks after a round: the shared rank plus the rows of that rank with smaller continuations."""

    def f(key, st: pa.Table, pieces: pa.Table) -> pa.Table:
        if not pieces.num_rows:
            return st.select(_STATE_COLUMNS)
        s, b, n = (st.column(c)[0].as_py() for c in ("shard", "blk", "size"))
        rank, open_ = (np.frombuffer(st.column(c)[0].as_py(), kind).copy() for c, kind in (("rank", np.int64), ("open", np.uint8)))
        for p, pos, old, place, shared, low in zip(*(pieces.column(c).to_pylist() for c in ("p", "pos", "old", "place", "shared", "low"))):
            at, r = np.frombuffer(pos, np.uint32), np.frombuffer(old, np.int64)
            # The rank with which a range begins may have rows in ranges before.
            rank[at] = r + np.frombuffer(place, np.int64) + np.where(r == low, spans[s, p][1], 0)
            open_[at] = np.frombuffer(shared, np.uint8)
        return _table(_STATE, [(s, b, n, _bin(rank), _bin(open_), int(open_.sum()))])

    pieces = placed.select("shard", "blk", "p", "pos", "old", "place", "shared", "low")
    return _dealt(state, "shard", "blk").groupBy("shard", "blk").cogroup(_dealt(pieces, "shard", "blk").groupBy("shard", "blk")).applyInArrow(f, _STATE)


_STATE_COLUMNS = [f.split()[0] for f in _STATE.split(", ")]


def ranks(text: DataFrame, block: int = BLOCK, range_rows: int = RANGE) -> DataFrame:
    """``shard, blk, size, rank, open, n_open``: the rank of every suffix of the streams in ``text`` (see ``blocks``)."""
    n = text.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    made: list[str] = []
    placed, spans = _place(text.mapInArrow(_keys_of_heads, "shard long, blk long, k1 binary, k2 binary, pos binary"), n, range_rows, False, made)
    state = materialize(_first_state(placed, spans), "ranks", made)
    length = HEAD
    while True:
        # Only the ranks reached last are read from here on.
        discard(made[:-1])
        made = made[-1:]
        left = state.agg(F.coalesce(F.sum("n_open"), F.lit(0)).alias("n")).first()["n"]
        if not left:
            return state
        placed, spans = _place(_shifted(state, length, block), left, range_rows, True, made)
        state = materialize(_next_state(state, placed, spans), "ranks", made)
        length *= 2


def key_of(head: bytes) -> int:
    """The first eight bytes as a signed number of the same order."""
    return int.from_bytes(head[:8].ljust(8, b"\0"), "big") - (1 << 63)


def pages(text: DataFrame, state: DataFrame, block: int = BLOCK, page: int = PAGE) -> DataFrame:
    """``shard, page, n, first_key, next_key, ptr, bwt, head``: suffixes in order, ``page`` of them a row: arrays of 64-bit pointers, bytes before, and ``HEAD`` bytes each.

    ``first_key`` and ``next_key`` are the first eight bytes of the page's first suffix and of the one after its last, as numbers of the same order; below the first
    page and after the last one they are the least and the largest number, so every key lies in a page.
    """
    spec = "shard long, page long, rank binary, ptr binary, bwt binary, head binary"

    def cut(key, t: pa.Table, st: pa.Table) -> pa.Table:
        if not t.num_rows or not st.num_rows:
            return _table(spec, [])
        s, b, n = (t.column(c)[0].as_py() for c in ("shard", "blk", "size"))
        data = np.frombuffer(t.column("data")[0].as_py(), np.uint8)
        rank = np.frombuffer(st.column("rank")[0].as_py(), np.int64)
        order = np.argsort(rank, kind="stable")
        r, out = rank[order], []
        windows = np.lib.stride_tricks.sliding_window_view(data[1:], HEAD)
        starts = np.flatnonzero(np.r_[True, r[1:] // page != r[:-1] // page])
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), n]):
            at = order[lo:hi]
            out.append((s, int(r[lo] // page), _bin((r[lo:hi] % page).astype(np.uint32)), _bin(at + b * block), _bin(data[at]), _bin(windows[at])))
            if r[lo] % page == 0 and r[lo]:  # the page before ends at this suffix
                out.append((s, int(r[lo] // page) - 1, _bin(np.array([page], np.uint32)), b"", b"", _bin(windows[at[0]])))
        return _table(spec, out)

    def join(t: pa.Table) -> pa.Table:
        get = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()])
        rank, heads = get("rank", np.uint32), get("head", np.uint8).reshape(-1, HEAD)
        after, inside = heads[rank == page], rank < page
        order = np.argsort(rank[inside])
        heads, number = heads[inside][order], t.column("page")[0].as_py()
        ends = (key_of(heads[0].tobytes()) if number else LEAST, key_of(after[0].tobytes()) if len(after) else MOST)
        return _table(_PAGES, [(t.column("shard")[0].as_py(), number, len(order), *ends, _bin(get("ptr", np.int64)[order]), _bin(get("bwt", np.uint8)[order]), _bin(heads))])

    parts = _dealt(text, "shard", "blk").groupBy("shard", "blk").cogroup(_dealt(state, "shard", "blk").groupBy("shard", "blk")).applyInArrow(cut, spec)
    return _dealt(parts, "shard", "page").groupBy("shard", "page").applyInArrow(join, _PAGES)


def rows(paged: DataFrame, page: int = PAGE) -> DataFrame:
    """``shard, rank, ptr, byte, bwt, head``: one row for each suffix."""
    schema = pa.schema([("shard", pa.int64()), ("rank", pa.int64()), ("ptr", pa.int64()), ("byte", pa.int32()), ("bwt", pa.int32()), ("head", pa.binary())])

    def f(it):
        for batch in it:
            for s, p, n, ptr, bwt, head in zip(*(batch.column(c).to_pylist() for c in ("shard", "page", "n", "ptr", "bwt", "head"))):
                h = np.frombuffer(head, np.uint8).reshape(n, HEAD)
                heads = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, HEAD * n + 1, HEAD, dtype=np.int32)), pa.py_buffer(head)])
                at = np.arange(n) + p * page
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, s)), pa.array(at), pa.array(np.frombuffer(ptr, np.int64)), pa.array(h[:, 0].astype(np.int32)), pa.array(np.frombuffer(bwt, np.uint8).astype(np.int32)), heads], schema=schema)

    return paged.mapInArrow(f, "shard long, rank long, ptr long, byte int, bwt int, head binary")
