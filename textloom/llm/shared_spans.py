"""Long exact spans that stand in more than one text.

Method: suffix trees over prefix-partitioned suffixes. Sorting every suffix of a corpus would move
each text hundreds of times, so a sparse set of suffixes is taken that still hits every repeat:
the start of the smallest k-gram (by hash) of every stretch of ``min_len`` characters. Equal
stretches have their smallest k-gram at the same offset, so two occurrences of a stretch always
meet in the same prefix group, whose key is that k-gram.

1. Every text yields (prefix, run of stretches that this suffix stands for), about two in
   ``min_len - k`` characters. Prefixes that stand in only one distinct text are leaves of the
   tree's top and are dropped before any text moves.
2. The suffixes left get their own characters and those before them, and are gathered by prefix
   into groups that fit in memory. In each group two trees are built, one over what follows the
   anchor and one, backwards, over what precedes it: sorted suffixes plus the longest common
   prefixes of neighbours, which hold every internal node. A stretch that starts ``l`` characters
   before the anchor is repeated exactly if its node of depth ``min_len - l`` in the first tree
   and its node of depth ``l`` in the second have leaves of two different texts in common.
3. A prefix of more suffixes than a group may hold is lengthened to the whole stretch. Such a group
   holds equal stretches only, so the smallest and largest text decide; that aggregates before
   the shuffle, however hot the prefix is. (It compares 128-bit hashes instead of characters.)

Exact copies of a text count as one text in the trees and are whole spans by themselves.

Defined results: null and short texts and rows without ``doc_id`` have no spans; an empty table gives no rows; rows that repeat
a ``doc_id`` with the same text are one document; further columns are ignored. Positions count code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions.storage import materialize
from textloom.functions.vectext import U, code_points, mix, powers, prefix_hash
from textloom.llm.common import buckets, per_chunk, pick, runs

#: Suffixes of one prefix beyond which the prefix is lengthened.
GROUP_ROWS = 20_000
#: Positions that a packed (hash, position) pair can address; longer texts are cut into overlapping pieces.
PIECE = 1 << 20

_ANCHORS = pa.schema([("key", pa.int64()), ("th", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def anchors_of(cp: np.ndarray, doc: np.ndarray, k: int, length: int) -> tuple[np.ndarray, ...]:
    """Of joined texts, for each run of stretches with the same smallest k-gram: its hash, its position, first and last stretch.

    ``doc`` numbers the text of every code point; stretches that cross a border are left out.
    """
    n = len(cp) - length + 1
    if n <= 0:
        return (np.zeros(0, U),) + (np.zeros(0, np.int64),) * 3
    p = prefix_hash(cp)
    m = len(cp) - k + 1
    h = mix((p[k:] - p[:m]) * powers(len(p))[1][:m])
    low = U(PIECE - 1)
    packed = (h & ~low) | np.arange(m, dtype=U)
    width, best, size = length - k + 1, packed, 1
    while size * 2 <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = np.minimum(best[:n], best[width - size : width - size + n])
    at = (best[:n] & low).astype(np.int64)
    starts = np.flatnonzero(doc[:n] == doc[length - 1 :])
    if not len(starts):
        return (np.zeros(0, U),) + (np.zeros(0, np.int64),) * 3
    at = at[starts]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (np.diff(starts) > 1)])
    last = np.r_[new[1:], len(starts)] - 1
    return h[at[new]], at[new], starts[new], starts[last]


def _pieces(texts: list[str], length: int):
    """(index of text, offset, piece) of at most PIECE/2 characters; pieces of one text overlap by length-1."""
    most = PIECE // 2
    for i, t in enumerate(texts):
        for o in range(0, max(1, len(t) - length + 1), most - length + 1) if len(t) > most else (0,):
            yield i, o, t[o : o + most] if len(t) > most else t


def _anchor_rows(k: int, length: int):
    def f(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = batch.column("text").to_pylist()
        ids, th = batch.column("doc_id").to_numpy(), batch.column("th").to_numpy()
        cols: list[list[np.ndarray]] = [[] for _ in range(6)]
        group: list[tuple[int, int, str]] = []
        size = 0

        def flush() -> None:
            nonlocal group, size
            if group:
                lens = np.fromiter((len(g[2]) for g in group), np.int64, len(group))
                base = np.r_[0, np.cumsum(lens)[:-1]]
                key, at, lo, hi = anchors_of(code_points("".join(g[2] for g in group)), np.repeat(np.arange(len(group)), lens), k, length)
                if len(key):
                    g = np.searchsorted(base, lo, "right") - 1
                    row = np.fromiter((x[0] for x in group), np.int64, len(group))[g]
                    shift = np.fromiter((x[1] for x in group), np.int64, len(group))[g] - base[g]
                    for c, x in zip(cols, (key.view(np.int64), th[row], ids[row], at + shift, lo + shift, hi + shift)):
                        c.append(x)
            group, size = [], 0

        for piece in _pieces(texts, length):
            if len(piece[2]) < length:
                continue
            if size and size + len(piece[2]) > PIECE // 2:
                flush()
            group.append(piece)
            size += len(piece[2])
        flush()
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], schema=_ANCHORS) if cols[0] else None

    return per_chunk(f)


def _context_rows(length: int):
    """Cuts what surrounds each anchor out of its text."""
    schema = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("stretch", pa.string())])

    def f(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts, ids, found = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("found").to_pylist()
        rows: list[tuple] = []
        for t, d, fs in zip(texts, ids, found):
            rows += [(x["bucket"], x["key"], d, x["at"], x["lo"], x["hi"], t[x["lo"] : x["hi"] + length]) for x in fs]
        return pa.RecordBatch.from_arrays([pa.array(c, y.type) for c, y in zip(zip(*rows), schema)], schema=schema) if rows else None

    return per_chunk(f)


def _matrix(parts: list[str], width: int) -> np.ndarray:
    """Code points plus one, a row for each part, padded with zeros."""
    return code_points("".join(p[:width].ljust(width, "\0") for p in parts)).reshape(len(parts), width)


def _tree(keys: np.ndarray, parts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves in order of (key, part), and the depth of the lowest common ancestor of each with the one before; -1 between keys."""
    ranked = keys.tolist()
    order = np.array(sorted(range(len(parts)), key=lambda i: (ranked[i], parts[i])), np.int64)
    depth = np.full(len(parts), -1, np.int64)
    if len(parts) > 1:
        m = _matrix([parts[i] for i in order.tolist()], width)
        for lo in range(0, len(parts) - 1, 4096):
            a = m[lo : lo + 4097]
            differ = a[1:] != a[:-1]
            depth[lo + 1 : lo + 1 + len(differ)] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        lens = np.fromiter((len(parts[i]) for i in order.tolist()), np.int64, len(parts))
        depth[1:] = np.minimum(depth[1:], np.minimum(lens[1:], lens[:-1]))
        k = keys[order]
        depth[1:][k[1:] != k[:-1]] = -1
    return order, depth


def repeated_stretches(keys, docs, at, lo, hi, stretch, k: int, length: int) -> tuple[np.ndarray, ...]:
    """Rows, first and one past the last start of the runs of stretches that stand in two documents; all of one or more prefix groups."""
    m = len(keys)
    fo, fd = _tree(keys, [s[a - b :] for s, a, b in zip(stretch, at.tolist(), lo.tolist())], length)
    bo, bd = _tree(keys, [s[: a - b][::-1] for s, a, b in zip(stretch, at.tolist(), lo.tolist())], length - k)
    most, least = at - lo, at - hi
    shared = np.zeros((m, length - k + 1), bool)
    fnode, bnode = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for before in range(int(least.min()), int(most.max()) + 1):
        here = np.flatnonzero((least <= before) & (before <= most))
        if len(here) < 2:
            continue
        fnode[fo] = np.cumsum(fd < length - before)
        bnode[bo] = np.cumsum(bd < before)
        node = fnode[here] * (m + 1) + bnode[here]
        o = np.argsort(node, kind="stable")
        s, d = node[o], docs[here][o]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
        shared[here[o], before] = np.repeat(several, np.diff(np.r_[first, len(s)]))
    r, a, b = runs(shared)
    return r, at[r] - b + 1, at[r] - a + 1


def _tree_rows(k: int, length: int):
    def f(t: pa.Table) -> pa.Table:
        keys, docs, at, lo, hi = (t.column(c).to_numpy() for c in ("key", "doc_id", "at", "lo", "hi"))
        r, a, b = repeated_stretches(keys, docs, at, lo, hi, t.column("stretch").to_pylist(), k, length)
        return pa.table({"doc_id": docs[r], "lo": a, "hi": b + length - 1})

    return f


def _long_prefix_rows(length: int):
    """Each stretch by itself under the hash of all its characters."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int64())])

    def f(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for d, lo, s in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lo", "stretch"))):
            cp = code_points(s)
            n = len(cp) - length + 1
            inv = powers(len(cp) + 1)[1]
            for c, salted in zip(cols, (cp, cp ^ np.uint32(0x5BD1E995))):
                p = prefix_hash(salted)
                c.append(mix((p[length:] - p[:n]) * inv[:n]).view(np.int64))
            cols[2].append(np.full(n, d))
            cols[3].append(np.arange(lo, lo + n))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], schema=schema) if cols[0] else None

    return per_chunk(f, "stretch", 1 << 16)


def _merge(df: DataFrame) -> DataFrame:
    """Union of the intervals [lo, hi) of each document."""
    by = Window.partitionBy("doc_id").orderBy("lo", "hi")
    reach = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = df.withColumn("new", F.when(F.col("lo") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "island").agg(F.min("lo").alias("span_start"), F.max("hi").alias("span_end")).drop("island")


def shared_spans(docs: DataFrame, min_len: int = 200, k: int = 60, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc_id, span_start, span_end`` of the longest stretches of shared characters of every document.

    ``docs`` has ``doc_id BIGINT`` and ``text STRING``. ``k`` is the least length of a prefix.
    """
    if not 0 < k < min_len:
        raise ValueError("0 < k < min_len")
    docs = pick(docs, "doc_id", "text").where((F.length("text") >= min_len) & F.col("doc_id").isNotNull()).withColumns({"th": F.xxhash64("text"), "th2": F.xxhash64(F.lit(1), "text")})
    anchors = docs.select("doc_id", "th", "text").mapInArrow(_anchor_rows(k, min_len), "key long, th long, doc_id long, at long, lo long, hi long")
    repeated = anchors.groupBy("key").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b").select("key")
    # One row for each distinct text: of copies, the smallest document stands for all.
    found = materialize(anchors.join(repeated, "key", "left_semi").groupBy("key", "th", "at", "lo", "hi").agg(F.min("doc_id").alias("doc_id")).drop("th"), "anchors")
    sizes = found.groupBy("key").count()
    total = found.count()
    hot = materialize(sizes.where(F.col("count") > group_rows).select("key", F.lit(True).alias("hot")), "hot-prefixes")
    any_hot = bool(hot.take(1))
    if any_hot:
        found = found.join(hot, "key", "left")
    else:
        found = found.withColumn("hot", F.lit(None).cast("boolean"))
    found = found.withColumn("bucket", F.when(F.col("hot"), -1).otherwise(F.pmod(F.hash("key"), F.lit(buckets(total)))).cast("int"))
    per_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("bucket", "key", "at", "lo", "hi")).alias("found"))
    around = docs.select("doc_id", "text").join(per_doc, "doc_id").mapInArrow(_context_rows(min_len), "bucket int, key long, doc_id long, at long, lo long, hi long, stretch string")
    if any_hot:
        around = materialize(around, "suffixes")
    parts = around.where("bucket >= 0").groupBy("bucket").applyInArrow(_tree_rows(k, min_len), "doc_id long, lo long, hi long")
    if any_hot:
        whole = around.where("bucket < 0").select("doc_id", "lo", "stretch").mapInArrow(_long_prefix_rows(min_len), "h1 long, h2 long, doc_id long, lo long")
        several = whole.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("h1", "h2")
        parts = parts.unionByName(whole.join(several, ["h1", "h2"], "left_semi").select("doc_id", "lo", (F.col("lo") + min_len).alias("hi")))
    copies = docs.select("doc_id", "th", "th2", F.length("text").cast("long").alias("n")).groupBy("th", "th2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b")
    copied = docs.select("doc_id", "th", "th2", F.length("text").cast("long").alias("hi")).join(copies.select("th", "th2"), ["th", "th2"], "left_semi").select("doc_id", F.lit(0).cast("long").alias("lo"), "hi")
    return _merge(parts.select("doc_id", "lo", "hi").unionByName(copied))
