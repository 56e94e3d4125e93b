"""count, find and locate over a corpus of ``shard, doc_id, text``.

A single needle is an expression in the scan (see ``needle``). Many needles are answered together in one pass: each
batch's suffixes are ordered by their first eight bytes once, and every needle is looked up by binary search.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.needle import MOST_BYTES, occurrences, smaller_suffixes

#: Bytes of needles that may go to the driver at once; more are taken in several passes.
NEEDLE_BYTES = 1 << 20
#: Bytes of text ordered together.
BLOCK = 1 << 19


def count(docs: DataFrame, needle: str) -> DataFrame:
    """One row ``count``; for the empty needle the size of the index (bytes, a separator for each document, a terminator for each shard)."""
    if not needle:
        return docs.agg((F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)) + F.count_distinct("shard")).cast("long").alias("count"))
    return docs.agg(F.coalesce(F.sum(occurrences(F.col("text"), needle)), F.lit(0)).cast("long").alias("count"))


def find(docs: DataFrame, needle: str) -> DataFrame:
    """``shard, lo, hi``: the rank interval of the needle among the suffixes of each shard; long needles are compared byte by byte (``find_many``)."""
    if len(needle.encode("utf-8", "surrogatepass")) > MOST_BYTES:
        one = docs.sparkSession.createDataFrame([(0, needle)], "query_id long, query string")
        return find_many(docs, one).select(F.col("shard").cast(docs.schema["shard"].dataType).alias("shard"), "lo", "hi")
    lo = F.lit(0).cast("long") if not needle else F.sum(smaller_suffixes(F.col("text"), needle))
    n = F.sum(F.octet_length("text") + 1).cast("long") + 1 if not needle else F.sum(occurrences(F.col("text"), needle))
    per = docs.where("text is not null").groupBy("shard").agg(lo.alias("lo"), n.alias("n"))
    return per.select("shard", F.col("lo").cast("long").alias("lo"), (F.col("lo") + F.col("n")).cast("long").alias("hi"))


def as_result(segments: DataFrame, *keys: str) -> DataFrame:
    """``cnt`` and ``segment_by_shard`` (in order of shard) from ``shard, lo, hi``; the shards of an index are few."""
    out = segments.groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).cast("long").alias("cnt"), F.array_sort(F.collect_list(F.struct("shard", "lo", "hi"))).alias("s"))
    return out.select(*keys, "cnt", F.transform("s", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))).alias("segment_by_shard"))


class Block:
    """The suffixes of some documents, ordered by their first eight bytes.

    Each document is preceded by the separator 0xFF, which cannot occur in UTF-8 and is above all its bytes, so no match
    crosses a border and a suffix cut short by it compares as it does in the whole shard.
    """

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\xff" + b"\xff".join(texts) + b"\xff" * 8, np.uint8)
        n = len(self.data) - 8
        self.starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1] + 1
        head = np.zeros(n, np.uint64)
        for i in range(8):
            head <<= np.uint64(8)
            head |= self.data[i : i + n]
        self.order = np.argsort(head, kind="stable")
        self.head = head[self.order]

    def interval(self, needle: bytes) -> tuple[int, np.ndarray]:
        """(suffixes smaller than the needle, positions where it stands)."""
        first = needle[:8]
        lo = np.searchsorted(self.head, np.uint64(int.from_bytes(first.ljust(8, b"\0"), "big")), "left")
        hi = np.searchsorted(self.head, np.uint64(int.from_bytes(first.ljust(8, b"\xff"), "big")), "right")
        at = self.order[lo:hi]
        rest, offset = needle[8:], 8
        while rest and len(at):
            # Only suffixes still equal to the needle are looked at; those that fall below it are counted.
            byte = self.data[np.minimum(at + offset, len(self.data) - 1)]
            lo += int((byte < rest[0]).sum())
            at = at[byte == rest[0]]
            rest, offset = rest[1:], offset + 1
        return int(lo), at


def _blocks(it, columns: tuple[str, ...]):
    """Rows of one shard, about ``BLOCK`` bytes of text at a time; the text as bytes comes last."""
    for batch in it:
        # Neighbouring documents lie in different shards; brought together, they make few large blocks.
        rows = sorted(zip(*(batch.column(c).to_pylist() for c in columns)), key=lambda r: (r[0] is None, r[0] or 0))
        part: list[tuple] = []
        size = 0
        for r in rows:
            t = r[-1]
            if t is None:
                continue
            t = t.encode("utf-8", "surrogatepass")
            if part and (size + len(t) > BLOCK or r[0] != part[0][0]):
                yield part
                part, size = [], 0
            part.append((*r[:-1], t))
            size += len(t) + 1
        if part:
            yield part


def _needle_blocks(needles: DataFrame):
    """Lists of (query_id, bytes) of bounded size. The needles' size is checked before they go to the driver."""
    needles = needles.select("query_id", "query").where("query_id is not null and query is not null and query <> ''").distinct()
    size = needles.agg(F.coalesce(F.sum(F.octet_length("query") + 64), F.lit(0)).alias("n")).first()["n"]
    blocks = int(size) // NEEDLE_BYTES + 1
    for b in range(blocks):
        rows = needles.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        yield [(r["query_id"], r["query"].encode()) for r in rows]


def _union(parts: list[DataFrame], docs: DataFrame, schema: str) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def find_many(docs: DataFrame, needles: DataFrame) -> DataFrame:
    """``query_id, shard, lo, hi`` of every needle of ``query_id, query`` in every shard of the corpus, found or not.

    Null and empty needles give no rows. Counts are added up in each task before the shuffle.
    """
    schema = pa.schema([("query_id", pa.int64()), ("shard", pa.int64()), ("lo", pa.int64()), ("n", pa.int64())])
    spec = "query_id long, shard long, lo long, n long"

    def run(some: list[tuple[int, bytes]]):
        def f(it):
            total: dict[int, np.ndarray] = defaultdict(lambda: np.zeros((len(some), 2), np.int64))
            for part in _blocks(it, ("shard", "text")):
                b = Block([p[-1] for p in part])
                total[part[0][0]] += np.array([(lo, len(at)) for lo, at in (b.interval(n) for _, n in some)])
            for shard, t in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in some]), pa.array([shard] * len(some), pa.int64()), pa.array(t[:, 0]), pa.array(t[:, 1])], schema=schema)

        return f

    corpus = docs.select(F.col("shard").cast("long").alias("shard"), "text")
    out = _union([corpus.mapInArrow(run(some), spec) for some in _needle_blocks(needles) if some], docs, spec)
    return out.groupBy("query_id", "shard").agg(F.sum("lo").alias("lo"), (F.sum("lo") + F.sum("n")).alias("hi"))


def locate_many(docs: DataFrame, needles: DataFrame) -> DataFrame:
    """``query_id, shard, doc_id, pos``: byte positions of every occurrence of every needle."""
    schema = pa.schema([("query_id", pa.int64()), ("shard", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64())])
    spec = "query_id long, shard long, doc_id long, pos long"

    def run(some: list[tuple[int, bytes]]):
        def f(it):
            for part in _blocks(it, ("shard", "doc_id", "text")):
                b = Block([p[-1] for p in part])
                ids = np.array([p[1] for p in part], np.int64)
                for q, needle in some:
                    _, at = b.interval(needle)
                    if len(at):
                        at = np.sort(at)
                        d = np.searchsorted(b.starts, at, "right") - 1
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q)), pa.array(np.full(len(at), part[0][0], np.int64)), pa.array(ids[d]), pa.array(at - b.starts[d])], schema=schema)

        return f

    corpus = docs.select(F.col("shard").cast("long").alias("shard"), "doc_id", "text")
    return _union([corpus.mapInArrow(run(some), spec) for some in _needle_blocks(needles) if some], docs, spec)


def count_many(docs: DataFrame, needles: DataFrame) -> DataFrame:
    """``query_id, count`` of every needle that is not null or empty."""
    return find_many(docs, needles).groupBy("query_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("count"))
