"""A stored suffix index of a corpus, and searches that read a few of its pages.

``build`` writes three Parquet tables: ``pages`` (the suffixes in order, 65,536 a row, see ``suffix_sort``), ``text`` (the streams in blocks) and ``docs`` (where
each document lies, and its metadata); with ``occ``, for each page and byte how often the byte stands in the BWT before the page. Row groups hold a few
pages and are sorted, so a search reads those whose least and largest keys enclose the needle, whatever the size of the corpus: at most
two pages a shard for a needle of up to ``HEAD`` bytes. A longer one is compared with the text of some suffixes between the borders of its first bytes, 64 a
shard and round. An index takes about 30 bytes for each byte of text before compression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.storage import materialize
from textloom.operators import corpus as numbering
from textloom.operators import suffix_sort as ss

PIVOTS = 64
TABLES = ("pages", "text", "docs", "occ")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a whole index lies there: the table written last is complete."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/docs/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def build(docs: DataFrame, path: str, resume: bool = True, block: int = ss.BLOCK, page: int = ss.PAGE, range_rows: int = ss.RANGE) -> SuffixIndex:
    """Index ``shard, doc_id, text`` (further columns are kept with the documents); with ``resume``, an index that is there is left alone."""
    spark = docs.sparkSession
    if resume and exists(spark, path):
        return SuffixIndex.open(spark, path)
    docs = docs.where("text is not null")
    text = materialize(ss.blocks(docs.select("shard", "doc_id", "text"), block), "text-blocks")
    state = ss.ranks(text, block, range_rows)
    write = lambda df, name, *by: df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").option("parquet.block.size", 1 << 22).parquet(f"{path}/{name}")
    write(text, "text", "shard", "blk")
    write(ss.pages(text, state, block, page).withColumns({"block_size": F.lit(block), "page_size": F.lit(page)}), "pages", "shard", "page")
    pages = spark.read.parquet(f"{path}/pages")
    counts = pages.select("shard", "page", "bwt").mapInArrow(_byte_counts, "shard long, page long, byte int, n long")
    before = Window.partitionBy("shard", "byte").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)  # a row for each page
    write(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "occ", "shard", "byte", "page")
    write(numbering.places(docs).join(docs.drop("text"), ["shard", "doc_id"]), "docs", "shard", "data_offset")
    return SuffixIndex.open(spark, path)


def _byte_counts(it):
    for batch in it:
        for s, p, b in zip(*(batch.column(c).to_pylist() for c in ("shard", "page", "bwt"))):
            n = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s] * 256), "page": pa.array([p] * 256), "byte": pa.array(np.arange(256, dtype=np.int32)), "n": pa.array(n)})


def _two_words(heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = np.ascontiguousarray(heads).view(">u8").astype(np.uint64)
    return w[:, 0], w[:, 1]


def _bounds(heads: np.ndarray, word: bytes) -> tuple[int, int]:
    """How many of the sorted heads are below the word, and how many are below or begin with it."""
    k1, k2 = _two_words(heads)
    out = []
    for pad, side in ((b"\0", "left"), (b"\xff", "right")):
        a, b = (np.uint64(int.from_bytes(word.ljust(ss.HEAD, pad)[i : i + 8], "big")) for i in (0, 8))
        lo, hi = np.searchsorted(k1, a, "left"), np.searchsorted(k1, a, "right")
        out.append(int(lo + np.searchsorted(k2[lo:hi], b, side)))
    return out[0], out[1]


@dataclass
class SuffixIndex:
    pages: DataFrame
    text: DataFrame
    docs: DataFrame
    occ: DataFrame
    block: int
    page: int
    #: Shard -> positions of its stream; a row for each shard.
    sizes: dict[int, int]

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SuffixIndex:
        pages, text, docs, occ = (spark.read.parquet(f"{path}/{t}") for t in TABLES)
        one = pages.select("block_size", "page_size").first()
        sizes = {r["shard"]: r["n"] for r in docs.groupBy("shard").agg((F.sum(F.col("n_bytes") + 1) + 1).alias("n")).collect()}
        return cls(pages.drop("block_size", "page_size"), text, docs, occ, *(one or (ss.BLOCK, ss.PAGE)), {int(s): n for s, n in sizes.items()})

    # Searching

    def find(self, needle: str | bytes) -> dict[int, tuple[int, int]]:
        """Shard -> [lo, hi): the ranks of the suffixes that begin with the needle; where it would stand, if none does."""
        word = needle.encode("utf-8", "surrogatepass") if isinstance(needle, str) else needle
        if not word:
            return {s: (0, n) for s, n in self.sizes.items()}
        head = word[: ss.HEAD]
        low, high = ss.key_of(head.ljust(8, b"\0")), ss.key_of(head.ljust(8, b"\xff"))
        page = self.page

        def f(it):
            for batch in it:
                out = []
                for s, p, first, after, h in zip(*(batch.column(c).to_pylist() for c in ("shard", "page", "first_key", "next_key", "head"))):
                    below, upto = _bounds(np.frombuffer(h, np.uint8).reshape(-1, ss.HEAD), head)
                    out += [(s, side, p * page, n) for side, key, n in ((0, low, below), (1, high, upto)) if first <= key <= after]
                yield from ss._batches("shard long, side int, start long, n long", out)

        border = F.expr(f"(first_key <= {low} and next_key >= {low}) or (first_key <= {high} and next_key >= {high})")
        rows = self.pages.where(border).select("shard", "page", "first_key", "next_key", "head").mapInArrow(f, "shard long, side int, start long, n long")
        ends: dict[int, dict[int, int]] = {}
        for r in rows.groupBy("shard", "side").agg((F.min("start") + F.sum("n")).alias("rank")).collect():  # two rows a shard
            ends.setdefault(r["shard"], {})[r["side"]] = r["rank"]
        found = {s: (e[0], e[1]) for s, e in ends.items()}
        return self._narrow(word, found) if len(word) > ss.HEAD else found

    def find_all(self, words: list[bytes]) -> list[dict[int, tuple[int, int]]]:
        return [self.find(w) for w in words]

    def _narrow(self, word: bytes, found: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
        """Cuts intervals of the first ``HEAD`` bytes down to the whole word: both borders of all shards at once, by comparing pivots."""
        # (shard, side) -> [lo, hi]: the border is the number of suffixes that are smaller (side 0), or smaller or with the word at the start (side 1).
        open_ = {(s, side): iv for s, iv in found.items() for side in (0, 1)}
        while any(lo < hi for lo, hi in open_.values()):
            asked = {(s, r) for (s, _), (lo, hi) in open_.items() for r in ({*range(lo, hi)} if hi - lo <= PIVOTS else {lo + (hi - lo) * k // (PIVOTS + 1) for k in range(1, PIVOTS + 1)})}
            texts = self.read(self.pointers(asked), len(word))
            for (s, side), (lo, hi) in open_.items():
                for r in sorted(r for t, r in asked if t == s and lo <= r < hi):
                    below = texts[s, r] < word or (side == 1 and texts[s, r].startswith(word))
                    if below:
                        lo = r + 1
                    else:
                        hi = r
                        break
                open_[s, side] = (lo, hi)
        return {s: (open_[s, 0][0], open_[s, 1][0]) for s in found}

    def pointers(self, asked: set[tuple[int, int]]) -> dict[tuple[int, int], int]:
        """(shard, rank) -> pointer, of a few ranks."""
        page = self.page
        want: dict[tuple[int, int], list[int]] = {}
        for s, r in asked:
            want.setdefault((s, r // page), []).append(r)

        def f(it):
            for batch in it:
                out = []
                for s, p, ptr in zip(*(batch.column(c).to_pylist() for c in ("shard", "page", "ptr"))):
                    at = np.frombuffer(ptr, np.int64)
                    out += [(s, r, int(at[r % page])) for r in want.get((s, p), ())]
                yield from ss._batches("shard long, rank long, ptr long", out)

        rows = self.pages.where(_pairs("page", want)).select("shard", "page", "ptr").mapInArrow(f, "shard long, rank long, ptr long")
        return {(r["shard"], r["rank"]): r["ptr"] for r in rows.collect()}

    def read(self, at: dict, size: int) -> dict:
        """name (shard, ...) -> ``size`` bytes of the shard's stream from a pointer on, of a few pointers."""
        block = self.block
        want: dict[tuple[int, int], list] = {}
        for name, ptr in at.items():
            for b in range(ptr // block, (ptr + size - 1) // block + 1):
                want.setdefault((name[0], b), []).append((name, ptr))
        keys = {k: [(i, p) for i, (_, p) in enumerate(v)] for k, v in want.items()}

        def f(it):
            for batch in it:
                out = []
                for s, b, n, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "blk", "size", "data"))):
                    for i, p in keys.get((s, b), ()):
                        lo, hi = max(p, b * block), min(p + size, b * block + n)
                        out.append((s, b, i, data[1 + lo - b * block : 1 + hi - b * block]))
                yield from ss._batches("shard long, blk long, i long, part binary", out)

        rows = self.text.where(_pairs("blk", want)).select("shard", "blk", "size", "data").mapInArrow(f, "shard long, blk long, i long, part binary")
        parts: dict = {name: b"" for name in at}
        for r in sorted(rows.collect(), key=lambda r: (r["shard"], r["blk"])):
            parts[want[r["shard"], r["blk"]][r["i"]][0]] += bytes(r["part"])
        return parts

    def count(self, needle: str) -> int:
        return sum(hi - lo for lo, hi in self.find(needle).values())

    def intervals(self, needle: str | bytes) -> DataFrame:
        """``shard, lo, hi``."""
        return self.docs.sparkSession.createDataFrame([(s, *v) for s, v in sorted(self.find(needle).items())], "shard long, lo long, hi long")

    # What stands at ranks

    def suffixes(self, found: dict[int, tuple[int, int]] | None = None) -> DataFrame:
        """``shard, rank, ptr, byte, bwt, head`` of the ranks in the intervals (all without any): only pages that hold them are read."""
        if found is None:
            return ss.rows(self.pages, self.page)
        near, inside = F.lit(False), F.lit(False)
        for s, (lo, hi) in found.items():
            near = near | ((F.col("shard") == s) & F.col("page").between(lo // self.page, (hi - 1) // self.page)) if lo < hi else near
            inside = inside | ((F.col("shard") == s) & (F.col("rank") >= lo) & (F.col("rank") < hi))
        return ss.rows(self.pages.where(near), self.page).where(inside)

    def locate(self, needle: str) -> DataFrame:
        """``shard, rank, ptr, doc_id, pos`` of every occurrence, in suffix order by rank."""
        at = self.suffixes(self.find(needle)).select("shard", "rank", "ptr")
        return at.join(numbering.doc_at(at, self.docs), ["shard", "rank", "ptr"])

    def doc_at_rank(self, shard: int, rank: int) -> tuple[int, int] | None:
        """(pointer, byte of its document's separator) of a rank; None beyond the shard."""
        if not 0 <= rank < self.sizes.get(shard, 0):
            return None
        ptr = self.pointers({(shard, rank)})[shard, rank]
        doc = self.docs.where((F.col("shard") == shard) & (F.col("data_offset") <= ptr) & (F.col("data_offset") + F.col("n_bytes") + 1 > ptr)).select("data_offset").first()
        return (ptr, doc["data_offset"]) if doc else None

    def get_doc_by_rank(self, shard: int, rank: int, needle_bytes: int, around: int) -> DataFrame:
        """The document at a rank: its columns, ``pos``, and the window ``c`` (see ``corpus.context``) around the needle; no row for a rank beyond the shard or that of a terminator."""
        at = self.doc_at_rank(shard, rank)
        docs = self.docs.where(F.col("shard") == shard)
        if at is None:
            return docs.limit(0).select("*", F.lit(0).cast("long").alias("pos"), numbering.window(F.lit(b""), F.lit(0), F.lit(0), F.lit(0), F.lit(0)).alias("c"))
        ptr, offset = at
        doc = docs.where(F.col("data_offset") == offset)
        n = doc.select("n_bytes").first()["n_bytes"]
        pos = ptr - offset - 1
        start, end = max(pos - around, 0), min(pos + needle_bytes + around, n)
        raw = self.read({(shard,): offset + 1 + start}, end - start)[shard,] if end > start else b""
        lit = lambda x: F.lit(x).cast("long")
        return doc.select("*", lit(pos).alias("pos"), numbering.window(F.lit(raw), lit(n), lit(pos), lit(start), lit(end)).alias("c"))

    # The BWT

    def smaller_bytes(self) -> DataFrame:
        """``shard, byte, n, smaller``: the C-array, from the last page of the occurrences and its own."""
        counts = self.pages.select("shard", "page", "bwt").mapInArrow(_byte_counts, "shard long, page long, byte int, n long").groupBy("shard", "byte").agg(F.sum("n").alias("n")).where("n > 0")
        by = Window.partitionBy("shard").orderBy("byte").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows a shard
        return counts.withColumn("smaller", F.coalesce(F.sum("n").over(by), F.lit(0)).cast("long"))

    def occurrences(self, byte: int, ranks: set[tuple[int, int]]) -> dict[tuple[int, int], int]:
        """(shard, rank) -> how often the byte stands in the BWT before the rank, of a few ranks: a row of ``occ`` and a page each."""
        page = self.page
        want: dict[tuple[int, int], list[int]] = {}
        for s, r in ranks:
            want.setdefault((s, r // page), []).append(r)
        before = {(r["shard"], r["page"]): r["before"] for r in self.occ.where((F.col("byte") == byte) & _pairs("page", want)).collect()}

        def f(it):
            for batch in it:
                out = []
                for s, p, bwt in zip(*(batch.column(c).to_pylist() for c in ("shard", "page", "bwt"))):
                    hit = np.frombuffer(bwt, np.uint8) == byte
                    out += [(s, r, int(hit[: r % page].sum())) for r in want.get((s, p), ())]
                yield from ss._batches("shard long, rank long, n long", out)

        rows = self.pages.where(_pairs("page", want)).select("shard", "page", "bwt").mapInArrow(f, "shard long, rank long, n long").collect()
        out = {(r["shard"], r["rank"]): before[r["shard"], r["rank"] // page] + r["n"] for r in rows}
        # A rank at the very end begins a page that isn't there.
        missing = {s for s, r in ranks if (s, r) not in out}
        if missing:
            total = {r["shard"]: r["n"] for r in self.smaller_bytes().where((F.col("byte") == byte) & F.col("shard").isin([*missing])).collect()}
            out |= {(s, r): total.get(s, 0) for s, r in ranks if (s, r) not in out}
        return out

    def backward_step(self, found: dict[int, tuple[int, int]], byte: int, c: dict[tuple[int, int], int] | None = None) -> dict[int, tuple[int, int]]:
        """From the intervals of a pattern to those of the byte followed by it. Shards where nothing is left keep an empty interval."""
        c = c if c is not None else self._c()
        n = self.occurrences(byte, {(s, r) for s, iv in found.items() for r in iv})
        return {s: tuple(c[s, byte] + n[s, r] for r in iv) for s, iv in found.items()}

    def backward_search(self, pattern: bytes) -> dict[int, tuple[int, int]]:
        """Byte by byte from the right; a shard whose interval is empty is not looked at any further."""
        c, live, done = self._c(), {s: (0, n) for s, n in self.sizes.items()}, {}
        for byte in reversed(pattern):
            if not live:
                break
            live = self.backward_step(live, byte, c)
            done |= {s: iv for s, iv in live.items() if iv[0] == iv[1]}
            live = {s: iv for s, iv in live.items() if iv[0] < iv[1]}
        return done | live

    def _c(self) -> dict[tuple[int, int], int]:
        """(shard, byte) -> smaller bytes in the shard, of every byte whether it occurs or not."""
        n = {(r["shard"], r["byte"]): r["n"] for r in self.smaller_bytes().collect()}  # at most 256 rows a shard
        out = {}
        for s in self.sizes:
            total = 0
            for b in range(256):
                out[s, b] = total
                total += n.get((s, b), 0)
        return out


def _pairs(column: str, keys) -> Column:
    """A filter for pairs of shard and page (or block) that reaches the statistics of the row groups."""
    by: dict[int, list[int]] = {}
    for s, p in keys:
        by.setdefault(s, []).append(p)
    out = F.lit(False)
    for s, ps in by.items():
        out = out | ((F.col("shard") == s) & F.col(column).isin(ps))
    return out
