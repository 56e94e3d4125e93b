"""The search interface over named corpora: ``count``, ``find``, ``get_doc_by_rank``, and requests as dictionaries."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from textloom.operators import corpus as numbering
from textloom.operators import index as suffix_index
from textloom.operators import needle as needles
from textloom.operators import search

LEAST_CONTEXT, MOST_CONTEXT, CONTEXT = 1, 10_000, 1_000
#: Bytes after a needle by which its matches are counted before some are put in order.
HEAD = 32


class RequestError(ValueError):
    """A request that can't be answered; ``status`` is 400 for the client's mistakes."""

    status = 400


@dataclass
class Corpus:
    """Documents ``shard, doc_id, text`` and, if wanted, ``path, linenum, metadata``."""

    docs: DataFrame
    get_metadata: bool = True
    index: suffix_index.SuffixIndex | None = None

    @classmethod
    def open(cls, spark: SparkSession, *paths: str, load_to_ram: bool = False, get_metadata: bool = True) -> Corpus:
        """Parquet folders of one corpus. Columns that no query needs are never read, so metadata cost nothing unless they are shown."""
        docs = spark.read.parquet(*paths)
        return cls(docs.persist(StorageLevel.MEMORY_AND_DISK) if load_to_ram else docs, get_metadata)

    def build_index(self, path: str, resume: bool = True) -> Corpus:
        """The same corpus with a stored suffix index: searches read a few of its pages instead of every text."""
        return replace(self, index=suffix_index.build(self.docs.select("shard", "doc_id", "text"), path, resume))

    def count(self, query: str) -> DataFrame:
        if self.index is not None:
            return self.docs.sparkSession.createDataFrame([(self.index.count(query),)], "count long")
        return search.count(self.docs, query)

    def find(self, query: str) -> DataFrame:
        return search.as_result(self.index.intervals(query) if self.index is not None else search.find(self.docs, query))

    def get_doc_by_rank(self, query: str, s: int, rank: int, max_ctx_len: int = CONTEXT) -> DataFrame:
        """The document at a rank of the needle's interval in shard ``s``: its numbers, context, highlighted spans and metadata.

        No row if the rank lies outside the interval. With an index, its pages are asked. Without, only documents of one shard that have the needle are looked at:
        their matches are counted by the bytes that follow, and only those with the bytes of the rank are put in order.
        """
        around = max(LEAST_CONTEXT, min(MOST_CONTEXT, max_ctx_len))
        size = len(query.encode())
        if self.index is not None:
            lo, hi = self.index.find(query).get(s, (0, 0))
            one = self.index.get_doc_by_rank(s, rank if lo <= rank < hi else -1, size, around)
        else:
            one = self._by_scan(query, s, rank, size, around)
        out = one.select("doc_id", "c.doc_len", "c.disp_len", "c.needle_offset", F.col("c.text").alias("text"), needles.highlight(F.col("c.text"), query).alias("spans"), F.col("c.error").alias("error"))
        if self.get_metadata and "metadata" in self.docs.columns:
            out = out.join(self.docs.where(F.col("shard") == s).select("doc_id", "metadata"), "doc_id")
        return out

    def _by_scan(self, query: str, s: int, rank: int, size: int, around: int) -> DataFrame:
        shard = self.docs.where(F.col("shard") == s)
        lo = search.find(shard.select("shard", "text"), query).select("shard", "lo")
        hits = shard.where(F.contains("text", F.lit(query))).select("shard", "doc_id", "text", F.explode(needles.positions(F.col("text"), query)).alias("pos"))
        rest = lambda n: F.concat(F.substring(F.encode("text", "UTF-8"), F.col("pos").cast("int") + 1, F.lit(n)), F.unhex(F.lit("FF")))
        head = rest(size + HEAD).alias("_head")
        counts = hits.groupBy("shard", head).agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(lo), "shard")
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # The one head whose ranks hold the one asked for.
        bin_ = counts.withColumn("_from", F.col("lo") + before).where((F.col("_from") <= rank) & (F.col("_from") + F.col("_n") > rank)).select("shard", "_head", "_from")
        near = hits.withColumn("_head", head).join(F.broadcast(bin_), ["shard", "_head"])
        ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy("shard").orderBy(rest(1 << 30), "doc_id", "pos")) - 1)
        one = ranked.where(F.col("_from") + F.col("_r") == rank)
        return one.withColumn("c", numbering.context(F.col("text"), F.col("pos"), F.lit(size), around))


@dataclass
class Registry:
    """Corpora by name, and requests to them."""

    corpora: dict[str, Corpus] = field(default_factory=dict)
    log: list[dict[str, Any]] = field(default_factory=list)
    keep_log: bool = False

    TYPES = ("count", "find", "get_doc_by_rank")

    def plan(self, request: dict[str, Any]) -> DataFrame:
        """The DataFrame that answers a request ``query_type, index, query`` plus the arguments of its type."""
        if self.keep_log:
            self.log.append(dict(request))
        rest = {k: v for k, v in request.items() if k not in ("source", "timestamp")}
        for name in ("query_type", "index", "query"):
            if name not in rest:
                raise RequestError(f"missing field: {name}")
        kind, index, query = rest.pop("query_type"), rest.pop("index"), rest.pop("query")
        if index not in self.corpora:
            raise RequestError("invalid index")
        if kind not in self.TYPES:
            raise RequestError("invalid query_type")
        if not isinstance(query, str):
            raise RequestError("query must be a string")
        try:
            return getattr(self.corpora[index], kind)(query, **rest)
        except TypeError as e:
            raise RequestError(str(e)) from e

    def query(self, request: dict[str, Any]) -> dict[str, Any]:
        """The answer as a dictionary with ``latency`` in milliseconds, or ``error`` and ``status``."""
        began = time.perf_counter()
        try:
            row = self.plan(request).first()
            out = row.asDict(recursive=True) if row else {"error": "rank out of range", "status": 400}
        except RequestError as e:
            out = {"error": str(e), "status": e.status}
        except Exception as e:  # whatever the engine raises is the server's fault
            out = {"error": f"internal error: {type(e).__name__}", "status": 500}
        return out | {"latency": (time.perf_counter() - began) * 1000}

    def write_log(self, spark: SparkSession, path: str) -> None:
        """Appends the requests kept so far as JSON lines, with all their arguments."""
        if self.log:
            spark.createDataFrame([(json.dumps(r, default=str, ensure_ascii=False),) for r in self.log], "value string").write.mode("append").text(path)
            self.log.clear()
