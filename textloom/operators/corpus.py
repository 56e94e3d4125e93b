"""Numbering of documents, byte offsets and shards.

Running totals over a whole corpus never go through one task: partitions (or shards) are summed first, the
few sums are accumulated, and each row adds its base to a total within its own partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a document's separator.
SEPARATOR = 1


def running_totals(df: DataFrame, values: dict[str, Column], order: str, group: str = "shard", slots: int = 256) -> DataFrame:
    """Exclusive running totals of ``values`` (by name) within each ``group`` in order of the integer column ``order``.

    Two levels: each group's range of ``order`` is cut into ``slots`` of equal width, so a huge group is many tasks. The table of
    slot totals has at most ``slots`` rows a group.
    """
    span = df.groupBy(group).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    at = F.floor((F.col(order) - F.col("_lo")).cast("double") * slots / (F.col("_hi") - F.col("_lo") + 1)).cast("int")
    rows = df.withColumns({f"_v{i}": v for i, v in enumerate(values.values())}).join(span, group).withColumn("_slot", at).drop("_lo", "_hi")
    by_slot = Window.partitionBy(group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(group, "_slot").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero, n = F.lit(0), range(len(values))
    sums = rows.groupBy(group, "_slot").agg(*(F.sum(f"_v{i}").alias(f"_s{i}") for i in n))
    base = sums.select(group, "_slot", *(F.coalesce(F.sum(f"_s{i}").over(by_slot), zero).alias(f"_b{i}") for i in n))
    total = {name: (F.col(f"_b{i}") + F.coalesce(F.sum(f"_v{i}").over(within), zero)).cast("long") for i, name in enumerate(values)}
    return rows.join(base, [group, "_slot"]).withColumns(total).drop("_slot", *(f"{c}{i}" for c in ("_v", "_b") for i in n))


def running_total(df: DataFrame, value: Column, order: str, name: str, group: str = "shard", slots: int = 256) -> DataFrame:
    """One of ``running_totals``."""
    return running_totals(df, {name: value}, order, group, slots)


def places(docs: DataFrame) -> DataFrame:
    """``shard, doc_id, n_bytes, local_doc_ix, doc_ix, data_offset``: numbers within the shard and over all shards, and the byte of the document's separator.

    Lengths are numbered, in one pass; texts don't move.
    """
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    lean = docs.select("shard", "doc_id", size.alias("n_bytes"))
    lean = running_totals(lean, {"local_doc_ix": F.lit(1).cast("long"), "data_offset": F.col("n_bytes") + SEPARATOR}, "doc_id")
    sizes = lean.groupBy("shard").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    base = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = lean.join(F.broadcast(base), "shard").withColumn("doc_ix", F.col("local_doc_ix") + F.col("_before"))
    return out.select("shard", "doc_id", "n_bytes", "local_doc_ix", "doc_ix", "data_offset")


def number(docs: DataFrame) -> DataFrame:
    """Adds ``local_doc_ix``, ``doc_ix`` and ``data_offset`` (see ``places``) to documents; ids must be unique within a shard."""
    return docs.join(places(docs).drop("n_bytes"), ["shard", "doc_id"])


def doc_at(pointers: DataFrame, offsets: DataFrame, width: int = 1 << 16) -> DataFrame:
    """As-of lookup: for each ``shard, ptr`` the numbered document (with ``n_bytes`` or ``text``) that holds this byte of the stream.

    Both sides are cut into bins of ``width`` bytes, so the range condition becomes an equi-join; a document stands in each bin it reaches.
    """
    size = (F.col("n_bytes") if "n_bytes" in offsets.columns else F.octet_length(F.coalesce("text", F.lit("")))) + SEPARATOR
    ends = offsets.select("shard", "doc_id", "data_offset", (F.col("data_offset") + size).alias("_end"))
    bins = ends.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("data_offset") / width), F.floor((F.col("_end") - 1) / width))))
    p = pointers.withColumn("_bin", F.floor(F.col("ptr") / width))
    hit = p.join(bins, ["shard", "_bin"]).where("ptr >= data_offset and ptr < _end")
    return hit.select(*pointers.columns, "doc_id", (F.col("ptr") - F.col("data_offset") - SEPARATOR).alias("pos"))


def context(text: Column, pos: Column, length: Column, around: int) -> Column:
    """``STRUCT<doc_len, disp_len, needle_offset, text, error>``: the window of ``around`` bytes on either side of [pos, pos + length).

    The window is clipped to the document; a window that cuts a character in two gives an error instead of a text.
    """
    size = F.octet_length(text)
    start = F.greatest(pos - around, F.lit(0))
    end = F.least(pos + length + around, size)
    raw = F.substring(F.encode(text, "UTF-8"), (start + 1).cast("int"), (end - start).cast("int"))
    return window(raw, size, pos, start, end)


def window(raw: Column, size: Column, pos: Column, start: Column, end: Column) -> Column:
    """The same for the bytes [start, end) of a document of ``size`` bytes."""
    piece = F.try_validate_utf8(raw.cast("string"))
    return F.struct(
        size.cast("long").alias("doc_len"),
        (end - start).cast("long").alias("disp_len"),
        (pos - start).cast("long").alias("needle_offset"),
        piece.alias("text"),
        F.when(piece.isNull(), F.lit("the window cuts a character; choose another context length")).alias("error"),
    )
