"""Duplicates hidden by formatting differences.

Method: dictionary encoding. Every distinct value of a column is brought into a canonical form once and gets an integer;
records are rewritten as sorted tuples of such integers, and the compact tuples are grouped.

* ``text`` and ``path``: letters and digits in lower case, nothing else. Paths are canonicalised by distinct
  value. Texts are hardly ever equal byte for byte, so gathering equal ones first would move every text
  through a shuffle to spare a few; they are canonicalised where they are read, and the SHA-256 of the
  canonical form stands for the value.
* ``metadata``: each distinct string is parsed once into (field, value) cells; the order of fields and the
  spacing vanish, values stay exactly as written (``1`` is not ``1.0`` and not ``"1"``).
* The dictionary holds the distinct (column, value) cells with integers; it is written once, so the integers are
  the same in every later stage, whatever executors are lost.

Defined results: a document without letters and digits in its text is nobody's copy; a null path equals
a null path or one without letters and digits; null metadata equals an object without fields; metadata that is no JSON object
counts as one opaque value; a document without metadata rows has null path and metadata. A document with several
records is a copy if any of them is. Empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.storage import materialize
from textloom.llm.common import pick


def canonical(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


class _Number(str):
    """A number as it was written."""


def _written(value: object) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_written(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_written, value)) + "]"
    if isinstance(value, _Number):
        return str(value)
    return json.dumps(value)


def cells(metadata: str) -> list[tuple[str, str]]:
    """(field, value) of each field of a JSON object, sorted; one cell for anything else."""
    try:
        found = json.loads(metadata, parse_int=_Number, parse_float=_Number, parse_constant=_Number)
    except (ValueError, RecursionError):
        return [("", metadata)]
    if not isinstance(found, dict):
        return [("", _written(found))]
    return sorted((f"field:{k}", _written(v)) for k, v in found.items())


def _cell_rows(it):
    schema = pa.schema([("raw", pa.string()), ("field", pa.string()), ("value", pa.string())])
    for batch in it:
        rows = [(raw, *c) for raw in batch.column("raw").to_pylist() for c in cells(raw)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)


def record_tuples(docs: DataFrame, meta: DataFrame) -> DataFrame:
    """``doc_id, record``: the sorted integers of each distinct record of every document whose text has letters or digits."""
    text = canonical(F.col("text"))
    docs, meta = pick(docs, "doc_id", "text"), pick(meta, "doc_id", "path", "metadata")
    docs = docs.where("doc_id is not null").select("doc_id", text.alias("c")).where(F.length("c") > 0).select("doc_id", F.unhex(F.sha2("c", 256)).alias("value"))
    docs = materialize(docs.distinct(), "text-values")
    meta = meta.distinct()
    paths = meta.where("path is not null").select(F.col("path").alias("raw")).distinct().select("raw", canonical(F.col("raw")).alias("value")).where(F.length("value") > 0)
    found = meta.where("metadata is not null").select(F.col("metadata").alias("raw")).distinct().mapInArrow(_cell_rows, "raw string, field string, value string")
    found = materialize(found, "cells")
    as_bytes = lambda d, f: d.select(F.lit(f).alias("field") if isinstance(f, str) else f, F.col("value").cast("binary").alias("value"))
    dictionary = as_bytes(docs, "text").unionByName(as_bytes(paths, "path")).unionByName(as_bytes(found, F.col("field"))).distinct()
    dictionary = materialize(dictionary.withColumn("id", F.monotonically_increasing_id()), "dictionary")
    ids = lambda f, name: dictionary.where(F.col("field") == f).select("value", F.col("id").alias(name))
    texts = docs.join(ids("text", "t"), "value").select("doc_id", "t")
    paths = paths.select("raw", F.col("value").cast("binary").alias("value")).join(ids("path", "p"), "value").select(F.col("raw").alias("path"), "p")
    fields = found.select("raw", "field", F.col("value").cast("binary").alias("value")).join(dictionary, ["field", "value"])
    fields = fields.groupBy("raw").agg(F.collect_set("id").alias("m")).select(F.col("raw").alias("metadata"), "m")
    rows = texts.join(meta, "doc_id", "left").join(paths, "path", "left").join(fields, "metadata", "left")
    # An absent path is the integer -1, so that it can't be taken for the lack of another cell.
    record = F.array_sort(F.concat(F.array("t", F.coalesce("p", F.lit(-1).cast("long"))), F.coalesce("m", F.expr("cast(array() as array<bigint>)"))))
    return rows.select("doc_id", record.alias("record")).distinct()


def copies(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, members): ``keep_doc_id, copies`` of every group of equal records, and ``keep_doc_id, dup_doc_id`` of every further document."""
    records = materialize(records, "records")
    groups = materialize(records.groupBy("record").agg(F.min("doc_id").alias("keep_doc_id"), F.count(F.lit(1)).alias("copies")), "groups")
    members = records.join(groups.where("copies > 1"), "record").where("doc_id <> keep_doc_id")
    members = members.groupBy(F.col("doc_id").alias("dup_doc_id")).agg(F.min("keep_doc_id").alias("keep_doc_id")).select("keep_doc_id", "dup_doc_id")
    return groups.select("keep_doc_id", "copies"), members
