"""JSON lines in (plain, gzip or zstd), corpus tables out.

Files are found recursively; their order by path, and lines by number, define the order of documents.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.storage import materialize

MISSING, BROKEN = "missing field: text", "not a JSON object"


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, linenum, line`` of all non-empty lines of ``*.json*`` files; ``linenum`` counts all lines from 0.

    The codec follows the file name (.gz, .zst, .zstd). Lines are numbered within each block of a file in parallel, and the counts of
    the few blocks before are added.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").text(list(paths))
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    blocks = rows.groupBy("path", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("path", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("path", "_block").orderBy("_row")) - 1).join(base, ["path", "_block"])
    return rows.select("path", (F.col("_base") + F.col("_at")).cast("long").alias("linenum"), "line").where("trim(line) <> ''")


def split_line(line: str | None) -> tuple[str | None, str | None, str | None]:
    """(text, metadata without the text, error)."""
    try:
        found = json.loads(line or "")
    except (ValueError, RecursionError):
        return None, None, BROKEN
    if not isinstance(found, dict):
        return None, None, BROKEN
    text = found.pop("text", None)
    meta = json.dumps(found, ensure_ascii=False)
    return (text, meta, None) if isinstance(text, str) else (None, meta, MISSING)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Replaces ``line`` by ``text, metadata, error``: the body, all other fields as JSON in their order, and what is wrong with the line."""
    keep = [f for f in lines.schema if f.name not in ("line", "text", "metadata", "error")]

    def f(it):
        for batch in it:
            parts = [split_line(x) for x in batch.column("line").to_pylist()]
            cols = {k.name: batch.column(k.name) for k in keep}
            yield pa.RecordBatch.from_pydict(cols | {n: pa.array([p[i] for p in parts], pa.string()) for i, n in enumerate(("text", "metadata", "error"))})

    schema = ", ".join([f"`{k.name}` {k.dataType.simpleString()}" for k in keep] + ["text string", "metadata string", "error string"])
    return lines.select(*(k.name for k in keep), "line").mapInArrow(f, schema)


def ingest(spark: SparkSession, *paths: str, shards: int = 1, strict: bool = False) -> DataFrame:
    """``shard, doc_id, path, linenum, text, metadata`` of all lines with a text; documents are dealt to shards in runs of files.

    ``strict`` raises at the first line without text instead of leaving it out.
    """
    rows = materialize(parse_lines(read_lines(spark, *paths)), "lines")
    if strict and not rows.where("error is not null").isEmpty():
        bad = rows.where("error is not null").orderBy("path", "linenum").first()
        raise ValueError(f"{bad['path']}:{bad['linenum']}: {bad['error']}")
    good = rows.where("error is null")
    files = good.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))  # a row for each file
    by = Window.orderBy("path")
    files = files.select("path", F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), (F.ntile(shards).over(by) - 1).alias("shard"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy("linenum")) - 1
    return good.withColumn("_at", rank).join(files, "path").select("shard", (F.col("_base") + F.col("_at")).cast("long").alias("doc_id"), "path", "linenum", "text", "metadata")


def write_corpus(docs: DataFrame, path: str, resume: bool = True) -> None:
    """Parquet by shard; with ``resume``, an index that is there already is left alone."""
    docs.write.mode("ignore" if resume else "overwrite").partitionBy("shard").parquet(path)


def envelope(path: str = "path", linenum: str = "linenum", metadata: str = "metadata"):
    """The metadata record of a document as JSON: path, line number, and the original object unchanged."""
    head = F.to_json(F.struct(F.col(path).alias("path"), F.col(linenum).alias("linenum")), {"ignoreNullFields": "false"})
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"metadata":'), F.coalesce(F.col(metadata), F.lit("null")), F.lit("}"))
