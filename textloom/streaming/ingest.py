"""A corpus that grows: each micro-batch of lines becomes a new shard, and counts add up over shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.needle import occurrences
from textloom.sources.jsonl import parse_lines


def stream_lines(spark: SparkSession, path: str, most_files: int = 1000) -> DataFrame:
    """``path, line`` of JSON-lines files as they arrive."""
    rows = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").option("maxFilesPerTrigger", most_files).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")).where("trim(line) <> ''")


def append_shards(lines: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes each micro-batch to ``target/shard=<batch>``. A batch that is retried overwrites its own shard, so none is doubled."""

    def write(batch: DataFrame, number: int) -> None:
        docs = parse_lines(batch).where("error is null").drop("error").withColumn("doc_id", F.monotonically_increasing_id() + F.lit(number) * F.lit(1 << 50))
        docs.write.mode("overwrite").parquet(f"{target}/shard={number}")

    out = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def running_counts(docs: DataFrame, needles: list[str]) -> DataFrame:
    """Of a stream with ``text``: one row with the occurrences of each needle so far (columns n0, n1, ...). Sums need no watermark."""
    return docs.agg(*(F.coalesce(F.sum(occurrences(F.col("text"), q)), F.lit(0)).alias(f"n{i}") for i, q in enumerate(needles)))


def late_windows(requests: DataFrame, late: str = "7 days", width: str = "1 hour") -> DataFrame:
    """Requests per ``width`` of ``sent_ts`` and query type; rows later than ``late`` behind the newest are dropped, and the state with them."""
    kind = F.lower(F.trim("query_type"))
    return requests.withWatermark("sent_ts", late).groupBy(F.window("sent_ts", width).alias("w"), kind.alias("query_type")).agg(F.count(F.lit(1)).alias("n")).select("w.start", "query_type", "n")
