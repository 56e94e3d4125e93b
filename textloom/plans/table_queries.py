"""Ingest, metadata, shard plans and the logs of the search service: queries and SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.storage import shared_dir, table
from textloom.operators import planning
from textloom.plans.corpus import Corpus, Registry
from textloom.plans.registry import query
from textloom.sources import jsonl
from textloom.streaming import ingest


@query("SELECT line_id, CASE WHEN j THEN json_extract_string(line, '$.text') END AS text, CAST(CASE WHEN j THEN len(list_filter(json_keys(line), lambda k: k <> 'text')) END AS BIGINT) AS n_fields, CASE WHEN NOT j THEN 'not a JSON object' WHEN json_type(line, '$.text') IS DISTINCT FROM 'VARCHAR' THEN 'missing field: text' END AS error FROM (SELECT line_id, CASE WHEN json_valid(line) THEN line END AS line, coalesce(json_valid(line), false) AS j FROM corpus_lines)")
def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines into text, metadata and error."""
    rows = jsonl.parse_lines(table(spark, sf_dir, "corpus_lines").select("line_id", "line"))
    return rows.select("line_id", "text", F.json_object_keys("metadata").alias("k"), "error").select("line_id", "text", F.size("k").cast("long").alias("n_fields"), "error")


@query("""SELECT doc_id, '{"path":' || to_json(path) || ',"linenum":' || linenum || ',"metadata":' || coalesce(metadata, 'null') || '}' AS envelope FROM text_meta""")
def meta_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "text_meta").select("doc_id", jsonl.envelope().alias("envelope"))


@query("WITH m AS (SELECT DISTINCT doc_id, path, linenum, metadata FROM text_meta) SELECT d.doc_id, count(m.path) AS n_records, count(m.metadata) AS n_with_metadata FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id")
def metadata_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined with their metadata; deliveries that differ only in time count once."""
    m = table(spark, sf_dir, "text_meta").select("doc_id", "path", "linenum", "metadata").distinct()
    return table(spark, sf_dir, "documents").select("doc_id").join(m, "doc_id", "left").groupBy("doc_id").agg(F.count("path").alias("n_records"), F.count("metadata").alias("n_with_metadata"))


@query("SELECT DISTINCT d.doc_id, m.path, m.linenum, m.metadata FROM documents d JOIN text_meta m ON d.doc_id = m.doc_id")
def metadata_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata of every document, each distinct record once."""
    m = table(spark, sf_dir, "text_meta").select("doc_id", "path", "linenum", "metadata").distinct()
    return table(spark, sf_dir, "documents").select("doc_id").join(m, "doc_id")


_REQUESTS = [
    {"query_type": "count", "index": "documents", "query": "the", "source": "test", "timestamp": 0},
    {"query_type": "find", "index": "documents", "query": "é"},
    {"query_type": "count", "index": "documents"},
    {"query_type": "count", "index": "elsewhere", "query": "the"},
    {"query_type": "sum", "index": "documents", "query": "the"},
    {"query_type": "count", "index": "documents", "query": 7},
    {"query_type": "count", "index": "documents", "query": "the", "size": 1},
    {"query_type": "get_doc_by_rank", "index": "documents", "query": "the", "s": 0, "rank": -1},
]


@query(
    """SELECT * FROM (VALUES (0, 200, (SELECT CAST(sum((length(text) - length(replace(text, 'the', ''))) // 3) AS BIGINT) FROM documents)),
(1, 200, (SELECT CAST(sum(length(text) - length(replace(text, 'é', ''))) AS BIGINT) FROM documents)), (2, 400, NULL), (3, 400, NULL), (4, 400, NULL), (5, 400, NULL), (6, 400, NULL), (7, 400, NULL)) AS t(request, status, cnt)"""
)
def served_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered by the interface: good ones, and each kind of mistake."""
    docs = table(spark, sf_dir, "documents").select("shard", "doc_id", "text")
    served = Registry({"documents": Corpus(docs)})
    answers = [served.query(r) for r in _REQUESTS]
    return spark.createDataFrame([(i, a.get("status", 200), a.get("count", a.get("cnt"))) for i, a in enumerate(answers)], "request int, status int, cnt long")


@query("SELECT DISTINCT doc_id FROM text_meta WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def withdrawn_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "text_meta").select("doc_id").distinct().join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_anti")


@query("SELECT shard, count(*) AS n_docs, CAST(sum(strlen(text)) AS BIGINT) AS text_bytes, CAST(sum(strlen(text) + 1) + 1 AS BIGINT) AS stream_bytes, CAST(max(strlen(text)) AS BIGINT) AS longest FROM documents GROUP BY shard")
def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text")
    return table(spark, sf_dir, "documents").groupBy("shard").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(size).alias("text_bytes"), (F.sum(size + 1) + 1).alias("stream_bytes"), F.max(size).cast("long").alias("longest"))


@query("WITH s AS (SELECT path, count(*) AS n FROM text_meta GROUP BY path), r AS (SELECT path, n, coalesce(sum(n) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total, row_number() OVER (ORDER BY path) - 1 AS k FROM s) SELECT path, n, CAST(k // 7 AS BIGINT) AS planned, CAST(CASE WHEN before * 2 >= total THEN 1 ELSE 0 END AS INTEGER) AS half FROM r")
def shard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files dealt to shards of seven, and to two halves of about equal size."""
    files = table(spark, sf_dir, "text_meta").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return planning.halves(planning.in_runs(files, "path", 7), "path", "n")


@query("SELECT doc_id, source FROM documents WHERE lower(replace(trim(source), ' ', '')) IN ('oldbooks', 'lawreports')")
def domain_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower(F.replace(F.trim("source"), F.lit(" "), F.lit("")))
    return table(spark, sf_dir, "documents").where(name.isin("oldbooks", "lawreports")).select("doc_id", "source")


@query("SELECT index_name, count(*) AS n_shards, CAST(sum(shard_bytes) AS BIGINT) AS bytes, count(*) FILTER (WHERE load_to_ram) AS in_ram, count(*) FILTER (WHERE NOT get_metadata) AS without_metadata FROM index_shards GROUP BY index_name")
def index_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "index_shards")
    return t.groupBy("index_name").agg(F.count(F.lit(1)).alias("n_shards"), F.sum("shard_bytes").alias("bytes"), F.count_if("load_to_ram").alias("in_ram"), F.count_if(~F.col("get_metadata")).alias("without_metadata"))


@query("SELECT f.request_id, f.cnt, CAST(coalesce(list_sum(list_transform(segment_by_shard, lambda x: x.hi - x.lo)), 0) AS BIGINT) AS from_segments, CAST(len(segment_by_shard) AS BIGINT) AS n_segments FROM find_results f")
def find_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count of each result against the sum of its segments."""
    total = F.aggregate("segment_by_shard", F.lit(0).cast("long"), lambda acc, x: acc + x["hi"] - x["lo"])
    return table(spark, sf_dir, "find_results").select("request_id", "cnt", total.alias("from_segments"), F.size("segment_by_shard").cast("long").alias("n_segments"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request once, as it was received first: a minimum per id, combined before the shuffle."""
    log = table(spark, sf_dir, "request_log")
    rest = [c for c in log.columns if c != "request_id"]
    return log.groupBy("request_id").agg(F.min_by(F.struct(*rest), "received_ts").alias("r")).select("request_id", "r.*")


@query("WITH l AS (SELECT DISTINCT request_id, index_name, query_type, query_id FROM request_log) SELECT l.index_name, lower(trim(l.query_type)) AS query_type, count(*) AS n, count(*) FILTER (WHERE s.index_name IS NULL) AS invalid_index FROM l LEFT JOIN (SELECT DISTINCT index_name FROM index_shards) s ON l.index_name = s.index_name GROUP BY 1, 2")
def request_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by index and type, and those whose index does not exist."""
    known = table(spark, sf_dir, "index_shards").select("index_name", F.lit(True).alias("known")).distinct()
    rows = _log(spark, sf_dir).join(F.broadcast(known), "index_name", "left")
    return rows.groupBy("index_name", F.lower(F.trim("query_type")).alias("query_type")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("invalid_index"))


@query("WITH l AS (SELECT DISTINCT request_id, error FROM request_log) SELECT CASE WHEN error IS NULL THEN 200 WHEN lower(trim(error)) = 'internal error' THEN 500 ELSE 400 END AS status, lower(trim(error)) AS error, count(*) AS n FROM l GROUP BY 1, 2")
def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.lower(F.trim("error"))
    status = F.when(message.isNull(), 200).when(message == "internal error", 500).otherwise(400)
    return _log(spark, sf_dir).groupBy(status.alias("status"), message.alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH l AS (SELECT DISTINCT request_id, index_name, latency_ms FROM request_log) SELECT index_name, count(latency_ms) AS n, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.99), 4) AS p99, round(max(latency_ms), 4) AS slowest FROM l WHERE latency_ms >= 0 GROUP BY index_name")
def request_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir).where("latency_ms >= 0").groupBy("index_name")
    p = lambda q: F.round(F.percentile("latency_ms", F.lit(q)), 4)
    return rows.agg(F.count("latency_ms").alias("n"), p(0.5).alias("p50"), p(0.99).alias("p99"), F.round(F.max("latency_ms"), 4).alias("slowest"))


@query("SELECT r.request_id, r.doc_ix, r.disp_len - coalesce(CAST(strlen(r.text) AS BIGINT), r.disp_len) AS cut, r.doc_len - CAST(strlen(d.text) AS BIGINT) AS stale, coalesce(contains(d.text, r.text), false) AS still_there FROM doc_results r LEFT JOIN documents d ON r.doc_ix = d.doc_id")
def doc_results_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved windows against the documents they came from."""
    r = table(spark, sf_dir, "doc_results").select("request_id", "doc_ix", "doc_len", "disp_len", F.col("text").alias("window"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_ix"), "text")
    size = F.octet_length("window").cast("long")
    return r.join(d, "doc_ix", "left").select("request_id", "doc_ix", (F.col("disp_len") - F.coalesce(size, "disp_len")).alias("cut"), (F.col("doc_len") - F.octet_length("text")).alias("stale"), F.coalesce(F.contains("text", "window"), F.lit(False)).alias("still_there"))


@query("SELECT CAST(sum((length(text) - length(replace(text, 'the', ''))) // 3) AS BIGINT) AS n0, CAST(sum((length(text) - length(replace(text, 'harbour', ''))) // 7) AS BIGINT) AS n1 FROM documents")
def streaming_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents read as a stream, counted as they arrive."""
    docs = table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parque[t]")
    name = "stream_" + uuid.uuid4().hex
    out = ingest.running_counts(stream, ["the", "harbour"]).writeStream.outputMode("complete").format("memory").queryName(name)
    out.option("checkpointLocation", f"{shared_dir(spark)}/{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query("SELECT CAST(floor(epoch(sent_ts) / 3600) AS BIGINT) AS hour, lower(trim(query_type)) AS query_type, count(*) AS n FROM request_log GROUP BY 1, 2")
def request_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per hour of sending; the same plan runs on a stream, where late rows are awaited for a week."""
    rows = ingest.late_windows(table(spark, sf_dir, "request_log"))
    return rows.select(F.floor(F.unix_timestamp("start") / 3600).alias("hour"), "query_type", "n")
