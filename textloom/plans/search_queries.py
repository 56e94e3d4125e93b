"""Searching, locating and retrieving: queries and SQL.

The SQL views bytes as pairs of hexadecimal digits, whose order is the order of the bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.storage import table
from textloom.operators import corpus, needle, search
from textloom.plans.registry import query

CASES = ["the", "The", "é", "\n", "ss", "zzzzq", "a.b*c", "\\E"]
WORD, AROUND = "harbour beside", 20

_NEEDLES = """n AS (SELECT DISTINCT query_id, query FROM needles WHERE query_id IS NOT NULL AND query IS NOT NULL AND query <> ''),
b AS (SELECT query_id, query, len(list_filter(range(1, length(query)), lambda k: left(query, k) = right(query, k))) > 0 AS bordered FROM n)"""
_COUNTS = f"""WITH {_NEEDLES},
c AS (SELECT b.query_id, d.doc_id, d.shard, (length(d.text) - length(replace(d.text, b.query, ''))) // length(b.query) AS n
      FROM b JOIN documents d ON contains(d.text, b.query) WHERE NOT b.bordered
      UNION ALL
      SELECT b.query_id, d.doc_id, d.shard, len(list_filter(range(1, length(d.text) + 1), lambda i: substr(d.text, i, length(b.query)) = b.query)) AS n
      FROM b JOIN documents d ON contains(d.text, b.query) WHERE b.bordered)
"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("shard", "doc_id", "text")


@query(_COUNTS + "SELECT b.query_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS count FROM b LEFT JOIN c ON b.query_id = c.query_id GROUP BY b.query_id")
def count_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.count_many(_docs(spark, sf_dir), table(spark, sf_dir, "needles"))


@query(_COUNTS + "SELECT query_id, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs FROM c GROUP BY query_id")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.locate_many(_docs(spark, sf_dir), table(spark, sf_dir, "needles"))
    return found.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_docs"))


def _count_case(i: int, q: str) -> str:
    """SQL for the count of one needle; one that overlaps itself is tried at every position."""
    quoted = "chr(10)" if q == "\n" else f"'{q}'"
    n = f"len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, {len(q)}) = {quoted}))" if needle.overlaps_itself(q) else f"(length(text) - length(replace(text, {quoted}, ''))) // {len(q)}"
    return f"SELECT {i} AS case_id, CAST(coalesce(sum({n}), 0) AS BIGINT) AS count FROM documents"


@query(" UNION ALL ".join(_count_case(i, q) for i, q in enumerate(CASES)))
def count_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single needles as expressions: words, capitals, accents, line ends, overlaps, absent and pattern-like ones."""
    totals = _docs(spark, sf_dir).agg(*(F.coalesce(F.sum(needle.occurrences(F.col("text"), q)), F.lit(0)).alias(f"c{i}") for i, q in enumerate(CASES)))
    return totals.select(F.inline(F.array(*(F.struct(F.lit(i).alias("case_id"), F.col(f"c{i}").cast("long").alias("count")) for i in range(len(CASES))))))


@query("SELECT CAST(sum(strlen(text) + 1) + count(DISTINCT shard) AS BIGINT) AS count FROM documents")
def count_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.count(_docs(spark, sf_dir), "")


@query("SELECT shard, CAST(0 AS BIGINT) AS lo, CAST(sum(strlen(text) + 1) + 1 AS BIGINT) AS hi FROM documents WHERE text IS NOT NULL GROUP BY shard")
def find_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find(_docs(spark, sf_dir), "")


@query("SELECT shard, CAST(sum((length(text) - length(replace(text, 'the', ''))) // 3) AS BIGINT) AS count FROM documents GROUP BY shard")
def count_by_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("shard").agg(F.sum(needle.occurrences(F.col("text"), "the")).alias("count"))


_SUFFIXES = """h AS (SELECT shard, hex(encode(text)) AS x FROM documents WHERE text IS NOT NULL),
s AS (SELECT shard, substr(x, 2 * i + 1, 400) || 'FF' AS k FROM (SELECT shard, x, unnest(range(0, length(x) // 2)) AS i FROM h))"""
_FIND = f"""{_SUFFIXES},
u AS (SELECT shard, k, 1 AS is_suffix, CAST(NULL AS BIGINT) AS query_id, 0 AS n FROM s
      UNION ALL SELECT sh.shard, hex(encode(q.query)), 0, q.query_id, 0 FROM q, (SELECT DISTINCT shard FROM documents) sh
      UNION ALL SELECT sh.shard, hex(encode(q.query)) || 'G', 0, q.query_id, 1 FROM q, (SELECT DISTINCT shard FROM documents) sh),
r AS (SELECT shard, query_id, n, coalesce(sum(is_suffix) OVER (PARTITION BY shard ORDER BY k, is_suffix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u),
f AS (SELECT query_id, CAST(shard AS BIGINT) AS shard, CAST(min(before) AS BIGINT) AS lo, CAST(max(before) AS BIGINT) AS hi FROM r WHERE query_id IS NOT NULL GROUP BY query_id, shard)"""


@query(f"WITH q AS (SELECT DISTINCT query_id, query FROM needles WHERE query_id IS NOT NULL AND query IS NOT NULL AND query <> ''), {_FIND} SELECT query_id, shard, lo, hi FROM f")
def find_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank intervals of all needles in all shards."""
    return search.find_many(_docs(spark, sf_dir), table(spark, sf_dir, "needles"))


@query(f"WITH q AS (SELECT 0 AS query_id, 'the' AS query), {_FIND} SELECT shard, lo, hi FROM f")
def find_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find(_docs(spark, sf_dir), "the").withColumn("shard", F.col("shard").cast("long"))


@query(f"WITH q AS (SELECT 0 AS query_id, 'eht' AS query), {_FIND.replace('hex(encode(text)) AS x', 'hex(encode(reverse(text))) AS x')} SELECT shard, lo, hi FROM f")
def bidirectional_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of a needle read backwards among the suffixes of the reversed texts; together with find, the bidirectional interval."""
    turned = _docs(spark, sf_dir).withColumn("text", F.reverse("text"))
    return search.find(turned, "the"[::-1]).withColumn("shard", F.col("shard").cast("long"))


@query("SELECT doc_id, CASE WHEN substr(x, 201, 2) BETWEEN '80' AND 'BF' OR substr(x, 281, 2) BETWEEN '80' AND 'BF' THEN NULL ELSE TRY(decode(unhex(substr(x, 201, 80)))) END AS piece FROM (SELECT doc_id, hex(encode(text)) AS x FROM documents WHERE strlen(text) >= 140)")
def extract_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes 100 to 140 of every document that has them; null if the range cuts a character."""
    docs = _docs(spark, sf_dir).where(F.octet_length("text") >= 140)
    return docs.select("doc_id", F.try_validate_utf8(F.substring(F.encode("text", "UTF-8"), 101, 40).cast("string")).alias("piece"))


@query(f"WITH q AS (SELECT 0 AS query_id, 'é' AS query), {_FIND} SELECT CAST(sum(hi - lo) AS BIGINT) AS cnt, string_agg(lo || '-' || hi, ',' ORDER BY shard) AS segments FROM f")
def find_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of find as one row: count and segments in order of shard."""
    out = search.as_result(search.find(_docs(spark, sf_dir), "é"))
    return out.select("cnt", F.array_join(F.transform("segment_by_shard", lambda x: F.concat(x["lo"].cast("string"), F.lit("-"), x["hi"].cast("string"))), ",").alias("segments"))


@query(
    f"""WITH {_NEEDLES},
p AS (SELECT b.query_id, b.query, d.shard, d.doc_id, string_split(d.text, b.query) AS parts FROM b JOIN documents d ON contains(d.text, b.query) WHERE NOT b.bordered),
e AS (SELECT query_id, query, shard, doc_id, unnest(parts) AS part, unnest(range(0, len(parts))) AS i, len(parts) AS m FROM p),
w AS (SELECT *, sum(strlen(part)) OVER (PARTITION BY query_id, doc_id ORDER BY i) + i * strlen(query) AS pos FROM e)
SELECT query_id, CAST(shard AS BIGINT) AS shard, doc_id, CAST(pos AS BIGINT) AS pos FROM w WHERE i < m - 1
UNION ALL
SELECT query_id, CAST(shard AS BIGINT), doc_id, CAST(strlen(left(text, i - 1)) AS BIGINT) FROM (
  SELECT b.query_id, d.shard, d.doc_id, d.text, unnest(list_filter(range(1, length(d.text) + 1), lambda i: substr(d.text, i, length(b.query)) = b.query)) AS i
  FROM b JOIN documents d ON contains(d.text, b.query) WHERE b.bordered)"""
)
def locate_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.locate_many(_docs(spark, sf_dir), table(spark, sf_dir, "needles"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'salmon beside')")
def contains_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(F.contains("text", F.lit("salmon beside"))).select("doc_id")


_NUMBERED = """o AS (SELECT shard, doc_id, text, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS BIGINT) AS local_doc_ix,
  CAST(row_number() OVER (ORDER BY shard, doc_id) - 1 AS BIGINT) AS doc_ix,
  CAST(coalesce(sum(strlen(coalesce(text, '')) + 1) OVER (PARTITION BY shard ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS data_offset FROM documents)"""


@query(f"WITH {_NUMBERED} SELECT shard, doc_id, local_doc_ix, doc_ix, data_offset FROM o")
def doc_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.places(_docs(spark, sf_dir)).select("shard", "doc_id", "local_doc_ix", "doc_ix", "data_offset")


@query(
    f"""WITH {_NUMBERED}, z AS (SELECT shard, sum(strlen(coalesce(text, '')) + 1) AS n FROM documents GROUP BY shard),
p AS (SELECT shard, unnest(range(0, CAST(n AS BIGINT), 997)) AS ptr FROM z)
SELECT p.shard, p.ptr, o.doc_id, p.ptr - o.data_offset - 1 AS pos FROM p ASOF JOIN o ON p.shard = o.shard AND p.ptr >= o.data_offset"""
)
def ptr_to_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of every 997th byte of each shard's stream."""
    docs = corpus.number(_docs(spark, sf_dir)).select("shard", "doc_id", "data_offset", "text")
    ends = docs.groupBy("shard").agg(F.max(F.col("data_offset") + F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("n"))
    pointers = ends.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(997).cast("long"))).alias("ptr"))
    return corpus.doc_at(pointers, docs)


_MATCHES = f"""p AS (SELECT shard, doc_id, text, string_split(text, '{WORD}') AS parts FROM documents WHERE contains(text, '{WORD}')),
e AS (SELECT shard, doc_id, text, unnest(parts) AS part, unnest(range(0, len(parts))) AS i, len(parts) AS m FROM p),
m AS (SELECT shard, doc_id, hex(encode(text)) AS x, pos FROM (
  SELECT *, CAST(sum(strlen(part)) OVER (PARTITION BY doc_id ORDER BY i) + i * {len(WORD)} AS BIGINT) AS pos FROM e) WHERE i < m - 1),
k AS (SELECT *, strlen(x) // 2 AS doc_len, greatest(pos - {AROUND}, 0) AS a, least(pos + {len(WORD)} + {AROUND}, strlen(x) // 2) AS z FROM m),
c AS (SELECT *, z - a AS disp_len, pos - a AS needle_offset,
  substr(x, 2 * a + 1, 2) BETWEEN '80' AND 'BF' OR substr(x, 2 * z + 1, 2) BETWEEN '80' AND 'BF' AS cut FROM k),
w AS (SELECT shard, doc_id, pos, doc_len, disp_len, needle_offset, x, cut, CASE WHEN cut THEN NULL ELSE TRY(decode(unhex(substr(x, 2 * a + 1, 2 * (z - a))))) END AS text FROM c)"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).where(F.contains("text", F.lit(WORD)))
    return docs.select("shard", "doc_id", "text", F.explode(needle.positions(F.col("text"), WORD)).alias("pos"))


@query(f"WITH {_MATCHES} SELECT doc_id, pos, CAST(doc_len AS BIGINT) AS doc_len, CAST(disp_len AS BIGINT) AS disp_len, CAST(needle_offset AS BIGINT) AS needle_offset, text, cut AS has_error FROM w")
def kwic_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence in its context; a window that cuts a character has an error instead of a text."""
    rows = _matches(spark, sf_dir).select("doc_id", "pos", corpus.context(F.col("text"), F.col("pos"), F.lit(len(WORD)), AROUND).alias("c"))
    return rows.select("doc_id", "pos", "c.doc_len", "c.disp_len", "c.needle_offset", "c.text", F.col("c.error").isNotNull().alias("has_error"))


@query(
    f"""WITH q AS (SELECT 0 AS query_id, '{WORD}' AS query), {_FIND}, {_MATCHES}
SELECT CAST(w.shard AS BIGINT) AS shard, f.lo + row_number() OVER (PARTITION BY w.shard ORDER BY substr(x, 2 * pos + 1) || 'FF', doc_id, pos) - 1 AS rank, doc_id, pos, text
FROM w JOIN f ON w.shard = f.shard"""
)
def doc_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rank of a needle's interval: the document and its context. Equal suffixes are ranked by document."""
    rows = _matches(spark, sf_dir).withColumn("c", corpus.context(F.col("text"), F.col("pos"), F.lit(len(WORD)), AROUND))
    suffix = F.concat(F.substring(F.encode("text", "UTF-8"), F.col("pos").cast("int") + 1, F.lit(1 << 30)), F.unhex(F.lit("FF")))
    by = Window.partitionBy("shard").orderBy(suffix, "doc_id", "pos")
    ranked = rows.withColumn("r", F.row_number().over(by) - 1)
    lo = search.find(_docs(spark, sf_dir), WORD).select("shard", "lo")
    return ranked.join(F.broadcast(lo), "shard").select(F.col("shard").cast("long").alias("shard"), (F.col("lo") + F.col("r")).alias("rank"), "doc_id", "pos", "c.text")


@query(
    """WITH p AS (SELECT doc_id, string_split(text, 'harbour') AS parts FROM documents WHERE contains(text, 'harbour')),
e AS (SELECT doc_id, unnest(parts) AS part, unnest(range(0, len(parts))) AS i FROM p),
s AS (SELECT doc_id, 2 * i AS k, part AS text, CAST(NULL AS VARCHAR) AS label FROM e WHERE part <> '' UNION ALL SELECT doc_id, 2 * i - 1, 'harbour', '0' FROM e WHERE i > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS span_ix, text, label FROM s"""
)
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).where(F.contains("text", F.lit("harbour")))
    return docs.select("doc_id", F.posexplode(needle.highlight(F.col("text"), "harbour")).alias("span_ix", "s")).select("doc_id", "span_ix", "s.text", "s.label")


_ITEMS = "i AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL AND text <> ''), m AS (SELECT DISTINCT i.item_id, d.doc_id FROM i JOIN documents d ON contains(d.text, i.text))"


def _contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.locate_many(_docs(spark, sf_dir), items).select(F.col("query_id").alias("item_id"), "doc_id").distinct()


@query(f"WITH {_ITEMS} SELECT item_id, doc_id FROM m")
def benchmark_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that stand verbatim in a document."""
    return _contained(spark, sf_dir)


@query(f"WITH {_ITEMS} SELECT DISTINCT item_id, suite FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM m)")
def clean_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", "suite").distinct().join(_contained(spark, sf_dir), "item_id", "left_anti")


@query(
    f"""WITH {_ITEMS} SELECT b.suite, CAST(count(DISTINCT b.item_id) AS BIGINT) AS n_items, CAST(count(DISTINCT m.item_id) AS BIGINT) AS n_found,
round(count(DISTINCT m.item_id) / count(DISTINCT b.item_id), 6) AS rate FROM benchmark b LEFT JOIN m ON b.item_id = m.item_id GROUP BY b.suite"""
)
def contamination_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _contained(spark, sf_dir).select("item_id", F.col("item_id").alias("hit")).distinct()
    rows = table(spark, sf_dir, "benchmark").select("item_id", "suite").join(found, "item_id", "left").groupBy("suite")
    out = rows.agg(F.count_distinct("item_id").alias("n_items"), F.count_distinct("hit").alias("n_found"))
    return out.withColumn("rate", F.round(F.col("n_found") / F.col("n_items"), 6))
