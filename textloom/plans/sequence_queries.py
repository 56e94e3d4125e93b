"""Sequences, points, graphs, trees, bits and entropy: queries and SQL.

The sequence is the table of events in order of id: position ``event_id``, symbol the type or the user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import bits, entropy
from textloom.functions.storage import table
from textloom.operators import points, sequence
from textloom.operators.corpus import running_total
from textloom.plans.registry import query


def _seq(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.col(symbol).alias("sym"))


def _ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 100, 4000, 50), (2, 2500, 7000, 1000), (3, 0, 9999, 9000), (4, 500, 510, 3)], "range_id int, lo long, hi long, q long")


_R = "r(range_id, lo, hi, q) AS (VALUES (1, 100, 4000, 50), (2, 2500, 7000, 1000), (3, 0, 9999, 9000), (4, 500, 510, 3))"


@query("SELECT event_id AS i, event_type AS sym, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS BIGINT) AS rank FROM events")
def inverse_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.ranked(_seq(spark, sf_dir)).select("i", "sym", "rank")


@query("SELECT e.event_id AS i, e.event_type AS sym FROM events e JOIN (SELECT DISTINCT query_id FROM needles) n ON e.event_id = n.query_id")
def seq_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.access(_seq(spark, sf_dir), table(spark, sf_dir, "needles").select(F.col("query_id").alias("i")).distinct())


_ASKED = "a AS (SELECT DISTINCT l_orderkey AS i, CASE l_linenumber % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'nothing' END AS sym FROM lineitem WHERE l_orderkey < 9000)"


@query(f"WITH {_ASKED}, u AS (SELECT i * 2 AS o, sym, i, 0 AS w FROM a UNION ALL SELECT event_id * 2 + 1, event_type, NULL, 1 FROM events) SELECT i, sym, CAST(s AS BIGINT) AS rank FROM (SELECT i, sym, sum(w) OVER (PARTITION BY sym ORDER BY o) AS s FROM u) WHERE i IS NOT NULL")
def seq_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.rank(_seq(spark, sf_dir), _questions(spark, sf_dir).where("i < 9000"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sym = F.when(F.col("l_linenumber") % 3 == 0, "click").when(F.col("l_linenumber") % 3 == 1, "view").otherwise("nothing")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), sym.alias("sym")).distinct()


@query("SELECT CAST(k AS BIGINT) AS k, event_type AS sym, event_id AS i FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) WHERE k IN (SELECT query_id FROM needles)")
def seq_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "needles").select(F.col("query_id").alias("k")).distinct()
    asked = k.join(F.broadcast(spark.createDataFrame([(s,) for s in ("click", "view", "error", "signup", "purchase")], "sym string")))
    return sequence.select(_seq(spark, sf_dir), asked)


@query("SELECT count(*) FILTER (WHERE event_id < 1000 AND event_type = 'error') AS rank, count(*) FILTER (WHERE event_id >= 1000 AND event_type < 'error') AS smaller, count(*) FILTER (WHERE event_id >= 1000 AND event_type > 'error') AS greater FROM events WHERE event_id < 8000")
def lex_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.lex_count(_seq(spark, sf_dir), 1000, 8000, "error")


@query("SELECT count(*) FILTER (WHERE event_type = 'purchase') AS rank, count(*) FILTER (WHERE event_type < 'purchase') AS smaller FROM events WHERE event_id < 7777")
def lex_smaller_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.lex_smaller_count(_seq(spark, sf_dir), 7777, "purchase")


@query("SELECT user_id AS sym, count(*) FILTER (WHERE event_id < 2000) AS rank_lo, count(*) AS rank_hi FROM events WHERE event_id < 6000 GROUP BY user_id HAVING count(*) > count(*) FILTER (WHERE event_id < 2000)")
def interval_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.interval_symbols(_seq(spark, sf_dir, "user_id"), 2000, 6000)


@query(f"WITH {_R}, h AS (SELECT range_id, q, user_id AS sym, row_number() OVER (PARTITION BY range_id ORDER BY user_id) AS k, count(*) OVER (PARTITION BY range_id, user_id) AS freq FROM r JOIN events ON event_id BETWEEN lo AND hi) SELECT range_id, sym, freq FROM h WHERE k = q + 1")
def quantile_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.quantile_freq(_seq(spark, sf_dir, "user_id"), _ranges(spark))


@query(f"WITH {_R} SELECT user_id AS sym, count(DISTINCT range_id) AS n_ranges, count(*) AS freq FROM r JOIN events ON event_id BETWEEN lo AND hi GROUP BY user_id HAVING count(DISTINCT range_id) >= 3")
def intersect_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.intersect(_seq(spark, sf_dir, "user_id"), _ranges(spark), 3)


@query("SELECT event_id AS i, user_id AS sym FROM events WHERE event_id BETWEEN 100 AND 5000 AND user_id BETWEEN 20 AND 30")
def range_search_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.range_search_2d(_seq(spark, sf_dir, "user_id"), 100, 5000, 20, 30)


@query("SELECT DISTINCT user_id AS sym FROM events WHERE event_id BETWEEN 100 AND 500 AND user_id BETWEEN 20 AND 90")
def unique_range_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.unique_range_values(_seq(spark, sf_dir, "user_id"), 100, 500, 20, 90)


@query("SELECT c, (SELECT max(l_suppkey * 7) FROM lineitem WHERE l_suppkey * 7 <= c) AS lte, (SELECT min(l_suppkey * 7) FROM lineitem WHERE l_suppkey * 7 >= c) AS gte FROM (SELECT DISTINCT query_id * 3 AS c FROM needles)")
def symbol_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 7).alias("sym"))
    return sequence.symbol_bounds(seq, table(spark, sf_dir, "needles").select((F.col("query_id") * 3).alias("c")).distinct())


@query("WITH v AS (SELECT DISTINCT o_custkey * 5 AS value FROM orders), q AS (SELECT DISTINCT p_partkey * 3 AS x FROM part) SELECT q.x, p.value AS predecessor, s.value AS successor FROM q ASOF LEFT JOIN v p ON q.x >= p.value ASOF LEFT JOIN v s ON q.x <= s.value")
def predecessor_successor(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 5).alias("value"))
    return sequence.neighbours(values, table(spark, sf_dir, "part").select((F.col("p_partkey") * 3).alias("x")))


@query(f"WITH {_R}, h AS (SELECT range_id, event_id AS i, value AS v, row_number() OVER (PARTITION BY range_id ORDER BY value, event_id) AS k FROM r JOIN events ON event_id BETWEEN lo AND hi) SELECT range_id, i, v FROM h WHERE k = 1")
def range_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.range_minimum(table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.col("value").alias("v")), _ranges(spark))


@query("WITH e AS (SELECT event_id AS i, value AS v FROM events) SELECT a.i, a.v, max(b.i) FILTER (WHERE b.i < a.i) AS prev, min(b.i) FILTER (WHERE b.i > a.i) AS next FROM e a LEFT JOIN e b ON b.v < a.v GROUP BY a.i, a.v")
def smaller_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.smaller_neighbours(table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.col("value").alias("v")), block=1024)


_B = "b AS (SELECT event_id AS i, CASE WHEN event_type IN ('click', 'error') THEN 1 ELSE 0 END AS bit, lag(CASE WHEN event_type IN ('click', 'error') THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS before FROM events)"


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = F.when(F.col("event_type").isin("click", "error"), 1).otherwise(0)
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), bit.alias("bit"), F.lit(0).alias("one"))
    before = rows.select((F.col("i") + 1).alias("i"), F.col("bit").alias("before"))
    return rows.join(before, "i", "left")


@query(f"WITH {_B} SELECT i, CAST(coalesce(sum(bit) OVER w, 0) AS BIGINT) AS rank1, CAST(i - coalesce(sum(bit) OVER w, 0) AS BIGINT) AS rank0, CAST(coalesce(sum(CASE WHEN before = 0 AND bit = 1 THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS rank01 FROM b WINDOW w AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def bit_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ones, zeros and patterns 01 before each position; two-level running totals."""
    rows = running_total(_bits(spark, sf_dir), F.col("bit").cast("long"), "i", "rank1", group="one")
    rows = running_total(rows, F.when((F.col("before") == 0) & (F.col("bit") == 1), 1).otherwise(0).cast("long"), "i", "rank01", group="one")
    return rows.select("i", "rank1", (F.col("i") - F.col("rank1")).alias("rank0"), "rank01")


@query(f"WITH {_B} SELECT i, CAST(coalesce(sum(CASE WHEN before = 0 AND bit = 0 THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS rank00, CAST(coalesce(sum(CASE WHEN before = 1 AND bit = 0 THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS rank10, CAST(coalesce(sum(CASE WHEN before = 1 AND bit = 1 THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS rank11 FROM b WINDOW w AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def bit_rank_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns 00, 10 and 11 that end before each position (01 is in ``bit_rank``); the first bit ends none."""
    rows = _bits(spark, sf_dir)
    for a, b in ("00", "10", "11"):
        hit = (F.col("before") == int(a)) & (F.col("bit") == int(b))
        rows = running_total(rows, F.when(hit, 1).otherwise(0).cast("long"), "i", f"rank{a}{b}", group="one")
    return rows.select("i", "rank00", "rank10", "rank11")


@query(f"WITH {_B} SELECT CAST(row_number() OVER (ORDER BY i) AS BIGINT) AS k, i FROM b WHERE bit = 1")
def bit_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    ones = _bits(spark, sf_dir).where("bit = 1")
    return running_total(ones, F.lit(1).cast("long"), "i", "k", group="one").select((F.col("k") + 1).alias("k"), "i")


@query(f"WITH {_B} SELECT CAST(row_number() OVER (ORDER BY i) AS BIGINT) AS k, i FROM b WHERE bit = 0")
def bit_select_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    zeros = _bits(spark, sf_dir).where("bit = 0")
    return running_total(zeros, F.lit(1).cast("long"), "i", "k", group="one").select((F.col("k") + 1).alias("k"), "i")


@query("SELECT p_partkey AS x, reverse(lpad(bin(p_partkey), 64, '0')) AS turned FROM part")
def word_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("x"), bits.reversed_word(F.col("p_partkey")).alias("turned"))


@query("SELECT p_partkey + 1 AS x, repeat('0', length(bin(p_partkey + 1)) - 1) || bin(p_partkey + 1) AS code, p_partkey + 1 AS decoded FROM part")
def gamma_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elias gamma codes, there and back."""
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("x")).withColumn("code", bits.gamma_code(F.col("x")))
    return rows.withColumn("decoded", bits.gamma_value(F.col("code")))


@query(
    """WITH RECURSIVE f(a, b) AS (SELECT CAST(1 AS BIGINT), CAST(2 AS BIGINT) UNION ALL SELECT b, a + b FROM f WHERE b < 1000000000000)
SELECT p_partkey + 1 AS x, CAST(count(f.a) + 1 AS INTEGER) AS bits FROM part LEFT JOIN f ON f.a <= p_partkey + 1 GROUP BY p_partkey"""
)
def fibonacci_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_partkey") + 1
    return table(spark, sf_dir, "part").select(x.alias("x"), bits.fibonacci_length(x).alias("bits"))


@query("SELECT p_partkey AS x, CAST(bit_count(p_partkey) AS INTEGER) AS ones, CAST(length(bin(p_partkey)) - 1 AS INTEGER) AS hi, CAST(CASE WHEN p_partkey = 0 THEN 0 ELSE length(bin(p_partkey)) - length(rtrim(bin(p_partkey), '0')) END AS INTEGER) AS lo, CAST(list_position(string_split(reverse(bin(p_partkey)), ''), '1') - 1 AS INTEGER) AS first_one, CAST((length(bin(p_partkey)) - length(replace(bin(p_partkey), '10', ''))) // 2 AS INTEGER) AS n10 FROM part")
def word_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("x"))
    return rows.select("x", bits.popcount(x).alias("ones"), bits.highest_bit(x).alias("hi"), bits.lowest_bit(x).alias("lo"), bits.select_in_word(x, 1).alias("first_one"), bits.pattern_count(x, "10").alias("n10"))


@query("SELECT x, CAST(2 * n + 1 AS INTEGER) AS gamma, CAST(n + 2 * (length(bin(n + 1)) - 1) + 1 AS INTEGER) AS delta FROM (SELECT p_partkey + 1 AS x, length(bin(p_partkey + 1)) - 1 AS n FROM part)")
def code_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("x"))
    return rows.select("x", bits.gamma_length(F.col("x")).cast("int").alias("gamma"), bits.delta_length(F.col("x")).cast("int").alias("delta"))


@query("SELECT event_id AS i, user_id % 7 AS value, CAST(max(CASE WHEN user_id % 7 = 0 THEN event_id END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS prev_zero, CAST(min(CASE WHEN user_id % 7 = 0 THEN event_id END) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS next_zero FROM events")
def next_and_previous_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector modulo 7, and for each position the nearest zeros before and after it."""
    v = table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.pmod("user_id", F.lit(7)).alias("value"))
    near = sequence.neighbours(v.where("value = 0").select(F.col("i").alias("value")), v.select(F.col("i").alias("x")))
    return v.join(near, v["i"] == near["x"]).select("i", "value", F.col("predecessor").alias("prev_zero"), F.col("successor").alias("next_zero"))


@query("SELECT CAST(row_number() OVER (ORDER BY value, event_id) - 1 AS BIGINT) AS i, event_id AS p FROM events")
def inverse_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The permutation that sorts the events by value, and its inverse by swapping columns."""
    order = running_total(table(spark, sf_dir, "events").select("event_id", F.rint(F.col("value") * 100).cast("long").alias("key"), F.lit(0).alias("one")).withColumn("key", F.col("key") * (1 << 32) + F.col("event_id")), F.lit(1).cast("long"), "key", "position", group="one")
    return order.select(F.col("position").alias("i"), F.col("event_id").alias("p"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_extendedprice").alias("w"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))


@query("SELECT l_partkey AS x, l_suppkey AS y, l_extendedprice AS w FROM lineitem WHERE l_partkey BETWEEN 100 AND 900 AND l_suppkey BETWEEN 10 AND 60 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 25")
def points_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.top_k(_points(spark, sf_dir), (100, 900), (10, 60), 25, "o", "n", "x", "y").select("x", "y", "w")


@query("SELECT l_partkey AS x, l_suppkey AS y, l_extendedprice AS w FROM lineitem WHERE l_partkey BETWEEN 100 AND 900 AND l_suppkey BETWEEN 10 AND 60 AND l_extendedprice BETWEEN 20000 AND 30000")
def points_range3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).where(points.inside((100, 900), (10, 60), (20000, 30000))).select("x", "y", "w")


@query("SELECT b.box_id, count(l.l_partkey) AS n FROM (VALUES (1, 0, 100, 0, 50), (2, 500, 1500, 20, 40), (3, -5, -1, 0, 9)) b(box_id, x1, x2, y1, y2) LEFT JOIN lineitem l ON l_partkey BETWEEN x1 AND x2 AND l_suppkey BETWEEN y1 AND y2 GROUP BY b.box_id")
def points_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spark.createDataFrame([(1, 0, 100, 0, 50), (2, 500, 1500, 20, 40), (3, -5, -1, 0, 9)], "box_id int, x1 int, x2 int, y1 int, y2 int")
    return points.count_in(_points(spark, sf_dir), boxes)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


@query("SELECT p.p_partkey AS src, CAST(p.p_size AS BIGINT) AS dst, max(l.l_partkey) IS NOT NULL AS adjacent FROM part p LEFT JOIN lineitem l ON l.l_partkey = p.p_partkey AND l.l_suppkey = p.p_size GROUP BY 1, 2")
def graph_adj(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.adjacent(_edges(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), F.col("p_size").cast("long").alias("dst")))


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey IN (SELECT query_id FROM needles)")
def graph_neigh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.neighbours_of(_edges(spark, sf_dir), table(spark, sf_dir, "needles").select(F.col("query_id").alias("src")))


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_suppkey IN (SELECT query_id FROM needles)")
def graph_reverse_neigh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.sources_of(_edges(spark, sf_dir), table(spark, sf_dir, "needles").select(F.col("query_id").alias("dst")))


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey BETWEEN 10 AND 60 AND l_suppkey BETWEEN 5 AND 30")
def graph_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).where(F.col("src").between(10, 60) & F.col("dst").between(5, 30)).distinct()


_TREE = "t(node, parent) AS (SELECT 'w', NULL UNION ALL SELECT 'r' || r_regionkey, 'w' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"


@query(f"WITH RECURSIVE {_TREE}, l AS (SELECT node, parent, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.node, t.parent, l.depth + 1 FROM t JOIN l ON t.parent = l.node), d AS (SELECT parent AS node, count(*) AS degree FROM t WHERE parent IS NOT NULL GROUP BY 1) SELECT l.node, l.parent, l.depth, CAST(coalesce(d.degree, 0) AS BIGINT) AS degree FROM l LEFT JOIN d ON l.node = d.node")
def tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent, depth and degree of every node of the tree world - region - nation - customer."""
    c = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    tree = spark.createDataFrame([("w", None)], "node string, parent string")
    tree = tree.unionByName(table(spark, sf_dir, "region").select(c("r", "r_regionkey").alias("node"), F.lit("w").alias("parent")))
    tree = tree.unionByName(table(spark, sf_dir, "nation").select(c("n", "n_nationkey").alias("node"), c("r", "n_regionkey").alias("parent")))
    tree = tree.unionByName(table(spark, sf_dir, "customer").select(c("c", "c_custkey").alias("node"), c("n", "c_nationkey").alias("parent")))
    degree = tree.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return points.levels(tree, "w").join(degree, "node", "left").fillna(0, ["degree"])


_PLACES = """c AS (SELECT n.n_regionkey AS r, n.n_nationkey AS n, c.c_custkey AS c FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
k AS (SELECT 0 AS depth, CAST(0 AS BIGINT) AS key, CAST(NULL AS BIGINT) AS up UNION ALL SELECT 1, (r_regionkey + 1) * 1000000000000, 0 FROM region
  UNION ALL SELECT 2, (n_regionkey + 1) * 1000000000000 + (n_nationkey + 1) * CAST(1000000000 AS BIGINT), (n_regionkey + 1) * 1000000000000 FROM nation
  UNION ALL SELECT 3, (r + 1) * 1000000000000 + (n + 1) * CAST(1000000000 AS BIGINT) + c + 1, (r + 1) * 1000000000000 + (n + 1) * CAST(1000000000 AS BIGINT) FROM c),
z AS (SELECT depth, key, up, row_number() OVER (ORDER BY key) - 1 AS pre, CASE depth WHEN 3 THEN 1 WHEN 0 THEN (SELECT count(*) FROM k) ELSE
  (SELECT count(*) FROM k b WHERE b.key >= a.key AND b.key < a.key + CASE a.depth WHEN 1 THEN 1000000000000 ELSE 1000000000 END) END AS size FROM k a),
o AS (SELECT *, 2 * pre - depth AS open FROM z)"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``depth, key``: world, regions, nations and customers; keys are in preorder."""
    r, n = F.lit(10**12).cast("long"), F.lit(10**9).cast("long")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", ((F.col("n_regionkey") + 1) * r + (F.col("n_nationkey") + 1) * n).alias("key"))
    customer = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = spark.range(1).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("key"))
    rows = rows.unionByName(table(spark, sf_dir, "region").select(F.lit(1).alias("depth"), ((F.col("r_regionkey") + 1) * r).alias("key")))
    rows = rows.unionByName(nation.select(F.lit(2).alias("depth"), "key"))
    return rows.unionByName(customer.select(F.lit(3).alias("depth"), (F.col("key") + F.col("c_custkey") + 1).alias("key")))


@query(f"WITH {_PLACES} SELECT o.open AS i, CAST(o.depth + 1 AS BIGINT) AS excess, CAST(o.open + 2 * o.size - 1 AS BIGINT) AS match, p.open AS enclose FROM o LEFT JOIN o p ON o.up = p.key")
def parentheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of places as balanced parentheses: excess, matching and enclosing positions of every node."""
    return _parentheses(spark, sf_dir)


def _parentheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = running_total(_places(spark, sf_dir).withColumn("one", F.lit(0)), F.lit(1).cast("long"), "key", "pre", group="one")
    opened = rows.select((2 * F.col("pre") - F.col("depth")).alias("i"), F.lit(1).alias("bit"), "pre", "depth")
    # What is not an opening position closes: a tree of n nodes has 2 n of them.
    every = spark.range(2 * rows.count()).select(F.col("id").alias("i"))
    return points.parentheses(every.join(opened.select("i", "bit"), "i", "left").fillna(0, ["bit"]), block=256)


@query(f"WITH {_PLACES} SELECT CAST(o.open + 2 * o.size - 1 AS BIGINT) AS close, o.open FROM o")
def parentheses_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opening partner of every closing parenthesis of the same tree."""
    return points.matched(_parentheses(spark, sf_dir))


@query(f"WITH {_PLACES}, d AS (SELECT up AS key, count(*) AS degree FROM k WHERE up IS NOT NULL GROUP BY 1), b AS (SELECT k.key, coalesce(degree, 0) AS degree, row_number() OVER (ORDER BY depth, k.key) - 1 AS ix FROM k LEFT JOIN d ON k.key = d.key) SELECT key AS node, ix, CAST(degree AS BIGINT) AS degree, CAST(coalesce(sum(degree + 1) OVER (ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(degree + 1) OVER (ORDER BY ix) - 1 AS BIGINT) AS stop FROM b")
def louds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tree in level order: each node's block in the unary degree string."""
    k = _places(spark, sf_dir)
    up = F.when(F.col("depth") == 1, 0).when(F.col("depth") == 2, F.col("key") - F.col("key") % 10**12).otherwise(F.col("key") - F.col("key") % 10**9)
    degree = k.where("depth > 0").groupBy(up.cast("long").alias("key")).agg(F.count(F.lit(1)).alias("degree"))
    rows = k.join(degree, "key", "left").fillna(0, ["degree"]).withColumn("order", F.col("depth") * F.lit(10**14) + F.col("key")).withColumn("one", F.lit(0))
    rows = running_total(rows, F.lit(1).cast("long"), "order", "ix", group="one", slots=64)
    return points.louds(rows.select(F.col("key").alias("node"), "ix", "degree"))


_BYTES = "h AS (SELECT hex(encode(text)) AS x FROM documents WHERE text IS NOT NULL), g AS (SELECT substr(x, 2 * unnest(range(0, length(x) // 2 - {k})) + 1, {w}) AS g FROM h), c AS (SELECT left(g, {c}) AS context, g, count(*) AS n FROM g GROUP BY 1, 2), t AS (SELECT context, sum(n) AS t, sum(n * log2(n)) AS s FROM c GROUP BY 1)"


@query("WITH " + _BYTES.format(k=0, w=2, c=0) + " SELECT g AS symbol, CAST(n AS BIGINT) AS n FROM c")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.gram_counts(table(spark, sf_dir, "documents"), 0).select(F.lpad(F.hex("symbol"), 2, "0").alias("symbol"), "n")


@query("SELECT ch, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '') GROUP BY ch")
def char_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = table(spark, sf_dir, "documents").where("text <> ''").select(F.explode(F.split("text", "", -1)).alias("ch")).where("ch <> ''")
    return chars.groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + _BYTES.format(k=0, w=2, c=0) + " SELECT round(sum(t * log2(t) - s) / sum(t), 6) AS entropy, CAST(count(*) AS BIGINT) AS contexts FROM t")
def entropy_h0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.conditional_entropy(entropy.gram_counts(table(spark, sf_dir, "documents"), 0)).select(F.round("entropy", 6).alias("entropy"), "contexts")


@query(
    """WITH p AS (SELECT doc_id, string_split(text, 'the ') AS parts FROM documents WHERE contains(text, 'the ')),
e AS (SELECT unnest(parts[2:]) AS part, unnest(range(2, len(parts) + 1)) AS i, len(parts) AS m FROM p),
n AS (SELECT CASE WHEN part <> '' THEN left(hex(encode(part)), 2) WHEN i < m THEN '74' END AS b FROM e), c AS (SELECT b, count(*) AS n FROM n WHERE b IS NOT NULL GROUP BY b)
SELECT -sum(n / t * log2(n / t)) AS entropy, CAST(min(t) AS BIGINT) AS followed FROM c, (SELECT sum(n) AS t FROM c) x"""
)
def entropy_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the byte that follows a context."""
    word = int.from_bytes(b"the ", "big")
    n = entropy.gram_counts(table(spark, sf_dir, "documents"), 4).where(F.col("context") == word)
    return entropy.conditional_entropy(n).join(n.agg(F.sum("n").alias("followed"))).select("entropy", "followed")


@query("WITH " + _BYTES.format(k=3, w=8, c=6) + " SELECT round(sum(t * log2(t) - s) / sum(t), 6) AS entropy, CAST(count(*) AS BIGINT) AS contexts FROM t")
def entropy_hk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of a byte given the three before it, and the number of contexts."""
    return entropy.conditional_entropy(entropy.gram_counts(table(spark, sf_dir, "documents"), 3)).select(F.round("entropy", 6).alias("entropy"), "contexts")


# The queries above ask about the beginning of the sequence. Those below ask the same of the whole of it: every row of lineitem, and ranges by its size.


def _size(seq: DataFrame) -> int:
    return (seq.agg(F.max("i")).first()[0] or 0) + 1


def _parts(seq: DataFrame) -> DataFrame:
    """Four ranges from the first position to the last: everything, the middle half, the second half and the last tenth; q is their median."""
    n = _size(seq)
    bounds = [(0, n - 1), (n // 4, 3 * n // 4), (n // 2, n - 1), (n - 1 - n // 10, n - 1)]
    return seq.sparkSession.createDataFrame([(k + 1, lo, hi, (hi - lo) // 2) for k, (lo, hi) in enumerate(bounds)], "range_id int, lo long, hi long, q long")


_N = "n AS (SELECT max(event_id) + 1 AS n FROM events)"
_P = f"""{_N}, b(range_id, lo, hi) AS (SELECT 1, 0, n - 1 FROM n UNION ALL SELECT 2, n // 4, 3 * n // 4 FROM n UNION ALL SELECT 3, n // 2, n - 1 FROM n UNION ALL SELECT 4, n - 1 - n // 10, n - 1 FROM n),
r AS (SELECT *, (hi - lo) // 2 AS q FROM b)"""


@query(f"WITH {_ASKED.replace(' WHERE l_orderkey < 9000', '')}, u AS (SELECT i * 2 AS o, sym, i, 0 AS w FROM a UNION ALL SELECT event_id * 2 + 1, event_type, NULL, 1 FROM events) SELECT i, sym, CAST(s AS BIGINT) AS rank FROM (SELECT i, sym, sum(w) OVER (PARTITION BY sym ORDER BY o) AS s FROM u) WHERE i IS NOT NULL")
def seq_rank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every row of lineitem; beyond the end of the sequence the rank is the full count."""
    return sequence.rank(_seq(spark, sf_dir), _questions(spark, sf_dir))


@query(f"WITH {_N} SELECT count(*) FILTER (WHERE event_id < n // 4 AND event_type = 'error') AS rank, count(*) FILTER (WHERE event_id >= n // 4 AND event_type < 'error') AS smaller, count(*) FILTER (WHERE event_id >= n // 4 AND event_type > 'error') AS greater FROM events, n")
def lex_count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = _seq(spark, sf_dir)
    n = _size(seq)
    return sequence.lex_count(seq, n // 4, n, "error")


@query("SELECT count(*) FILTER (WHERE event_type = 'purchase') AS rank, count(*) FILTER (WHERE event_type < 'purchase') AS smaller FROM events")
def lex_smaller_count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = _seq(spark, sf_dir)
    return sequence.lex_smaller_count(seq, _size(seq), "purchase")


@query(f"WITH {_N} SELECT user_id AS sym, count(*) FILTER (WHERE event_id < n // 4) AS rank_lo, count(*) AS rank_hi FROM events, n GROUP BY user_id HAVING count(*) > count(*) FILTER (WHERE event_id < n // 4)")
def interval_symbols_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = _seq(spark, sf_dir, "user_id")
    n = _size(seq)
    return sequence.interval_symbols(seq, n // 4, n)


@query(f"WITH {_P}, h AS (SELECT range_id, q, user_id AS sym, row_number() OVER (PARTITION BY range_id ORDER BY user_id) AS k, count(*) OVER (PARTITION BY range_id, user_id) AS freq FROM r JOIN events ON event_id BETWEEN lo AND hi) SELECT range_id, sym, freq FROM h WHERE k = q + 1")
def quantile_freq_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = _seq(spark, sf_dir, "user_id")
    return sequence.quantile_freq(seq, _parts(seq))


@query(f"WITH {_P} SELECT user_id AS sym, count(DISTINCT range_id) AS n_ranges, count(*) AS freq FROM r JOIN events ON event_id BETWEEN lo AND hi GROUP BY user_id HAVING count(DISTINCT range_id) >= 3")
def intersect_ranges_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = _seq(spark, sf_dir, "user_id")
    return sequence.intersect(seq, _parts(seq), 3)


@query("SELECT event_id AS i, user_id AS sym FROM events WHERE user_id BETWEEN 20 AND 30")
def range_search_2d_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = _seq(spark, sf_dir, "user_id")
    return sequence.range_search_2d(seq, 0, _size(seq) - 1, 20, 30)


@query("SELECT DISTINCT user_id AS sym FROM events WHERE user_id BETWEEN 20 AND 90")
def unique_range_values_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = _seq(spark, sf_dir, "user_id")
    return sequence.unique_range_values(seq, 0, _size(seq) - 1, 20, 90)


@query(f"WITH {_P}, h AS (SELECT range_id, event_id AS i, value AS v, row_number() OVER (PARTITION BY range_id ORDER BY value, event_id) AS k FROM r JOIN events ON event_id BETWEEN lo AND hi) SELECT range_id, i, v FROM h WHERE k = 1")
def range_minimum_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.col("value").alias("v"))
    return sequence.range_minimum(seq, _parts(seq))
