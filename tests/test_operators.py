"""Operators on small, hand-checked inputs, and the edges of their domains."""

import gzip
import json

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import entropy
from textloom.operators import corpus, needle, points, search, sequence, suffix
from textloom.plans.corpus import Corpus, Registry
from textloom.sources import jsonl
from textloom.streaming import ingest

TEXTS = [(0, 0, "aaaa"), (0, 1, "xaab"), (1, 2, "q"), (1, 3, ""), (1, 4, None), (2, 5, "The quick brown fox was very quick."), (2, 6, "xéy 日本語"), (2, 7, "a.b*c \\Q..\\E $1")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x") for r in TEXTS], "shard int, doc_id long, text string, lo string")


def streams():
    out = {}
    for shard, _, t in TEXTS:
        if t is not None:
            out[shard] = out.get(shard, b"") + b"\xff" + t.encode()
    return {s: b + b"\xfa" for s, b in out.items()}


def overlapping(data, q):
    return sum(data.startswith(q, i) for i in range(len(data)))


QUERIES = ["aa", "a", "quick", "the", "é", "語", "\\E", ".b*", "$1", "zz", "The quick brown fox was very quick.", "quick."]


@pytest.mark.parametrize("q", QUERIES)
def test_single_needles(docs, q):
    data = streams()
    n = {s: overlapping(d, q.encode()) for s, d in data.items()}
    lo = {s: sum(d[i:] < q.encode() for i in range(len(d))) for s, d in data.items()}
    assert search.count(docs, q).first()["count"] == sum(n.values())
    assert {r["shard"]: (r["lo"], r["hi"]) for r in search.find(docs, q).collect()} == {s: (lo[s], lo[s] + n[s]) for s in data}
    assert search.as_result(search.find(docs, q)).first()["cnt"] == sum(n.values())


def test_many_needles(spark, docs, monkeypatch):
    needles = spark.createDataFrame([*enumerate(QUERIES), (90, None), (91, ""), (None, "a"), (0, "aa")], "query_id long, query string")
    data = streams()
    want = {(i, s): (lo := sum(d[k:] < q.encode() for k in range(len(d))), lo + overlapping(d, q.encode())) for i, q in enumerate(QUERIES) for s, d in data.items()}
    for size in (1 << 20, 100):
        monkeypatch.setattr(search, "NEEDLE_BYTES", size)
        assert {(r["query_id"], r["shard"]): (r["lo"], r["hi"]) for r in search.find_many(docs, needles).collect()} == want
    at = {(r["query_id"], r["doc_id"], r["pos"]) for r in search.locate_many(docs, needles).collect()}
    assert at == {(i, d, k) for i, q in enumerate(QUERIES) for _, d, t in TEXTS if t for k in range(len(t.encode())) if t.encode().startswith(q.encode(), k)}
    assert search.count_many(docs, needles.limit(0)).count() == 0 and search.find_many(docs.limit(0), needles).count() == 0


def test_empty_needle(docs):
    assert search.count(docs, "").first()["count"] == sum(map(len, streams().values()))
    assert {r["shard"]: r["hi"] for r in search.find(docs, "").collect()} == {s: len(d) for s, d in streams().items()}
    assert search.count(docs.limit(0), "").first()["count"] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab\x00é", max_size=12), max_size=5), st.text("ab\x00é", min_size=1, max_size=10))
def test_block(texts, q):
    block = search.Block([t.encode() for t in texts])
    data = b"\xff" + b"\xff".join(t.encode() for t in texts) + b"\xff"
    lo, at = block.interval(q.encode())
    assert sorted(at.tolist()) == [i for i in range(len(data)) if data.startswith(q.encode(), i)]
    assert lo == sum(data[i:] + b"\xff" * 20 < q.encode() for i in range(len(data)))


def test_overlap_rule():
    for q in ("aa", "aba", "abab", "abcab"):
        assert needle.overlaps_itself(q)
    for q in ("a", "ab", "aab", "the", ""):
        assert not needle.overlaps_itself(q)


def test_positions_and_spans(docs):
    row = docs.where("doc_id = 5").select(needle.positions(F.col("text"), "quick").alias("p"), needle.highlight(F.col("text"), "quick").alias("s")).first()
    assert row["p"] == [4, 29]
    assert [tuple(x) for x in row["s"]] == [("The ", None), ("quick", "0"), (" brown fox was very ", None), ("quick", "0"), (".", None)]
    odd = docs.where("doc_id = 7").select(needle.highlight(F.col("text"), "\\E").alias("s")).first()["s"]
    assert [x["text"] for x in odd] == ["a.b*c \\Q..", "\\E", " $1"]


def test_numbering_and_lookup(docs):
    rows = {r["doc_id"]: r for r in corpus.number(docs).collect()}
    assert [rows[i]["doc_ix"] for i in range(8)] == list(range(8))
    assert [rows[i]["local_doc_ix"] for i in range(8)] == [0, 1, 0, 1, 2, 0, 1, 2]
    assert [rows[i]["data_offset"] for i in range(8)] == [0, 5, 0, 2, 3, 0, 36, 51]
    p = docs.sparkSession.createDataFrame([(0, 0), (0, 4), (0, 5), (0, 9), (2, 40), (9, 1)], "shard int, ptr long")
    for width in (1 << 16, 3):
        assert {(r["shard"], r["ptr"], r["doc_id"], r["pos"]) for r in corpus.doc_at(p, corpus.number(docs), width).collect()} == {(0, 0, 0, -1), (0, 4, 0, 3), (0, 5, 1, -1), (0, 9, 1, 3), (2, 40, 6, 3)}


def test_context_cuts_characters(docs):
    row = docs.where("doc_id = 6")
    ok = row.select(corpus.context(F.col("text"), F.lit(3), F.lit(1), 4).alias("c")).first()["c"]
    cut = row.select(corpus.context(F.col("text"), F.lit(3), F.lit(1), 1).alias("c")).first()["c"]
    assert tuple(ok) == (14, 8, 3, "xéy 日", None)
    assert cut["text"] is None and cut["error"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab\n", max_size=9), min_size=1, max_size=4))
def test_suffix_array(spark, texts):
    d = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "shard int, doc_id long, text string")
    data = b"".join(b"\xff" + t.encode() for t in texts) + b"\xfa"
    sa = sorted(range(len(data)), key=lambda i: data[i:])
    rows = suffix.suffix_array(d)
    got = rows.orderBy("rank").collect()
    assert [r["ptr"] for r in got] == sa and [r["bwt"] for r in got] == [data[i - 1] for i in sa]
    lcps = [r["lcp"] for r in suffix.lcp(rows).orderBy("rank").collect()]
    assert lcps == [0] + [next(k for k in range(len(data) + 1) if data[a + k : a + k + 1] != data[b + k : b + k + 1]) for a, b in zip(sa, sa[1:])]


def test_suffix_ties_longer_than_a_head(spark):
    t = "abcdefgh" * 12
    d = spark.createDataFrame([(0, 0, t), (0, 1, t), (0, 2, t + "x")], "shard int, doc_id long, text string")
    data = b"".join(b"\xff" + x.encode() for x in (t, t, t + "x")) + b"\xfa"
    assert [r["ptr"] for r in suffix.suffix_array(d).orderBy("rank").collect()] == sorted(range(len(data)), key=lambda i: data[i:])


def test_tree_nodes(spark):
    lcps = spark.createDataFrame([(0, i, v) for i, v in enumerate([0, 1, 3, 0, 0, 2])], "shard long, rank long, lcp long")
    tree = suffix.nodes(lcps)
    assert {(r["lb"], r["rb"], r["depth"]) for r in tree.collect()} == {(0, 5, 0), (0, 2, 1), (1, 2, 3), (4, 5, 2)}
    up = {(r["lb"], r["rb"]): (r["parent_lb"], r["parent_rb"]) for r in suffix.parents(tree).collect()}
    assert up == {(0, 5): (None, None), (0, 2): (0, 5), (1, 2): (0, 2), (4, 5): (0, 5)}


def test_smaller_neighbours_across_blocks(spark):
    v = [5, 3, 3, 8, 1, 9, 9, 2, 7, 1, 4]
    rows = sequence.smaller_neighbours(spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double"), block=3).collect()
    for r in rows:
        assert r["prev"] == max((j for j in range(r["i"]) if v[j] < r["v"]), default=None)
        assert r["next"] == min((j for j in range(r["i"] + 1, len(v)) if v[j] < r["v"]), default=None)


def test_running_total_of_a_hot_group(spark):
    d = spark.range(1000).select(F.lit(0).alias("shard"), F.col("id").alias("doc_id"))
    got = [r["t"] for r in corpus.running_total(d, F.col("doc_id"), "doc_id", "t", slots=7).orderBy("doc_id").collect()]
    assert got == [i * (i - 1) // 2 for i in range(1000)]


def test_points(spark):
    p = spark.createDataFrame([(x, y, float(x * y)) for x in range(5) for y in range(5)], "x int, y int, w double")
    assert [r["w"] for r in points.top_k(p, (1, 3), (1, 3), 2, "x", "y").collect()] == [9.0, 6.0]
    boxes = spark.createDataFrame([(1, 0, 1, 0, 1), (2, 9, 9, 9, 9)], "box_id int, x1 int, x2 int, y1 int, y2 int")
    assert {r["box_id"]: r["n"] for r in points.count_in(p, boxes).collect()} == {1: 4, 2: 0}


def test_entropy(spark):
    d = spark.createDataFrame([("abab",), (None,), ("",)], "text string")
    assert entropy.conditional_entropy(entropy.gram_counts(d, 0)).first()["entropy"] == 1.0
    assert entropy.conditional_entropy(entropy.gram_counts(d, 1)).first()["entropy"] == 0.0
    assert entropy.conditional_entropy(entropy.gram_counts(d.limit(0), 1)).first()["entropy"] == 0.0


LINES = ['{"text": "one", "meta": {"a": 1}}', '{"no": 1}', "{broken", "[1]", '{"text": null}', "", '{"id": 3, "text": "zwei é"}']


@pytest.fixture
def files(tmp_path):
    body = ("\n".join(LINES) + "\n").encode()
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.jsonl").write_bytes(body)
    (tmp_path / "in/b.json.gz").write_bytes(gzip.compress(body))
    (tmp_path / "in/sub/c.jsonl.zst").write_bytes(zstandard.compress(body))
    (tmp_path / "in/sub/d.json").write_bytes(body)
    (tmp_path / "in/e.txt").write_bytes(body)
    return tmp_path


def test_ingest(spark, files):
    rows = jsonl.ingest(spark, str(files / "in"), shards=2).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["one", "zwei é"] * 4
    assert [r["linenum"] for r in rows] == [0, 6] * 4 and [r["doc_id"] for r in rows] == list(range(8))
    assert [r["shard"] for r in rows] == [0] * 4 + [1] * 4
    assert json.loads(rows[1]["metadata"]) == {"id": 3} and rows[0]["metadata"] == '{"meta": {"a": 1}}'
    with pytest.raises(ValueError, match="missing field|not a JSON"):
        jsonl.ingest(spark, str(files / "in"), strict=True)
    out = str(files / "index")
    jsonl.write_corpus(jsonl.ingest(spark, str(files / "in")), out)
    jsonl.write_corpus(jsonl.ingest(spark, str(files / "in")).limit(0), out)
    assert spark.read.parquet(out).count() == 8


def test_stream(spark, files):
    out, state = str(files / "index"), str(files / "state")
    ingest.append_shards(ingest.stream_lines(spark, str(files / "in")), out, state).awaitTermination()
    first = spark.read.parquet(out)
    assert first.count() == 8 and first.select("doc_id").distinct().count() == 8
    (files / "in/z.jsonl").write_text('{"text": "one more"}\n')
    ingest.append_shards(ingest.stream_lines(spark, str(files / "in")), out, state).awaitTermination()
    again = spark.read.parquet(out)
    assert again.count() == 9 and again.select("shard").distinct().count() == 2
    assert search.count(again, "one").first()["count"] == 5


def test_corpus_interface(spark, docs):
    c = Registry({"small": Corpus(docs)}, keep_log=True)
    assert c.query({"query_type": "count", "index": "small", "query": "quick", "source": "test"})["count"] == 2
    found = c.query({"query_type": "find", "index": "small", "query": "quick"})
    lo, hi = found["segment_by_shard"][2]["lo"], found["segment_by_shard"][2]["hi"]
    assert found["cnt"] == hi - lo == 2 and found["latency"] > 0
    doc = c.query({"query_type": "get_doc_by_rank", "index": "small", "query": "quick", "s": 2, "rank": lo, "max_ctx_len": 5})
    assert (doc["doc_id"], doc["doc_len"], doc["text"], doc["needle_offset"], doc["disp_len"]) == (5, 35, "The quick brow", 4, 14)
    assert c.query({"query_type": "get_doc_by_rank", "index": "small", "query": "quick", "s": 2, "rank": hi})["error"]
    for bad, message in (({"index": "small", "query": "x"}, "missing field: query_type"), ({"query_type": "count", "index": "no", "query": "x"}, "invalid index"), ({"query_type": "open", "index": "small", "query": "x"}, "invalid query_type"), ({"query_type": "count", "index": "small", "query": 5}, "string"), ({"query_type": "count", "index": "small", "query": "x", "k": 1}, "k")):
        out = c.query(bad)
        assert out["status"] == 400 and message in out["error"]
    assert len(c.log) == 9


def test_rest_imports_without_the_subpackage(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "textloom.llm", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert "count_needles" in entry.queries() and not [q for q in entry.queries() if q.startswith("p")  and q[1].isdigit()]
    sys.modules.pop("__spark_entry__", None)


def test_indexed_corpus_answers_like_the_scan(spark, tmp_path):
    rows = [(i % 2, i, ("naïve harbour beside the sea " * (i % 4)) + f"n{i}", f"m{i}") for i in range(20)]
    plain = Corpus(spark.createDataFrame(rows, "shard int, doc_id long, text string, metadata string"))
    fast = plain.build_index(f"file://{tmp_path}/ix")
    for q in ("harbour", "harbour beside the sea naïve", "zz", "", "n1"):
        assert fast.count(q).first()["count"] == plain.count(q).first()["count"]
        assert fast.find(q).first() == plain.find(q).first()
    lo, hi = plain.find("harbour").first()["segment_by_shard"][1]
    seen = [[c.get_doc_by_rank("harbour", 1, r, 8).first() for r in range(lo, hi)] for c in (plain, fast)]
    columns = ["doc_id", "metadata", "text", "needle_offset", "doc_len", "disp_len", "spans", "error"]
    assert sorted(tuple(r[c] for c in columns) for r in seen[0]) == sorted(tuple(r[c] for c in columns) for r in seen[1]) and len(seen[0]) == hi - lo > 5
    assert fast.get_doc_by_rank("harbour", 1, hi, 8).count() == plain.get_doc_by_rank("harbour", 1, hi, 8).count() == 0


def test_long_needles(spark):
    word = "abé" * 200
    docs = spark.createDataFrame([(0, 1, word + word), (0, 2, "abc"), (1, 3, word[:-1])], "shard int, doc_id long, text string")
    found = {r["shard"]: (r["lo"], r["hi"]) for r in search.find(docs, word).collect()}
    data = {0: [word + word, "abc"], 1: [word[:-1]]}
    for s, texts in data.items():
        suffixes = [t.encode()[i:] + b"\xff" for t in texts for i in range(len(t.encode()))]
        lo, n = sum(x < word.encode() for x in suffixes), sum(x.startswith(word.encode()) for x in suffixes)
        assert found[s] == (lo, lo + n)


def test_an_engine_error_is_status_500(spark):
    broken = Corpus(spark.createDataFrame([(1,)], "shard int"))  # no text
    assert Registry({"x": broken}).query({"query_type": "count", "index": "x", "query": "a"})["status"] == 500


def test_shared_folder_is_required_on_a_cluster():
    from textloom.functions.storage import shared_dir

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        shared_dir(Session)
