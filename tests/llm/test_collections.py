"""Formatting duplicates, token budget and mixing."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from textloom.llm import formatting_duplicates as fd
from textloom.llm import source_mixing as sm
from textloom.llm import token_budget as tb

TEXTS = [(1, "Some Text, here"), (2, "some text here!"), (3, "SOMETEXT HERE"), (4, "other"), (5, "..."), (6, None), (7, "some text here"), (8, "other"), (9, "Ünï_code"), (10, "ünï code"), (4, "other"), (None, "other")]
META = [
    (1, "A/b-1.gz", '{"x": 1, "y": {"b": 2, "a": "q"}}'),
    (1, "A/b-1.gz", '{"x": 1, "y": {"b": 2, "a": "q"}}'),
    (2, "a\\B_1 gz", '{ "y" : {"a":"q", "b":2}, "x":1}'),
    (3, "ab1gz", '{"x": 1.0, "y": {"b": 2, "a": "q"}}'),
    (4, None, None),
    (7, "ab1gz", '{"x": "1", "y": {"b": 2, "a": "q"}}'),
    (8, "//", "{}"),
    (9, "p", "not json"),
    (10, "P", "not json"),
    (99, "p", None),
    (None, "p", None),
]


def test_copies(spark):
    docs = spark.createDataFrame([(*r, "z") for r in TEXTS], "doc_id long, text string, record string")
    meta = spark.createDataFrame([(*r, 3) for r in META], "doc_id long, path string, metadata string, linenum long")
    groups, members = fd.copies(fd.record_tuples(docs, meta))
    assert sorted(tuple(r) for r in members.collect()) == [(1, 2), (4, 8), (9, 10)]
    assert sorted(tuple(r) for r in groups.collect()) == [(1, 2), (3, 1), (4, 2), (7, 1), (9, 2)]
    for d, m in ((docs.limit(0), meta), (docs.limit(0), meta.limit(0))):
        assert fd.copies(fd.record_tuples(d, m))[1].count() == 0
    # Without metadata, texts alone decide.
    assert sorted(tuple(r) for r in fd.copies(fd.record_tuples(docs, meta.limit(0)))[1].collect()) == [(1, 2), (1, 3), (1, 7), (4, 8), (9, 10)]


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8)


@given(st.dictionaries(st.text(max_size=4), json_values, max_size=4))
def test_cells_ignore_order_and_spacing(found):
    import json

    turned = dict(reversed(found.items()))
    assert fd.cells(json.dumps(found)) == fd.cells(json.dumps(turned, indent=2, ensure_ascii=False))


def merged(word, ranks):
    pieces = ["▁", *word]
    for a, b in ranks:
        i = 0
        while i < len(pieces) - 1:
            if (pieces[i], pieces[i + 1]) == (a, b):
                pieces[i : i + 2] = [a + b]
            i += 1
    return len(pieces)


def test_tokenizer(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/tokenizer_merges.parquet").orderBy("merge_rank").collect()]
    t = tb.MergeTokenizer(rows)
    for w in ("the", "internationalisation", "é", "Straße", "aaaa", "x" * 50, "1999."):
        assert t.word(w) == merged(w, [r[1:] for r in rows])
    assert t.count(" the  the\n") == 2 * t.word("the") and t.count("") == 0


def test_budget(spark, data):
    docs, meta, merges = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "text_meta", "tokenizer_merges"))
    t = tb.MergeTokenizer([tuple(r) for r in merges.collect()])
    true = sum(t.count(r["text"] or "") for r in docs.collect())
    rows = tb.token_budget(docs, meta, merges).collect()
    total = [r for r in rows if r["slice"] == "total"]
    assert len(total) == 1 and total[0]["n_docs"] == docs.count() and abs(total[0]["est_tokens"] / true - 1) < 0.05
    for kind in ("source", "pile_set_name", "language", "domain", "source+language", "source+pile_set_name+language+domain"):
        mine = [r for r in rows if r["slice"] == kind]
        assert sum(r["n_docs"] for r in mine) == docs.count() and abs(sum(r["est_tokens"] for r in mine) - total[0]["est_tokens"]) <= len(mine)


def test_budget_edges(documents, no_documents, spark):
    meta = spark.createDataFrame([(1, '{"pile_set_name": " Old books"}'), (1, '{"meta": {"pile_set_name": "OLDBOOKS"}}'), (2, "broken"), (3, None)], "doc_id long, metadata string")
    merges = spark.createDataFrame([(1, "▁", "w"), (2, None, "x")], "merge_rank int, left_piece string, right_piece string")
    rows = tb.token_budget(documents, meta, merges).collect()
    assert [r["n_docs"] for r in rows if r["slice"] == "pile_set_name" and r["pile_set_name"] == "oldbooks"] == [1]
    assert tb.token_budget(no_documents, meta, merges).count() == 0
    assert tb.token_budget(documents, meta.limit(0), merges.limit(0)).where("slice = 'total'").first()["est_tokens"] > 0


def test_few_documents_of_many_languages(spark, data, monkeypatch):
    """A language of a handful of documents has weights near the common ones; languages beyond the bound have these."""
    docs, merges = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "tokenizer_merges"))
    docs = docs.selectExpr("doc_id", "text", "concat('l', chr(97 + doc_id % 20)) as lang", "source", "domain")
    monkeypatch.setattr(tb, "LANGUAGES", 12)
    report = tb.fit(docs.withColumnRenamed("lang", "language"), merges)[1].collect()
    assert 11 <= len(report) <= 13  # a language whose few documents are all held out takes the common weights
    assert all(0.5 < r["bias"] < 2 for r in report)
    # A holdout may be a single document, so the languages' errors are judged together.
    assert sorted(r["relative_error"] for r in report)[len(report) // 2] < 0.25
    assert tb.estimates(docs, merges).where("n_bytes > 100 and milli_tokens = 0").count() == 0


def test_sample_is_bounded_with_a_hot_id(spark, data):
    merges = spark.read.parquet(f"{data}/tokenizer_merges.parquet")
    rows = [(7, "the same text again", "en")] * 500 + [(None, "no id", "en")] * 500 + [(i, f"text number {i}", "en") for i in range(1000, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, language string")
    n = tb.fit(docs, merges, sample_docs=300)[1].where("language = 'en'").first()["docs"]
    assert 150 < n < 450


def sized(spark, n=4000):
    rows = [(i, ("Big", "small", "MID ", "odd", None)[0 if i % 3 == 0 else 1 + i % 4], 1 + i * 7919 % 200) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


def test_mix(spark):
    docs = sized(spark)
    targets = spark.createDataFrame([("big", 0.3, 2), ("Small", 0.5, 3), ("mid", 0.2, 1), ("absent", 0.0, 5), ("none", None, None)], "source string, target_share double, max_repeats int")
    chosen, report = sm.mix(docs, targets, total=150_000)
    rows = {r["source"]: r for r in report.collect()}
    assert rows["big"]["tokens"] == pytest.approx(45_000, abs=200) and rows["Small"]["tokens"] == pytest.approx(75_000, abs=200)
    assert rows["absent"]["tokens"] == rows["none"]["tokens"] == 0
    most = {r["source"]: r["m"] for r in chosen.groupBy("source").agg({"copies": "max"}).withColumnRenamed("max(copies)", "m").collect()}
    assert most["big"] <= 2 and most["small"] <= 3 and most["mid"] <= 1
    assert sum(r["actual_share"] for r in rows.values()) == pytest.approx(1)
    again = sm.mix(docs.repartition(7), targets, total=150_000)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, chosen.collect()))


def test_mix_caps_and_edges(spark):
    docs = sized(spark, 400).unionByName(spark.createDataFrame([(1, "big", 5), (None, "big", 5), (7000, "big", 0), (7001, "big", None)], "doc_id long, source string, tokens long"))
    targets = spark.createDataFrame([("big", 0.9, 2), ("small", 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, report = sm.mix(docs, targets, total=10_000_000)
    assert {r["source"]: r["copies"] for r in chosen.collect()} == {"big": 2, "small": 1}
    assert chosen.where("doc_id is null or doc_id >= 7000").count() == 0
    assert sm.mix(docs.limit(0), targets)[0].count() == 0
    assert sm.mix(docs, targets.limit(0))[1].count() == 0


def test_unequal_probabilities(spark):
    """Documents of weight 1/4 come up about a quarter as often."""
    docs = sized(spark).where("source = 'Big'").selectExpr("doc_id", "source", "10L as tokens", "if(doc_id % 2 = 0, 1.0, 0.25) as weight")
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    n = docs.count()
    chosen = sm.mix(docs, targets, total=10 * n // 4)[0]
    heavy = chosen.where("doc_id % 2 = 0").count()
    assert chosen.count() == pytest.approx(n / 4, abs=2) and heavy / chosen.count() == pytest.approx(0.8, abs=0.06)


@given(st.lists(st.tuples(st.integers(1, 50), st.sampled_from([0.25, 0.5, 1.0, 2.0])), min_size=1, max_size=8), st.integers(1, 4), st.floats(0.01, 0.99))
def test_scale(held, most, part):
    import numpy as np

    t, w = (np.array(x, float) for x in zip(*held))
    target = part * t.sum() * most
    f = sm._scale(t, w, most, target)
    assert math.isclose((t * np.minimum(most, f * w)).sum(), target, rel_tol=1e-9)


def test_tokens(spark, data):
    docs = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "y"), (3, "", None)], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["tokens"] for r in sm.with_tokens(docs).collect()} == {1: 2, 2: 0, 3: 0}
