"""The stored index against brute force, with blocks, ranges and pages so small that everything crosses their borders."""

import random

import pytest

from textloom.operators import index as ix
from textloom.operators import suffix_sort as ss

BASE = "the quick brown fox é jumps over 日本 dogs "


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    rows = [(i % 3, i, "".join(rng.choice("ab é") for _ in range(rng.randrange(0, 80)))) for i in range(40)]
    return rows + [(1, 100, "a" * 700), (1, 101, "a" * 300), (2, 102, BASE * 9), (2, 103, BASE * 9), (2, 104, ""), (0, 105, "x" + BASE * 9), (0, 106, None)]


@pytest.fixture(scope="module")
def streams(docs):
    out = {}
    for s in {s for s, _, t in docs}:
        own = [t.encode() for _, _, t in sorted((r for r in docs if r[0] == s and r[2] is not None), key=lambda r: r[1])]
        out[s] = b"".join(b"\xff" + t for t in own) + b"\xfa"
    return out


@pytest.fixture(scope="module")
def order(streams):
    return {s: sorted(range(len(x)), key=lambda i: x[i:]) for s, x in streams.items()}


def frame(spark, docs):
    return spark.createDataFrame([(*r, f"m{r[1]}") for r in docs], "shard int, doc_id long, text string, metadata string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return ix.build(frame(spark, docs), f"file://{tmp_path_factory.mktemp('index')}", block=100, page=32, range_rows=50)


def interval(stream, order, word):
    lo = sum(stream[i:] < word for i in order)
    return lo, lo + sum(stream[i:].startswith(word) for i in order)


@pytest.mark.parametrize(("block", "range_rows", "page"), [(ss.BLOCK, ss.RANGE, ss.PAGE), (64, 100, 32), (37, 1000, 10)])
def test_order(spark, docs, streams, order, block, range_rows, page):
    text = ss.blocks(frame(spark, docs), block)
    got = {(r["shard"], r["rank"]): (r["ptr"], r["byte"], r["bwt"], bytes(r["head"])) for r in ss.rows(ss.pages(text, ss.ranks(text, block, range_rows), block, page), page).collect()}
    want = {}
    for s, x in streams.items():
        want |= {(s, r): (i, x[i], x[i - 1], x[i : i + ss.HEAD].ljust(ss.HEAD, b"\0")) for r, i in enumerate(order[s])}
    assert got == want


NEEDLES = ["a", "é", "ab", "the quick", "the quick brown fox é jumps over", BASE * 8, "a" * 16, "a" * 299, "zz", "日", "\n", "the quick brown fox jumps over it", "a" * 701, "b é", ""]


@pytest.mark.parametrize("needle", NEEDLES)
def test_find(index, streams, order, needle):
    want = {s: interval(x, order[s], needle.encode()) if needle else (0, len(x)) for s, x in streams.items()}
    assert index.find(needle) == want
    assert index.count(needle) == sum(hi - lo for lo, hi in want.values())
    if needle and len(needle) < 20:
        back = index.backward_search(needle.encode())
        assert all(back[s][1] - back[s][0] == hi - lo and (hi == lo or back[s] == (lo, hi)) for s, (lo, hi) in want.items())


def test_locate_and_documents(index, docs, streams, order):
    texts = {d: t for _, d, t in docs if t is not None}
    got = {(r["shard"], r["rank"]): (r["ptr"], r["doc_id"], r["pos"]) for r in index.locate("é").collect()}
    for s, x in streams.items():
        lo, hi = interval(x, order[s], "é".encode())
        assert [got[s, r][0] for r in range(lo, hi)] == order[s][lo:hi]
    assert all(texts[d].encode()[p : p + 2] == "é".encode() for _, d, p in got.values())
    (s, r), (_, d, p) = sorted(got.items())[5]
    row = index.get_doc_by_rank(s, r, 2, 3).first()
    raw = texts[d].encode()
    piece = raw[max(0, p - 3) : p + 5]
    assert (row["doc_id"], row["pos"], row["metadata"], row["c"]["doc_len"], row["c"]["needle_offset"]) == (d, p, f"m{d}", len(raw), min(p, 3))
    try:
        assert row["c"]["text"] == piece.decode() and row["c"]["error"] is None
    except UnicodeDecodeError:
        assert row["c"]["text"] is None and row["c"]["error"]
    assert index.get_doc_by_rank(s, 10**9, 2, 3).count() == index.get_doc_by_rank(99, 0, 2, 3).count() == 0


def test_resume_and_empty(spark, docs, index, tmp_path):
    path = f"file://{tmp_path}/x"
    none = ix.build(frame(spark, docs).limit(0), path)
    assert none.find("a") == {} and none.count("") == 0 and none.locate("a").count() == 0
    assert ix.build(frame(spark, docs), path).sizes == {}  # left alone
    assert ix.build(frame(spark, docs), path, resume=False).sizes == index.sizes


def test_a_search_reads_few_pages(index):
    """The filter on keys reaches the scan, and at most two pages a shard pass it."""
    key = ss.key_of(b"the quic")
    pages = index.pages.where(f"first_key <= {key} and next_key >= {key}")
    assert "PushedFilters: [IsNotNull(first_key), IsNotNull(next_key), LessThanOrEqual(first_key" in pages._jdf.queryExecution().toString()
    assert max(r["count"] for r in pages.groupBy("shard").count().collect()) <= 2 < index.pages.where("shard = 2").count()
