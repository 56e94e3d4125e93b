"""The sequence queries named *_all reach the last position, beyond the fixed ranges of the others."""

import random

import pytest

from textloom.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """12,000 positions; whatever is rare stands after position 10,000 only."""
    rng = random.Random(2)
    rows = [(i, "error" if i > 11_000 else rng.choice(("click", "view", "purchase")), 25 if i >= 11_990 else rng.randrange(100, 120), 5.0 if i < 11_995 else -1.0) for i in range(12_000)]
    at = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, value double").write.parquet(f"{at}/events.parquet")
    asked = [(k, n) for k in (0, 8_999, 9_000, 11_500, 20_000) for n in (1, 3)]
    spark.createDataFrame(asked, "l_orderkey long, l_linenumber int").write.parquet(f"{at}/lineitem.parquet")
    return at, rows, asked


def test_whole_sequence(spark, events):
    at, rows, asked = events
    got = lambda name, *c: sorted(tuple(r[x] for x in c) for r in QUERIES[name](spark, at).collect())
    want = [(i, s, sum(t == s for k, t, _, _ in rows if k < i)) for i, s in ((k, {1: "view", 3: "click"}[n]) for k, n in asked)]
    assert got("seq_rank_all", "i", "sym", "rank") == sorted(want)
    assert got("range_search_2d_all", "i", "sym") == [(i, 25) for i in range(11_990, 12_000)]
    assert got("unique_range_values_all", "sym") == [(25,)]
    assert got("range_minimum_all", "range_id", "i", "v") == [(1, 11_995, -1.0), (2, 3_000, 5.0), (3, 11_995, -1.0), (4, 11_995, -1.0)]
    assert got("lex_count_all", "rank", "smaller", "greater") == [(0, sum(t < "error" for _, t, _, _ in rows[3_000:]), sum(t > "error" for _, t, _, _ in rows[3_000:]))]
    assert (25, 0, 10) in got("interval_symbols_all", "sym", "rank_lo", "rank_hi")
    assert (25, 3, 30) in got("intersect_ranges_all", "sym", "n_ranges", "freq")
