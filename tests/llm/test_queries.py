"""Every registered query of this subpackage over the smallest tables: against its SQL, or against what its rows must satisfy."""

from pathlib import Path

import duckdb
import pytest

from textloom.llm.queries import QUERIES, SQL
from textloom.llm.token_budget import MergeTokenizer


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck.execute(SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert found == want and want


def test_every_query_is_covered():
    assert set(QUERIES) - set(SQL) == {"p3_token_budget", "p3_holdouts", "p5_repetition", "p6_partial_leaks", "p7_mix", "p7_shares", "p8_reading_level"}


def tokens(spark, data):
    count = MergeTokenizer([tuple(r) for r in spark.read.parquet(f"{data}/tokenizer_merges.parquet").collect()]).count
    return {r["doc_id"]: count(r["text"] or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def test_token_budget(spark, data, duck):
    """Documents and bytes are exact in every slice of source; the tokens are near the tokenizer's."""
    rows = QUERIES["p3_token_budget"](spark, data).collect()
    key = r"coalesce(nullif(regexp_replace(lower(source), '[^\p{L}\p{N}]+', '', 'g'), ''), '(none)')"
    want = {(s, n, b) for s, n, b in duck.execute(f"select {key}, count(*), cast(sum(strlen(coalesce(text, ''))) as bigint) from documents group by 1").fetchall()}
    assert {(r["source"], r["n_docs"], r["n_bytes"]) for r in rows if r["slice"] == "source"} == want
    true = sum(tokens(spark, data).values())
    assert [r["est_tokens"] for r in rows if r["slice"] == "total"] == [pytest.approx(true, rel=0.05)]


def test_holdouts(spark, data):
    rows = {r["language"]: r for r in QUERIES["p3_holdouts"](spark, data).collect()}
    assert "(all)" in rows and all(0 < r["holdout_docs"] <= r["docs"] for r in rows.values())
    assert rows["(all)"]["relative_error"] < 0.2


def test_repetition(spark, data, duck):
    rows = QUERIES["p5_repetition"](spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in duck.execute("select doc_id from documents").fetchall())
    assert all(0 <= r["repeated_share"] <= 1 for r in rows)
    assert all((r["js_words"] is None) == (r["n_words"] < 20) for r in rows)


def test_partial_leaks(spark, data, duck):
    rows = {(r["item_id"], r["doc_id"]): r for r in QUERIES["p6_partial_leaks"](spark, data).collect()}
    exact = set(duck.execute(SQL["p6_found"]).fetchall())
    assert {k for k, r in rows.items() if r["edits"] == 0} == exact
    assert all(0 < r["matched"] <= r["pieces"] and 0 <= r["edits"] <= 2 for r in rows.values())


def test_mix(spark, data, duck):
    """No document beyond its source's repeats; each share that is below its target has everything its source can give."""
    chosen, shares = QUERIES["p7_mix"](spark, data).collect(), QUERIES["p7_shares"](spark, data).collect()
    key = r"regexp_replace(lower(source), '[^\p{L}\p{N}]+', '', 'g')"
    most = dict(duck.execute(f"select {key}, max_repeats from mix_targets").fetchall())
    held = dict(duck.execute(f"select {key}, list(doc_id) from documents where length(text) > 0 group by 1").fetchall())
    assert all(1 <= r["copies"] <= most[r["source"]] and r["doc_id"] in held[r["source"]] for r in chosen)
    assert sum(r["actual_share"] for r in shares) == pytest.approx(1)
    taken = {}
    for r in chosen:
        taken.setdefault(r["source"], []).append(r["copies"])
    for r in shares:
        s = "".join(c for c in r["source"].lower() if c.isalnum())
        if r["tokens"] < 0.95 * r["target_tokens"]:
            assert taken.get(s, []) == [most[s]] * len(held.get(s, []))


def test_reading_level(spark, data, duck):
    rows = QUERIES["p8_reading_level"](spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in duck.execute("select doc_id from documents").fetchall())
    assert all(r["level"] is None or 1 <= r["level"] <= 20 for r in rows)
