import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import near_duplicates as n
from textloom.llm.gray_index import gray_order, gray_rank, join_groups, join_sides


def shingles(t, k):
    w = re.findall(r"[^\W_]+", t.lower())
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= 20 else None


def brute(rows, k, least):
    sets = {d: shingles(t, k) for d, t in rows if d is not None and t}
    sets = {d: x for d, x in sets.items() if x}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


@pytest.mark.parametrize(("hot", "sample"), [(n.HOT_ROWS, n.SAMPLE), (2, 1), (1, 1)])
def test_pairs_and_groups(documents, texts, hot, sample):
    members, links = n.near_duplicates(documents, 0.6, 3, hot_rows=hot, sample=sample)
    rows = [tuple(r) for r in n.similar_pairs(members, links).collect()]
    want = brute(texts, 3, 0.6)
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) >= 5
    groups = {r["doc_id"]: r["group_id"] for r in n.near_duplicate_groups(members, links).collect()}
    assert all(groups[a] == groups[b] for a, b in want)
    assert all(g <= d for d, g in groups.items())


def test_empty(no_documents):
    members, links = n.near_duplicates(no_documents)
    assert n.similar_pairs(members, links).count() == 0
    assert n.near_duplicate_groups(members, links).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)], "a long, b long")
    got = {r["node"]: r["component"] for r in n.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def distance(a, b):
    return int(np.bitwise_count(a ^ b).sum())


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 70), st.integers(1, 150))
def test_join_is_exact(seed, radius, size):
    rng = np.random.default_rng(seed)
    f = rng.integers(0, 2**64, (size, 2), dtype=np.uint64)
    f[: size // 2] = f[0] ^ (np.uint64(1) << rng.integers(0, 64, (size // 2, 2)).astype(np.uint64))
    key = rng.integers(0, 2, size)
    want = {(i, j) for i, j in combinations(range(size), 2) if key[i] == key[j] and distance(f[i], f[j]) <= radius}
    i, j = join_groups(key, f, radius)
    got = [(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got)) and set(got) == want
    x, y = f[: size // 3 + 1], f[size // 3 :]
    a, b = join_sides(x, y, radius)
    assert set(zip(a.tolist(), b.tolist())) == {(p, q) for p in range(len(x)) for q in range(len(y)) if distance(x[p], y[q]) <= radius}


def test_whole_groups_are_pruned():
    """Clusters that lie further apart than the radius are never compared fingerprint by fingerprint."""
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**64, (40, 2), dtype=np.uint64)
    f = centres.repeat(100, axis=0) ^ (np.uint64(1) << rng.integers(0, 64, (4000, 2)).astype(np.uint64))
    work = {}
    i, _ = join_groups(np.zeros(4000, np.int64), f, 8, work)
    assert work["groups"] == 1 and work["pairs"] == 4000 * 3999 // 2
    assert len(i) == 40 * 100 * 99 // 2 <= work["compared"] < work["pairs"] // 3


def test_gray_neighbours_differ_in_one_bit():
    codes = np.array([[0, i ^ (i >> 1)] for i in range(256)], np.uint64)
    assert (gray_rank(codes)[:, 1] == np.arange(256)).all()
    shuffled = codes[np.random.default_rng(0).permutation(256)]
    assert (shuffled[gray_order(shuffled)] == codes).all()


def test_fingerprints_follow_similarity():
    rng = np.random.default_rng(3)
    both, a, b = (rng.integers(0, 2**64, k, dtype=np.uint64) for k in (600, 200, 200))
    keys, f = n.signatures(np.concatenate([both, a, both, b]), np.array([0, 800]))
    assert abs(distance(f[0], f[1]) - n.BITS * 0.2) < 4.5 * (n.BITS * 0.2 * 0.8) ** 0.5
    assert (keys[0] == keys[1]).any()


def test_two_texts_under_one_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " more"), (3, b + " more")], "doc_id long, text string")
    members, links = n.near_duplicates(docs, 0.6, 3)
    assert sorted(tuple(r) for r in n.similar_pairs(members, links).collect()) == [(1, 2), (1, 3)]


def test_many_copies_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(n, "COPIES", 7)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(30))) for i in range(50)], "doc_id long, text string")
    rows = [tuple(r) for r in n.similar_pairs(*n.near_duplicates(docs, 0.6, 3)).collect()]
    assert len(rows) == len(set(rows)) == 50 * 49 // 2 and all(a < b for a, b in rows)
