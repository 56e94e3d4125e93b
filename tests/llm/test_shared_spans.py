from collections import defaultdict

import numpy as np
import pytest

from textloom.llm import shared_spans as s


def brute(rows, n):
    rows = {(d, t) for d, t in rows if d is not None and t}
    seen = defaultdict(set)
    for d, t in rows:
        for i in range(len(t) - n + 1):
            seen[t[i : i + n]].add(d)
    out = defaultdict(set)
    for d, t in rows:
        for i in range(len(t) - n + 1):
            if len(seen[t[i : i + n]]) > 1:
                out[d] |= set(range(i, i + n))
    spans = []
    for d, at in out.items():
        at = sorted(at)
        a = at[0]
        for x, y in zip(at, at[1:] + [None]):
            if y != x + 1:
                spans.append((d, a, x + 1))
                a = y
    return sorted(spans)


@pytest.mark.parametrize(("min_len", "k", "group_rows"), [(200, 60, 20_000), (200, 60, 1), (50, 7, 20_000), (30, 29, 3)])
def test_spans(documents, texts, min_len, k, group_rows):
    got = sorted(tuple(r) for r in s.shared_spans(documents, min_len, k, group_rows).collect())
    assert got == brute(texts, min_len)
    assert got


def test_empty(no_documents):
    assert s.shared_spans(no_documents).columns == ["doc_id", "span_start", "span_end"]
    assert s.shared_spans(no_documents).count() == 0


def test_bad_lengths(documents):
    with pytest.raises(ValueError):
        s.shared_spans(documents, 50, 50)


def test_every_stretch_has_its_smallest_gram():
    rng = np.random.default_rng(1)
    cp = rng.integers(97, 100, 500).astype(np.uint32)
    doc = np.repeat([0, 1], 250)
    key, at, lo, hi = s.anchors_of(cp, doc, 5, 20)
    assert sum(hi - lo + 1) == 2 * (250 - 20 + 1)
    assert all(l <= h and h <= a <= l + 15 for a, l, h in zip(at, lo, hi))


def test_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr(s, "PIECE", 1 << 8)
    t = "".join(chr(97 + i % 26) for i in range(1000))
    pieces = list(s._pieces([t], 20))
    assert len(pieces) > 5 and all(t[o : o + len(p)] == p for _, o, p in pieces)
    starts = sorted(x for _, o, p in pieces for x in range(o, o + len(p) - 19))
    assert starts == list(range(981))
