"""Repetition and reading level."""

import re
from collections import Counter

import numpy as np
import pytest

from textloom.functions.vectext import Words
from textloom.llm import reading_level as lv
from textloom.llm import repetition as rp


def test_repeated_words(documents, texts):
    got = Counter((r["doc_id"], r["n_words"], r["repeated_words"]) for r in rp.repetition(documents).collect())
    want = Counter()
    for d, t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(runs)
        hit = {i + j for i, r in enumerate(runs) if n[r] > 1 for j in range(5)}
        want[d, len(w), len(hit)] += 1
    assert got == want


def test_repetition_edges(documents, no_documents):
    assert rp.repetition(no_documents).count() == 0
    rows = {r["doc_id"]: r for r in rp.repetition(documents).collect()}
    assert rows[40]["repeated_share"] == rows[41]["repeated_share"] == 0 and rows[40]["js_words"] is None
    assert rows[30]["repeated_share"] == 1.0 and 0 < rows[30]["js_words"] <= 1
    assert {r["doc_id"] for r in rp.repetitive(rp.repetition(documents)).collect()} >= {30, 50, 51}


def test_share_without_divergence(documents, texts):
    cols = ["doc_id", "n_words", "repeated_words", "repeated_share"]
    with_, without = rp.repetition(documents).select(*cols), rp.repetition(documents, divergence=False)
    assert without.columns == cols
    assert Counter(map(tuple, without.collect())) == Counter(map(tuple, with_.collect()))


def test_languages_beyond_the_bound_share_a_reference(spark, monkeypatch):
    monkeypatch.setattr(rp, "LANGUAGES", 2)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"{lang}{rng.integers(40)}" for _ in range(50 + 50 * (lang in ("en", "fr")))), lang) for i, lang in enumerate(["en", "fr", "de", "es", None] * 6)]
    got = rp.repetition(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 30 and all(r["js_words"] is not None and r["js_chars"] is not None for r in got)


def test_surface_is_the_same_without_labels(documents, graded):
    cols = ["doc_id", "n_words", "n_sentences", "long_words"]
    assert Counter(map(tuple, lv.surface(documents).collect())) == Counter(map(tuple, lv.reading_levels(documents, graded[1]).select(*cols).collect()))


def test_jensen_shannon():
    p = np.array([[1, 0, 0], [2, 2, 0], [0, 0, 5]])
    got = rp.jensen_shannon(p, np.array([[2, 2, 0]]))
    m = np.array([0.75, 0.25])
    by_hand = np.sqrt((np.log2(1 / m[0]) + 0.5 * np.log2(0.5 / m[0]) + 0.5 * np.log2(0.5 / m[1])) / 2)
    assert got == pytest.approx([by_hand, 0, 1])


SENTENCES = [
    ("", 0),
    ("No end", 1),
    ("One. Two! Three?", 3),
    ("See fig. 3 and cf. the note. Then e.g. this, z.B. that.", 2),
    ("A value of 3.5 stays. Www.example.com too", 2),
    ("Wait... what?! Yes", 3),
    ("Title\n\nBody text\n \nMore", 3),
    ("line\nsame sentence", 1),
    (". ! ?", 0),
    ("(cf. above) end.", 1),
    ("I.E. one. FIG. two.", 2),
    ("Das ist z. B. so. Gut p. ex. ici.", 2),
    ("Plan z. A new one. Dr. Who came etc. and left.", 3),
    ("z. B", 2),
]


def test_sentences():
    assert lv.sentence_counts(Words([t.lower() for t, _ in SENTENCES])).tolist() == [n for _, n in SENTENCES]
    for t, n in SENTENCES:
        assert lv.sentence_counts(Words([t.lower()])).tolist() == [n]


@pytest.fixture(scope="module")
def graded(spark):
    rng = np.random.default_rng(4)
    docs, labels = [], []
    for d in range(400):
        g = int(rng.integers(1, 13))
        docs.append((d, " ".join(f"g{max(1, int(rng.normal(g, 1.5)))}v{rng.integers(12)}" for _ in range(80))))
        labels.append((d, "r1", g, None))
        labels += [(d, "r2", g, None), (d, "r2", g, None), (d, "r3", 90, None), (d, "r4", None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, rater string, reading_grade int, rated_ts timestamp"), {d: g for d, _, g, _ in labels[::5]}


def test_levels_on_held_out_documents(spark, graded):
    docs, labels, truth = graded
    got = {r["doc_id"]: r["level"] for r in lv.reading_levels(docs, labels.where("doc_id < 300")).collect()}
    error = [abs(got[d] - truth[d]) for d in range(300, 400)]
    assert np.mean(error) < 1.2


def test_level_edges(documents, no_documents, graded):
    _, labels, _ = graded
    assert lv.reading_levels(no_documents, labels).count() == 0
    rows = lv.reading_levels(documents, labels.limit(0)).collect()
    assert len(rows) == documents.count() and all(r["level"] is None for r in rows)
    none = {r["doc_id"]: r for r in rows}
    assert (none[40]["n_words"], none[40]["n_sentences"]) == (0, 0)
    assert lv.demanding(lv.reading_levels(documents, labels)).where("doc_id = 60").count() == 0
