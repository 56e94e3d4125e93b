"""Queries that list documents take them from the whole of their method: every step is measured for every document."""

import re
from collections import Counter

import numpy as np
import pytest

from textloom.llm import queries
from textloom.llm import repetition as rp


def watched(monkeypatch, name):
    """What the query hands to the filter ``name``."""
    seen, real = [], getattr(queries, name)
    monkeypatch.setattr(queries, name, lambda df: seen.append(df) or real(df))
    return seen


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def distance(a, b):
    """Jensen-Shannon, written out for two counters."""
    total = 0
    for k in a.keys() | b.keys():
        p, q = a[k] / a.total(), b[k] / b.total()
        total += sum(x * np.log2(2 * x / (p + q)) / 2 for x in (p, q) if x)
    return np.sqrt(total)


def char_class(c):
    if c.isalpha():
        return 0 if c.islower() else 1 if c.isupper() else 2
    return 3 if c.isalnum() else (5 if c in "\n\r" else 4) if c.isspace() else 6 if ord(c) < 128 else 7


def test_p5_found_measures_the_distance_of_every_document(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{'Ab'[i % 2]}{rng.integers(40)}," for _ in range(30 + i)) for i in range(24)]
    texts += [f"{t}\n{t}" for t in texts[:6]] + ["one two three four five " * 3, "", None]
    rows = [(i, t, ("en", "EN-gb", "fr", None)[i % 4]) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = watched(monkeypatch, "repetitive")
    found = {r["doc_id"] for r in queries.p5_found(spark, str(tmp_path)).collect()}
    assert found == set(range(24, 30))  # written twice; the text of 15 words is too short

    language = lambda lang: lang.lower()[:2] if lang else "und"
    chars, common = {}, {}
    for _, t, lang in rows:
        chars.setdefault(language(lang), Counter()).update(map(char_class, t or ""))
        common.setdefault(language(lang), Counter()).update(words(t))
    assert all(len(c) <= rp.COMMON for c in common.values())  # so each word has its own bin
    got = {r["doc_id"]: (r["js_chars"], r["js_words"]) for r in seen[0].collect()}
    assert len(got) == len(rows)
    for i, t, lang in rows:
        if len(words(t)) < 20:
            assert got[i] == (None, None)
        else:
            assert got[i] == pytest.approx((distance(Counter(map(char_class, t)), chars[language(lang)]), distance(Counter(words(t)), common[language(lang)])))


def test_p8_found_predicts_the_level_of_every_document(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    docs, labels = [], []
    for d in range(400):
        g = int(rng.integers(1, 13))
        text = [f"{'g' if d % 3 else 'acquired'}{max(1, int(rng.normal(g, 1.5)))}v{rng.integers(12)}" for _ in range(80)]
        every = 10 if d % 2 else 40  # words in a sentence
        docs.append((d, " ".join(w + "." * (i % every == every - 1) for i, w in enumerate(text))))
        labels.append((d, "r1", g, None))
    docs += [(400, None), (401, ""), (402, "unknownword " * 80)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels[:300], "doc_id long, rater string, reading_grade int, rated_ts timestamp").write.parquet(f"{tmp_path}/labels.parquet")
    seen = watched(monkeypatch, "demanding")
    found = {r["doc_id"] for r in queries.p8_found(spark, str(tmp_path)).collect()}
    assert found == {d for d in range(400) if d % 6 == 0} | {402}  # long words in long sentences; 402 without a known word, hence without a level

    level = {r["doc_id"]: r["level"] for r in seen[0].collect()}
    assert len(level) == len(docs) and {d for d, x in level.items() if x is None} == {400, 401, 402}
    assert np.mean([abs(level[d] - labels[d][2]) for d in range(300, 400)]) < 1.2
