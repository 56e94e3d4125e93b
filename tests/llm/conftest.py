import random

import pytest


def words(rng, n, names=200):
    return " ".join(f"w{rng.randrange(names)}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): copies, near copies, shared passages, repetition, nulls, empty, one very long text, and repeated rows."""
    rng = random.Random(7)
    base = [words(rng, 120) for _ in range(6)]
    passage = words(rng, 80)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10, base[0]), (11, base[0].upper()), (12, base[1].replace("w1 ", "X ", 1)), (13, base[2] + " " + words(rng, 10))]
    rows += [(20, words(rng, 30) + " " + passage), (21, passage + " " + words(rng, 30)), (22, words(rng, 5) + passage[:210])]
    rows += [(30, "the same old phrase again and again. " * 12), (31, "é" * 500), (32, "é" * 400), (33, "a b c"), (34, "x")]
    rows += [(40, None), (41, ""), (42, "   \n"), (None, base[3]), (50, "naïve Ünïcode 日本語 text 🎉 " * 15), (51, "naïve Ünïcode 日本語 text 🎉 " * 16)]
    rows += [(60, words(rng, 30_000, 5_000)), (3, base[3]), (3, base[3])]
    return rows


@pytest.fixture(scope="session")
def documents(spark, texts):
    """The texts with the further columns of the table, and some whose names clash with what operators use inside."""
    rows = [(d, t, ("en", "FR", "de-AT", None, "und")[i % 5], ("WebCrawl", "web crawl", "OldBooks ", None)[i % 4], ("a.example", None)[i % 2], "T", 1, "k", 5, 2.0) for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string, Text string, bucket int, key string, hi long, similarity double")


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)
