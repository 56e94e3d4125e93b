import random
import re

from textloom.llm import leakage as k


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (2, "Short: item!"),
    (2, "Short: item!"),
    (3, None),
    (4, "  "),
    (5, "One two THREE four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (6, "x"),
]
DOCS = [
    (10, "before ONE two, three four five six seven eight nine ten eleven twelve thirteen and more"),
    (11, "one two three four five six seven eight nine ten eleven twelve nothing"),
    (12, "a short item here"),
    (13, "ashort items"),
    (14, None),
    (15, ""),
    (16, "two three four five six seven eight nine ten eleven twelve thirten fourteen"),
    (17, ("filler " * 9000) + "short-item x"),
    (17, "x"),
    (None, "short item"),
]


def brute():
    out = set()
    for i, t in ITEMS:
        w = words(t or "")
        for d, s in DOCS:
            line = f" {' '.join(words(s or ''))} "
            if w and d is not None and any(f" {' '.join(w[j : j + 13])} " in line for j in range(max(1, len(w) - 12))):
                out.add((i, d))
    return out


def frames(spark):
    return spark.createDataFrame([(*r, "t") for r in ITEMS], "item_id long, text string, Text string"), spark.createDataFrame([(*r, 1) for r in DOCS], "doc_id long, text string, edits int")


def test_exact(spark):
    items, docs = frames(spark)
    for block, edits in ((k.BLOCK_CHARS, 2), (60, 2), (60, 0), (k.BLOCK_CHARS, 0)):
        rows = [tuple(r) for r in k.leaked_items(k.leaks(items, docs, edits=edits, block_chars=block)).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == brute()


def test_edits(spark):
    items, docs = frames(spark)
    found = {(r["item_id"], r["doc_id"]): r["edits"] for r in k.leaks(items, docs).collect()}
    assert found[1, 16] == 1 and found[5, 16] == 1 and found[1, 10] == 0


def test_empty(spark):
    items, docs = frames(spark)
    assert k.leaks(items.limit(0), docs).count() == 0
    assert k.leaks(items, docs.limit(0)).count() == 0


def edits(a, b, most):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        d[i][0] = i
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return min(*d[-1], most + 1)


def test_banded_alignment():
    rng = random.Random(2)
    for _ in range(1500):
        a, b = ("".join(rng.choice("ab ") for _ in range(rng.randrange(lo, 14))) for lo in (1, 0))
        for most in range(4):
            assert k.edit_distance(a, b, most) == edits(a, b, most)


def test_lemma_loses_no_near_match(spark):
    """Pieces with up to two random edits are all found."""
    rng = random.Random(5)
    item = " ".join(f"word{rng.randrange(1000)}x" for _ in range(13))
    docs = []
    for d in range(60):
        t = list(item)
        for _ in range(d % 3):
            at = rng.randrange(8, len(t) - 8)
            t[at : at + rng.randrange(2)] = rng.choice("qz")
        docs.append((d, f"start {''.join(t)} end"))
    found = {r["doc_id"] for r in k.leaks(spark.createDataFrame([(1, item)], "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == set(range(60))
