"""p4_groups: texts of any length take part, and every document has a row."""

import re
from itertools import combinations

from textloom.llm import queries

ROWS = [(1, "a b c d e f g h"), (2, "A b, c d e f g h i"), (3, "a b c d e f g h"), (4, "one two"), (5, "One two!"), (6, "two one"), (7, ""), (8, None), (9, "..."), (10, "p q r s t"), (11, "p q r s t u")]
ROWS += [(20, " ".join(f"w{i}" for i in range(30))), (21, " ".join(f"w{i}" for i in range(31)))]


def runs(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return set(zip(*(w[i:] for i in range(5)))) or ({tuple(w)} if w else set())


def test_groups_of_short_texts(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {d: runs(t) for d, t in ROWS}
    group = {d: d for d in sets}
    similar = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in ROWS:
        for a, b in similar:
            group[a] = group[b] = min(group[a], group[b])
    got = [(r["doc_id"], r["group_id"]) for r in queries.p4_groups(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(group.items()) and similar == [(1, 2), (1, 3), (2, 3), (4, 5), (20, 21)]
