import pytest

from textloom.operators import points


def test_chain_deeper_than_64(spark):
    tree = spark.createDataFrame([(0, None)] + [(i, i - 1) for i in range(1, 71)], "node long, parent long")
    assert sorted((r["node"], r["depth"]) for r in points.levels(tree.coalesce(1), 0).collect()) == [(i, i) for i in range(71)]


def test_cycle(spark):
    with pytest.raises(ValueError, match="two levels"):
        points.levels(spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "node long, parent long"), 0)
