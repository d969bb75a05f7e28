import pytest

from clausegraph.llm import simhash


def test_components_at_once_are_those_of_the_rounds(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (6, 6), (-7, 5), (2, 1)], "a long, b long")
    want = sorted(map(tuple, simhash.components(edges).collect()))
    assert want and sorted(map(tuple, simhash.components_at_once(edges).collect())) == want
    assert simhash.components_at_once(edges.where("a = 6")).count() == 0
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, simhash.components_at_once(edges).collect())) == want


def test_unsettled_components_are_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        simhash.components(path, rounds=1)
    assert {r["head"] for r in simhash.components(path).collect()} == {0}
