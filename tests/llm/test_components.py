import random

import pytest

from halcyon.llm import components
from tests.llm.conftest import components_of


@pytest.mark.parametrize("limit", [200_000, 0])
def test_both_ways(spark, monkeypatch, limit):
    random.seed(4)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1025)] + [(5, 5)]
    monkeypatch.setattr(components, "TASK_LINKS", limit)
    df = spark.createDataFrame(edges, "a long, b long")
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    rows = components.connected_components(df).collect()
    assert len(rows) == len(nodes) and dict(map(tuple, rows)) == components_of(edges, nodes)
    assert components.connected_components(df.limit(0)).count() == 0
