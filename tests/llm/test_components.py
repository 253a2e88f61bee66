import random

import pytest

from tessera.llm.components import connected


@pytest.mark.parametrize("links", [[], [(1, 1)], [(5, 3), (3, 9), (9, 5)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(random.Random(i).randrange(90), random.Random(-i - 1).randrange(90)) for i in range(70)], [(None, 4), (4, 7), (7, None)]])
def test_roots_are_least_nodes(spark, links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in list(root)}
