"""Components against union-find, in one call and in two."""

import random

import pytest

from pageloom.llm import graph


def plain(links):
    above = {}

    def top(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return {x: top(x) for x in above if top(x) != x}


def shuffled_chain():
    order = list(range(60))
    random.Random(2).shuffle(order)
    return list(zip(order, order[1:], strict=False))


RNG = random.Random(1)
SHAPES = {"chain": [(i, i + 1) for i in range(30)], "shuffled": shuffled_chain(), "hub": [(50, i) for i in range(50)], "random": [(RNG.randrange(200), RNG.randrange(200)) for _ in range(130)], "none": []}


@pytest.mark.parametrize("shape", SHAPES)
def test_components(spark, shape):
    links, half = SHAPES[shape], len(SHAPES[shape]) // 2

    def made(rows):
        return spark.createDataFrame(rows, "a long, b long")

    first = graph.components(made(links[:half]))
    for got in (graph.components(made(links)), graph.components(made(links[half:]), first)):
        assert {r.node: r.root for r in got.collect()} == plain(links)
