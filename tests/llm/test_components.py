"""Connected components against a plain union of sets."""

import random

import pytest

from corvane.llm.common import Scratch
from corvane.llm.components import connected_components

RANDOM = random.Random(5)
LINKS = {
    "none": [],
    "stars": [(9, 1), (8, 1), (7, 2), (2, 2), (5, 5)],
    "path": [(i, i + 1) for i in range(40)],
    "mixed path": [(a, b) for a, b in zip(*(lambda p: (p, p[1:]))(RANDOM.sample(range(-30, 30), 60)), strict=False)],
    "hot centre in the middle": [(50, i) for i in range(100)] + [(120, 121), (121, 120), (120, 121)],
    "random": [(RANDOM.randrange(200), RANDOM.randrange(200)) for _ in range(130)],
}


def plain(links):
    comp = {x: {x} for link in links for x in link}
    for u, v in links:
        if comp[u] is not comp[v]:
            comp[u] |= comp[v]
            for x in comp[v]:
                comp[x] = comp[u]
    return {(x, min(c)) for x, c in comp.items()}


@pytest.mark.parametrize("name", LINKS)
def test_components(spark, name):
    links = spark.createDataFrame(LINKS[name], "u long, v long")
    got = [tuple(r) for r in connected_components(links, Scratch(spark, "components"), "c").select("node", "comp").collect()]
    assert len(got) == len(set(got)) and set(got) == plain(LINKS[name])
