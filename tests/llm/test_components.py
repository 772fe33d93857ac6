"""Connected components against union-find, and what the driver has to plan for a step."""

import random

import pytest

from quietwatch.llm import components


def by_hand(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in list(parent)}


@pytest.mark.parametrize("seed", [1, 2])
def test_steps_of_three_shuffles_find_the_components(spark, monkeypatch, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)]
    links += [(i, i + 1) for i in range(300, 340)]
    links += [(499, 500 + i) for i in range(40)] + [(900, 800 + i) for i in range(40)]
    plans, through = [], components.checkpointed

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return through(df)

    monkeypatch.setattr(components, "checkpointed", kept)
    got = {tuple(r) for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == by_hand(links)
    # a step was a plan of two joins, five aggregates and an aggregate more for its mark
    for plan in plans[1:]:
        assert "Join" not in plan and plan.count("Window") <= 4 and plan.count("Aggregate") == 1
