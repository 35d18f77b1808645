import random

import pytest

from recordloom.operators import closure


def brute(pairs):
    own = {}
    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        x, y = own.get(a, {a}), own.get(b, {b})
        z = x | y
        for i in z:
            own[i] = z
    return {i: min(z) for i, z in own.items()}


@pytest.mark.parametrize("per_task", [200_000, 40])
def test_components(spark, monkeypatch, per_task):
    monkeypatch.setattr(closure, "EDGES_PER_TASK", per_task)
    r = random.Random(per_task)
    pairs = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5, 5), (None, 3), (2000, 2001), (2001, 2000)]
    got = closure.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(got) == len({x.id for x in got})
    assert {x.id: x.component for x in got} == brute(pairs)


def test_text_ids_and_empty(spark):
    got = closure.connected_components(spark.createDataFrame([("10", "9"), ("9", "x")], "p string, q string"), "p", "q")
    assert {tuple(r) for r in got.collect()} == {("10", "10"), ("9", "10"), ("x", "10")}
    assert closure.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
