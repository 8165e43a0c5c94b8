import random

import pytest

from pointloom.plans import components as C


def brute(edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        before = dict(root)
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return sorted((x, r) for x, r in root.items() if x != r)


@pytest.mark.parametrize("shape", ["none", "loop", "chain", "random", "star"])
def test_few_edges_need_no_rounds(spark, monkeypatch, shape):
    rng = random.Random(5)
    edges = {"none": [], "loop": [(3, 3)], "chain": [(k, k + 1) for k in range(400)], "random": [(rng.randrange(500), rng.randrange(500)) for _ in range(260)], "star": [(900, k) for k in range(300)]}[shape]
    df = spark.createDataFrame(edges + [(None, 1), (2, None)], "a long, b long").repartition(7)
    tables = []
    write = C.written
    monkeypatch.setattr(C, "written", lambda df: tables.append(1) or write(df))
    got = [tuple(r) for r in C.connected_components(df).orderBy("id").collect()]
    assert got == brute(edges)
    assert len(tables) <= 2  # a table for each round, before


@pytest.mark.parametrize("alone", [0, 100])
def test_rounds_agree(spark, monkeypatch, alone):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(210)] + [(1000, k) for k in range(500, 520)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    monkeypatch.setattr(C, "ALONE", alone)
    assert [tuple(r) for r in C.connected_components(df).orderBy("id").collect()] == brute(edges)
