import numpy as np
import pytest

from pointloom.kernels import trees
from pointloom.operators.trees import diameters, isolate_trees, ring


def stand(rng, spots):
    parts, own = [], []
    for k, (x, y) in enumerate(spots):
        t = rng.uniform(0, 2 * np.pi, 250)
        trunk = np.stack([x + 0.15 * np.cos(t), y + 0.15 * np.sin(t), rng.uniform(0, 5, 250)], axis=1)
        crown = rng.normal(0, 0.6, (500, 3)) + [x, y, 6]
        parts.append(np.concatenate([trunk, crown]))
        own += [k] * 750
    return np.concatenate(parts), np.array(own)


def test_cut_pursuit_finds_steps():
    y = np.concatenate([np.zeros(30), np.ones(30) * 5, np.zeros(20)])[:, None] + np.random.default_rng(1).normal(0, 0.05, (80, 1))
    u = np.arange(79)
    comp = trees.cut_pursuit(y, u, u + 1, np.ones(79))
    assert len(np.unique(comp[:30])) == len(np.unique(comp[30:60])) == len(np.unique(comp[60:])) == 1
    assert comp[0] != comp[30] != comp[60]
    assert len(np.unique(trees.cut_pursuit(y, u, u + 1, np.full(79, 1e6)))) == 1


def test_trees_of_a_stand(spark):
    rng = np.random.default_rng(2)
    p, own = stand(rng, [(0, 0), (8, 0), (0, 9)])
    rows = [(e, k + 10_000 * e, *map(float, r)) for e in (1, 2) for k, r in enumerate(p)]
    df = spark.createDataFrame(rows, "entity_id int, ord long, x double, y double, z double").repartition(5)
    got = isolate_trees(df, cell1=0.2, cell2=0.3).collect()
    assert len(got) == len(rows) and len({(r.entity_id, r.ord) for r in got}) == len(rows)
    for e in (1, 2):
        label = np.zeros(len(p), dtype=int)
        for r in got:
            if r.entity_id == e:
                label[r.ord - 10_000 * e] = r.tree
        assert set(label) == set(range(1, label.max() + 1))
        # No tree reaches over to another, and each is mostly one.
        for t in set(label):
            assert len(set(own[label == t])) == 1
        assert min(np.bincount(label[own == k]).max() for k in range(3)) > 0.6 * 750
    assert isolate_trees(df.limit(0)).count() == 0
    one = isolate_trees(df.where("ord = 10000")).collect()
    assert [r.tree for r in one] == [1]


def test_diameter_and_rings(spark):
    rng = np.random.default_rng(3)
    level = [(10 + 0.15 * np.cos(a), 20 + 0.15 * np.sin(a), h * 0.5 + 1.3 * (h == 0)) for h in range(13) for a in np.arange(8) * np.pi / 4 + h]
    slice_ = [(10 + 0.15 * np.cos(a), 20 + 0.15 * np.sin(a), 1.3) for a in rng.uniform(0, 6.28, 40)]
    crown = [(8, 20, 11), (12, 20, 11), (10, 18, 11), (10, 22, 11), (10, 20, 12), (10, 20, 0)]
    rows = [(5, k, *map(float, r)) for k, r in enumerate([*level, *slice_, *crown])]
    got = diameters(spark.createDataFrame(rows, "entity_id int, ord long, x double, y double, z double")).first()
    assert (got.height, got.dbh_method, got.crown_width) == (12, "circle", 4) and got.dbh == pytest.approx(30, abs=0.2)
    assert got.crown_base_height == pytest.approx(8.4)
    c = spark.createDataFrame([(1, 0.0, 0.0, 2.0)], "id int, x double, y double, r double")
    assert {round(q.px**2 + q.py**2, 9) for q in ring(c, "r", 48).collect()} == {4.0}
