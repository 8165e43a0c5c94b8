import math

import numpy as np
import pytest

from pointloom.kernels import cloth
from pointloom.operators import ground, powerline
from tests.test_models import cloud


def one_by_one(heights, start, rigidness, iterations, step):
    """The cloth with its sweep as nested loops."""
    rows, cols = heights.shape
    springs = cloth.links(rows, cols)
    floor = cloth.fill(heights, springs).reshape(-1)
    n = rows * cols
    now, old, free = [float(start)] * n, [float(start)] * n, [True] * n
    f, g = cloth.BESIDE_PINNED[rigidness], cloth.BESIDE_FREE[rigidness]
    for _ in range(iterations):
        for k in range(n):
            if free[k]:
                now[k], old[k] = now[k] + (now[k] - old[k]) * 0.99 - 0.2 * step * step, now[k]
        for p in range(n):
            for q in springs[p]:
                if q < 0:
                    break
                gap = now[q] - now[p]
                if free[p] and free[q]:
                    now[p] += gap * g
                    now[q] -= gap * g
                elif free[p]:
                    now[p] += gap * f
                elif free[q]:
                    now[q] -= gap * f
        most = max((abs(old[k] - now[k]) for k in range(n) if free[k]), default=0.0)
        for k in range(n):
            if now[k] < floor[k]:
                now[k], free[k] = floor[k], False
        if 0 < most < 0.005:
            break
    return np.array(now).reshape(rows, cols)


@pytest.mark.parametrize("rigidness", [1, 2, 3])
def test_waves_equal_one_by_one(rigidness):
    rng = np.random.default_rng(rigidness)
    h = rng.normal(0, 0.5, (9, 13))
    h[rng.uniform(size=h.shape) < 0.2] = np.nan
    assert cloth.simulate(h, 3.0, rigidness, 60) == pytest.approx(one_by_one(h, 3.0, rigidness, 60, 0.65), abs=1e-12)


def test_links():
    got = cloth.links(4, 4)
    for k in range(16):
        r, c = divmod(k, 4)
        want = {(r + i * s) * 4 + c + j * s for s in (1, 2) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and 0 <= r + i * s < 4 and 0 <= c + j * s < 4}
        assert set(got[k][got[k] >= 0].tolist()) == want
    assert got[0][:3].tolist() == [1, 4, 5]


def test_elastic_ground(spark):
    rng = np.random.default_rng(11)
    xy = rng.uniform(0, 30, (2500, 2))
    block = (np.abs(xy - 15) < 5).all(axis=1) & (rng.uniform(size=2500) < 0.5)
    p = np.concatenate([xy, np.where(block, 3.0, 0.02 * xy[:, 0])[:, None]], axis=1)
    df = cloud(spark, p)
    got = {r.ord: r.ground for r in ground.classify_ground_elastic(df, 1.0, 0.5).collect()}
    assert not any(got[k] for k in range(2500) if block[k])
    assert np.mean([got[k] for k in range(2500) if not block[k]]) > 0.95
    few = {r.ord for r in ground.classify_ground_elastic(df, 1.0, 0.2).where("ground").collect()}
    assert few <= {k for k, v in got.items() if v}
    assert ground.classify_ground_elastic(df, 0, 0.5).where("ground").count() == 0
    steep = {r.ord for r in ground.classify_ground_elastic(df, 1.0, 0.5, smooth=True).where("ground").collect()}
    assert len(steep) >= 0.95 * (~block).sum()


def test_power_lines(spark):
    base = lambda x: 100 + 0.05 * x
    u = np.arange(0, 300.5, 0.5) / 300
    wires = [[(300 * t, y, base(300 * t) + 25 - 32 * t * (1 - t)) for t in u] for y in (20, 24)]
    v = np.arange(0, 180.5, 0.5) / 180
    wires.append([(100, -90 + 180 * t, base(100) + 24.6 - 24 * t * (1 - t)) for t in v])
    wires[0] = [q for q in wires[0] if not 140 < q[0] < 148]  # a gap
    rng = np.random.default_rng(12)
    crowns = [tuple(c + 2.5 * d / np.linalg.norm(d)) for c in ([40, -40, 110], [200, 60, 118]) for d in rng.normal(size=(150, 3))]
    soil = [(x, y, base(x)) for x in range(0, 301, 10) for y in range(-100, 101, 10)]
    p = [*soil, *(q for w in wires for q in w), *crowns]
    df = cloud(spark, p)
    found = ground.line_candidates(df, df.where(f"ord < {len(soil)}"), 4.0, 2.0, 10.0)
    points, lines = powerline.trace(found.where("linearity >= 0.85"))
    rows = lines.orderBy("line").collect()
    assert [r.line for r in rows] == [1, 2, 3] and sorted(round(r.length, -1) for r in rows) == [180, 300, 300]
    assert max(r.gaps for r in rows) >= 1 and sorted(round(r.azimuth) % 180 for r in rows) == [0, 90, 90]
    start, share = len(soil), []
    got = {r.ord: r.line for r in points.collect()}
    for w in wires:
        own = [got.get(k) for k in range(start, start + len(w))]
        share.append(max(own.count(x) for x in (1, 2, 3)) / len(w))
        start += len(w)
    assert min(share) > 0.93 and not [k for k in got if k >= start]
    none, empty = powerline.trace(df.limit(0))
    assert none.count() == empty.count() == 0 and math.isfinite(sum(share))
