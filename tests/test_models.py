import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.kernels import fits, normals, raster
from pointloom.operators import clustering, fitting, ground, octree, registration
from pointloom.operators import filters as L
from pointloom.operators import normals as N
from pointloom.operators.aggregates import line_stats, mean_spacing
from pointloom.streaming import running


def cloud(spark, p, **more):
    rows = [(k, *map(float, r), *[v[k] for v in more.values()]) for k, r in enumerate(p)]
    return spark.createDataFrame(rows, "ord long, x double, y double, z double" + "".join(f", {k} int" for k in more)).repartition(3)


def ords(df):
    return sorted(r.ord for r in df.select("ord").collect())


def test_codec_round_trip_and_inversion():
    rng = np.random.default_rng(1)
    n = rng.normal(size=(5000, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    code = normals.encode(n)
    assert code.min() >= 0 and code.max() < 32768
    cos = (normals.unit(code) * n).sum(axis=1)
    assert np.degrees(np.arccos(np.clip(cos, -1, 1))).max() < 2
    assert (normals.encode(-n) == code ^ normals.FLIP).all()
    every = np.arange(32768)
    assert (normals.encode(normals.decode(every)) == every).mean() > 0.99
    assert normals.encode(np.zeros((1, 3)))[0] == normals.NONE and not normals.decode(np.array([normals.NONE])).any()


def test_plane(spark):
    rng = np.random.default_rng(2)
    n = np.array([0.3, 0.5, 1.0])
    n /= np.linalg.norm(n)
    u, v = fits.basis(n)
    p = rng.uniform(-5, 5, (1500, 1)) * u + rng.uniform(-5, 5, (1500, 1)) * v + 2 * n + rng.normal(0, 0.002, (1500, 1)) * n
    p = np.concatenate([p, rng.uniform(-5, 5, (500, 3))])
    df = cloud(spark, p)
    got = fitting.fit_plane(df, 0.01)
    assert abs(np.dot(got.normal, n)) > 0.9999 and got.d == pytest.approx(-2, abs=0.01)
    want = [k for k, r in enumerate(p) if abs(np.dot(r, got.normal) + got.d) <= 0.01]
    assert got.inliers == len(want) >= 1500 and ords(L.plane_inliers(df, got.normal, got.d, 0.01)) == want
    assert fitting.fit_plane(df.limit(2), 0.1) is None and fitting.fit_plane(df, 0.1, iterations=0) is None
    assert fitting.fit_plane(df.repartition(7), 0.01).normal == pytest.approx(got.normal, abs=1e-9)


def test_cylinder(spark):
    rng = np.random.default_rng(3)
    a = np.array([0.3, -0.2, 0.93])
    a /= np.linalg.norm(a)
    u, v = fits.basis(a)
    t, h = rng.uniform(0, 2 * np.pi, 1200), rng.uniform(-4, 4, 1200)
    out = np.cos(t)[:, None] * u + np.sin(t)[:, None] * v
    p = out * (2.5 + rng.normal(0, 0.002, (1200, 1))) + h[:, None] * a + np.array([7, -3, 120])
    p = np.concatenate([p, rng.uniform(-5, 5, (200, 3)) + np.array([7, -3, 120])])
    codes = normals.encode(np.concatenate([out, rng.normal(size=(200, 3))])).tolist()
    df = cloud(spark, p, normal_code=codes)
    for got in (fitting.fit_cylinder(df, 0.02, axis=tuple(3 * a)), fitting.fit_cylinder(df, 0.05)):
        assert abs(np.dot(got.axis, a)) > 0.9995 and got.radius == pytest.approx(2.5, abs=0.05) and got.inliers > 900
        assert got.half_height == pytest.approx(4, abs=0.5)
    assert fitting.fit_cylinder(df.drop("normal_code"), 0.02) is None and fitting.fit_cylinder(df, 0.02, axis=(0, 0, 0)) is None


def test_robust_circle():
    rng = np.random.default_rng(4)
    t = rng.uniform(0, 2 * np.pi, 60)
    p = np.stack([10 + 0.15 * np.cos(t), 20 + 0.15 * np.sin(t)], axis=1)
    assert fits.breast_height(np.concatenate([p, p[:5] + 0.3]))[:2] == (pytest.approx(30, abs=0.1), "circle")
    assert fits.breast_height(p[:0])[1] == "none" and fits.breast_height(p[:2])[1] == "centroid"


def rotation(axis, angle):
    a = np.array(axis) / np.linalg.norm(axis)
    k = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k


def test_alignment_and_icp(spark):
    rng = np.random.default_rng(5)
    p = rng.uniform(0, 10, (600, 3))
    r = rotation([0.1, 0.2, 0.97], 0.03)
    q = 1.0 * p @ r.T + np.array([0.1, -0.05, 0.08])
    found = fits.align(p[:20], 2 * q[:20], scale=True)
    assert found[0] == pytest.approx(r, abs=1e-9) and found[2] == pytest.approx(2)
    assert fits.align(p[:2], q[:2]) is None and fits.align(np.outer(np.arange(5.0), [1, 2, 3]), q[:5]) is None
    a, b = cloud(spark, p), cloud(spark, q)
    got = registration.icp(a, b)
    assert np.array(got["rotation"]) == pytest.approx(r, abs=1e-4) and got["rms"][-1] < got["rms"][0]
    moved = registration.moved(a, got).orderBy("ord").collect()
    assert max(abs(m.x - t[0]) for m, t in zip(moved, q, strict=True)) < 1e-3
    fine = registration.gicp(a, b, k=10)
    assert np.array(fine["rotation"]) == pytest.approx(r, abs=1e-3)
    with pytest.raises(ValueError, match="overlap"):
        registration.icp(a, b, overlap=0)


def test_grid_is_exact():
    rng = np.random.default_rng(6)
    p, q = rng.normal(size=(400, 3)) * [1, 5, 0.1], rng.normal(size=(100, 3)) * 4
    where, d = fits.Grid(p).nearest(q, 3)
    full = ((q[:, None] - p[None]) ** 2).sum(axis=2)
    assert np.sort(full, axis=1)[:, :3] == pytest.approx(d) and (np.argsort(full, axis=1, kind="stable")[:, :3] == where).all()


def test_normals(spark):
    x, y = np.meshgrid(np.arange(15) * 0.2, np.arange(15) * 0.2)
    p = np.stack([x.ravel(), y.ravel(), 0.5 * x.ravel() + 3], axis=1)
    p = np.concatenate([p, [[100, 100, 100]]])
    df = cloud(spark, p)
    got = {r.ord: r for r in N.estimate(df, 0.3, "+z").collect()}
    want = np.array([-0.5, 0, 1]) / math.sqrt(1.25)
    assert all(np.dot((r.nx, r.ny, r.nz), want) > 0.9999 and r.code < 32768 for k, r in got.items() if k < 225)
    assert got[225].nx is None and got[225].code == normals.NONE
    down = {r.ord: r for r in N.estimate(df, 0.3, "-z").collect()}
    assert all(np.array([down[k].nx, down[k].ny, down[k].nz]) == pytest.approx(-np.array([r.nx, r.ny, r.nz])) for k, r in got.items() if k < 225)
    assert {r.code for r in N.estimate(df, 0).collect()} == {normals.NONE}
    assert 0.3 < N.auto_radius(df.where("ord < 225"), 0.1) < 1.0


def test_cloth_and_ground(spark):
    rng = np.random.default_rng(7)
    xy = rng.uniform(0, 24, (1500, 2))
    z = 0.8 * np.sin(0.3 * xy[:, 0]) + 0.6 * np.cos(0.2 * xy[:, 1])
    tower = rng.uniform(0, 1, 1500) < 0.2
    p = np.concatenate([xy, (z + tower * rng.uniform(2, 5, 1500))[:, None]], axis=1)
    got = {r.ord: r.ground for r in ground.classify_ground(cloud(spark, p)).collect()}
    assert np.mean([got[k] != tower[k] for k in range(1500)]) > 0.93
    # The support against a direct search.
    r = 0.6
    nx, ny = int((p[:, 0].max() - p[:, 0].min()) / r) + 2, int((p[:, 1].max() - p[:, 1].min()) / r) + 2
    support = np.full((ny, nx), -math.inf)
    for j in range(ny):
        for i in range(nx):
            near = (p[:, 0] - p[:, 0].min() - i * r) ** 2 + (p[:, 1] - p[:, 1].min() - j * r) ** 2 <= (1.5 * r) ** 2
            support[j, i] = (-p[near, 2]).max(initial=-math.inf)
    cloth = raster.settle_cloth(support, -p[:, 2].max() + 2 * r, r)
    want = []
    for x, y, h in p:
        fx, fy = (x - p[:, 0].min()) / r, (y - p[:, 1].min()) / r
        i, j = int(min(fx, nx - 2)), int(min(fy, ny - 2))
        tx, ty = fx - i, fy - j
        at = (cloth[j, i] * (1 - tx) + cloth[j, i + 1] * tx) * (1 - ty) + (cloth[j + 1, i] * (1 - tx) + cloth[j + 1, i + 1] * tx) * ty
        want.append(abs(-h - at) <= 0.4)
    assert [got[k] for k in range(1500)] == want
    few = {r.ord for r in ground.classify_ground(cloud(spark, p), threshold=0.1).where("ground").collect()}
    assert few <= {k for k, v in got.items() if v}


def test_holes():
    z = np.full((4, 5), np.nan, dtype=np.float32)
    z[0, 0], z[3, 4] = 1, 3
    got = raster.fill_holes(z)
    assert not np.isnan(got).any() and got[0, 1] == 1 and got[3, 3] == 3 and 1 <= got.min() and got.max() <= 3


def test_line_candidates(spark):
    g = [(x, y, 0.0) for x in range(0, 40, 2) for y in range(0, 20, 2)]
    wire = [(x * 0.5, 10.0, 12 + 0.02 * (x * 0.5 - 20) ** 2 / 10) for x in range(80)]
    blob = np.random.default_rng(8).normal(size=(100, 3)) * 1.0 + [20, 3, 9]
    df = cloud(spark, [*g, *wire, *map(tuple, blob)])
    got = ground.line_candidates(df, df.where(F.col("ord") < len(g)), radius=1.5)
    found = set(ords(L.refine_lines(got)))
    assert len(found & set(range(len(g), len(g) + 80))) >= 76 and len([k for k in found if k >= len(g) + 80]) <= 10
    stats = line_stats(df.where(F.col("ord").between(len(g), len(g) + 79)).withColumn("line", F.lit(1))).first()
    assert stats["points"] == 80 and stats["length"] == pytest.approx(39.5) and stats["azimuth"] == pytest.approx(90) and stats["sag"] > 0.5


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_octree(spark, parts):
    rng = np.random.default_rng(9)
    p = np.concatenate([rng.uniform(0, 1, (700, 3)), np.tile([[0.3, 0.3, 0.3]], (60, 1))])
    got = octree.assign(cloud(spark, p).repartition(parts), cell=32, depth=6)
    assert ords(got) == list(range(760))
    sizes = {(r.leaf, r.depth): r.n for r in octree.nodes(got).collect()}
    assert sizes[1, 0] == 760
    for (leaf, depth), n in sizes.items():
        kids = [sizes.get((leaf * 8 + o, depth + 1)) for o in range(8)]
        assert all(k is None for k in kids) and (n <= 32 or depth == 6) or sum(k or 0 for k in kids) == n > 32
    assert 150 <= octree.budget(got, 200).count() <= 300


def test_frustum(spark):
    rng = np.random.default_rng(19)
    p = rng.uniform(0, 1, (900, 3))
    got = octree.assign(cloud(spark, p), cell=32, depth=5)
    planes = [(0.8, 0.6, 0.0, -0.5), (0.0, -1.0, 0.0, 0.8)]
    low, size = p.min(axis=0), (p.max(axis=0) - p.min(axis=0)).max()

    def state(leaf, depth):
        for level in range(depth + 1):
            path = leaf >> 3 * (depth - level)
            cell = [sum((path >> (3 * b + 2 - j) & 1) << b for b in range(level)) for j in range(3)]
            centre, radius = low + size * (np.array(cell) + 0.5) / 2**level, size / 2**level * 3**0.5 / 2
            far = [np.dot(q[:3], centre) + q[3] for q in planes]
            if min(far) < -radius:
                return octree.OUTSIDE
            if min(far) >= radius:
                return octree.INSIDE
        return octree.CROSSING

    flags = octree.flagged(got, planes)
    rows = flags.collect()
    assert sum(r.n for r in rows) == 900 and len({r.state for r in rows}) == 3
    assert all(r.state == state(r.leaf, r.depth) for r in rows)
    seen = {r.leaf for r in rows if r.state != octree.OUTSIDE}
    few, more = (octree.gathered(got, flags, n).collect() for n in (60, 120))
    assert {r.leaf for r in few} == {r.leaf for r in more} == seen and 60 <= len(few) <= 60 + len(seen)
    assert octree.gathered(got, flags, 10**6).count() == sum(r.n for r in rows if r.leaf in seen)
    assert octree.gathered(got, flags, 0).count() == 0
    assert {r.state for r in octree.flagged(got, []).collect()} == {octree.INSIDE}


def quotas_brute(rows, points):
    most = {e: min(v, c) for e, v, c in rows if v > 0}
    if not most or points <= 0:
        return dict.fromkeys([e for e, *_ in rows], 0)
    out = {e: min(m, math.ceil(points * 0.25 / len(most))) for e, m in most.items()}
    rest, lack = points - sum(out.values()), {e: most[e] - out[e] for e in out}
    whole = sum(lack.values())
    for k, e in enumerate(sorted(out)):
        if lack[e] > 0 and rest > 0:
            add = min(lack[e], rest, rest if k == len(out) - 1 else math.ceil(lack[e] / whole * rest))
            out[e], rest = out[e] + add, rest - add
    return {e: out.get(e, 0) for e, *_ in rows}


@pytest.mark.parametrize("points", [0, 7, 100, 997, 10**6])
def test_quotas(spark, points):
    rng = np.random.default_rng(20)
    rows = [(k, int(v), int(c)) for k, (v, c) in enumerate(zip(rng.integers(0, 400, 9) * rng.integers(0, 2, 9), rng.integers(1, 300, 9), strict=True))]
    got = {r.entity_id: r.quota for r in octree.quotas(spark.createDataFrame(rows, "entity_id int, visible long, capacity long"), points).collect()}
    assert got == quotas_brute(rows, points) and sum(got.values()) <= max(points, sum(1 for _, v, _ in rows if v))


def test_degenerate_parameters(spark):
    df = cloud(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (100, 100, 100), (0, 0, 0)])
    assert L.radius_filter(df, 0, 1).count() == 0 and L.radius_filter(df, 1, 0).count() == 5
    assert ords(L.radius_filter(df, 1.0, 2)) == [0, 1, 2, 4] and L.voxel_downsample(df, 0).count() == 5
    assert ords(L.statistical_filter(df.where("ord < 4"), 2, 1.0, 1.0)) == [0, 1, 2]
    assert L.statistical_filter(df, 0).count() == 5 and ords(L.voxel_downsample(df, 1000)) == [1]
    assert {r.label for r in clustering.cluster(df, 0).collect()} == {1, 2, 3, 4, 5}
    assert {(r.ord, r.label, r.size) for r in clustering.cluster(df, 1.0).collect()} == {(0, 1, 4), (1, 1, 4), (2, 1, 4), (4, 1, 4), (3, 2, 1)}
    hand = cloud(spark, [(0, 0, 0), (3, 0, 0), (0, 0.9, 0), (5, 0, 0), (6.5, 0, 0), (5, 0.8, 0)])
    assert ords(L.voxel_downsample(hand, 4)) == [0, 3]
    assert mean_spacing(df.limit(1)).first().spacing == 1.0
    empty = df.limit(0)
    assert L.radius_filter(empty, 1).count() == L.voxel_downsample(empty, 1).count() == L.statistical_filter(empty, 2).count() == clustering.cluster(empty, 1).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_depend_on_partitions(spark, parts):
    p = np.random.default_rng(10).uniform(-1, 1, (300, 3))
    a, b = cloud(spark, p), cloud(spark, p).repartition(parts)
    for f in (lambda d: L.radius_filter(d, 0.25, 3), lambda d: L.statistical_filter(d, 5, 0.5, 0.3), lambda d: L.voxel_downsample(d, 0.4)):
        assert ords(f(a)) == ords(f(b))
    label = lambda d: sorted((r.ord, r.label) for r in clustering.cluster(d, 0.2).collect())
    assert label(a) == label(b)


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    cloud(spark, [(0, 0, 0), (1, 2, 3), (4, 5, 6)]).write.parquet(src)
    stream = spark.readStream.schema("ord long, x double, y double, z double").parquet(src)
    for name, df in (("box", running.running_box(stream)), ("hist", running.running_histogram(stream, 0.0, 6.0, 6))):
        q = df.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(60)
    assert spark.table("box").first().max_z == 6 and {(r.bin, r.n) for r in spark.table("hist").collect()} == {(0, 1), (3, 1), (5, 1)}


def test_quadric_normals_on_a_sphere(spark):
    rng = np.random.default_rng(13)
    n = rng.normal(size=(1500, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    n[:, 2] = np.abs(n[:, 2])
    df = cloud(spark, 4 * n + [1, 2, 3])
    worst = {}
    for model in ("plane", "quadric"):
        got = {r.ord: (r.nx, r.ny, r.nz) for r in N.estimate(df, 1.0, "+z", model).collect()}
        cos = [abs(np.dot(got[k], n[k])) for k in range(1500) if n[k, 2] < 0.3]  # near the rim
        worst[model] = np.degrees(np.arccos(np.clip(np.mean(cos), -1, 1)))
    assert worst["quadric"] < 1.5 and worst["quadric"] < worst["plane"]
