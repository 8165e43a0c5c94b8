import struct

import pytest

from pointloom.sources.las import las_info, read_las, write_las, write_plan
from pointloom.sources.ply import ply_info, read_cloud, scan_box, write_ply


@pytest.fixture(scope="module")
def points(spark):
    rows = [(k, 500000 + k * 0.25, 4000000 - k * 0.25, 30 + (k % 7) * 0.5, k % 256, (k * 3) % 256, 7, k % 32, k % 300) for k in range(1000)]
    return spark.createDataFrame(rows, "ord long, ox double, oy double, oz double, red smallint, green smallint, blue smallint, classification smallint, treeid int")


FIELDS = ["ord", "ox", "oy", "oz", "red", "green", "blue", "classification", "treeid"]


def listed(df):
    return [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(FIELDS).orderBy("ord").collect()]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_las_round_trip(spark, points, tmp_path, parts):
    path = str(tmp_path / "a.las")
    write_las(points.repartition(parts), path)
    info = las_info(path)
    assert (info.count, info.format, info.version) == (1000, 3, (1, 2))
    assert info.least == pytest.approx((500000, 3999750.25, 30)) and info.most == pytest.approx((500249.75, 4000000, 33))
    assert listed(read_las(spark, path, recordsPerPartition=300)) == listed(points)
    assert [p.name for p in tmp_path.iterdir()] == ["a.las"]


def test_las_refuses_classes(points, tmp_path):
    from pyspark.sql import functions as F

    with pytest.raises(ValueError, match="class 40"):
        write_las(points.withColumn("classification", F.lit(40).cast("smallint")), str(tmp_path / "b.las"))
    assert not list(tmp_path.iterdir())


def test_las_header_errors(tmp_path):
    bad = tmp_path / "c.las"
    bad.write_bytes(b"NOPE" + bytes(400))
    with pytest.raises(ValueError, match="no LAS"):
        las_info(str(bad))
    head = bytearray(400)
    head[:4], head[24:26], head[104] = b"LASF", bytes([1, 3]), 4
    bad.write_bytes(bytes(head))
    with pytest.raises(ValueError, match="format 4"):
        las_info(str(bad))


def test_las_masks_flags_and_keeps_small_colours(spark, tmp_path):
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", bytes([1, 2])
    struct.pack_into("<HIIBHI", head, 94, 227, 227, 0, 3, 34, 2)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 10, 20, 30)
    record = struct.pack("<iiiHBBbBHdHHH", 100, 200, -300, 100, 9, 0x22, 0, 0, 5, 1234.5, 200, 100, 50)
    path = tmp_path / "d.las"
    path.write_bytes(bytes(head) + record * 2)
    rows = read_las(spark, str(path)).orderBy("ord").collect()
    assert [(r.ox, r.oy, r.oz, r.classification, r.treeid, r.red) for r in rows] == [(11.0, 22.0, 27.0, 2, 5, 200)] * 2


def test_plan_coarsens():
    assert write_plan((0, 0, 0), (100, 200, 270.3)) == (0.001, (50, 100, 135.15))
    assert write_plan((0, 0, 0), (1e7, 1, 1))[0] == pytest.approx(0.01)


def test_ply_round_trip(spark, points, tmp_path):
    path = str(tmp_path / "e.ply")
    write_ply(points.repartition(3), path, label_no=None)
    info = ply_info(path)
    assert (info.count, info.layout.itemsize) == (1000, 30)
    assert listed(read_cloud(spark, path)) == listed(points)
    assert scan_box(read_cloud(spark, path)).first()["max_x"] == 500249.75
    write_ply(points.drop("red", "green", "blue"), path, label_no=9)
    first = read_cloud(spark, path).where("ord = 0").first()
    assert (first.red, first.treeid) == (218, 9)


def test_empty(spark, points, tmp_path):
    path = str(tmp_path / "f.las")
    write_las(points.limit(0), path)
    assert read_las(spark, path).count() == 0
