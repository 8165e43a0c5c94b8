"""Measurements, formats, bit fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def minus(a: str, b: str) -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{a}.{n}") - F.col(f"{b}.{n}") for n in AXES)


def length(v) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def distance(a: str, b: str) -> Column:
    """Distance of two points, the differences along the axes, and the distances in the planes."""
    dx, dy, dz = minus(b, a)
    return F.struct(length((dx, dy, dz)).alias("distance"), dx.alias("dx"), dy.alias("dy"), dz.alias("dz"), F.hypot(dx, dy).alias("dxy"), F.hypot(dx, dz).alias("dxz"), F.hypot(dz, dy).alias("dzy"))


def angle(u, v) -> Column:
    """Degrees between two vectors; NaN where one has no length."""
    lu, lv = length(u), length(v)
    cos = (u[0] * v[0] + u[1] * v[1] + u[2] * v[2]) / (lu * lv)
    return F.when((lu == 0) | (lv == 0), float("nan")).otherwise(F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos)))))


def triangle(a: str, b: str, c: str) -> Column:
    """Angles at the corners, sides and area."""
    ab, ac, bc = minus(b, a), minus(c, a), minus(c, b)
    neg = lambda v: tuple(-x for x in v)
    cross = (ab[1] * ac[2] - ab[2] * ac[1], ab[2] * ac[0] - ab[0] * ac[2], ab[0] * ac[1] - ab[1] * ac[0])
    return F.struct(angle(ab, ac).alias("angle_a"), angle(neg(ab), bc).alias("angle_b"), angle(neg(ac), neg(bc)).alias("angle_c"), length(ab).alias("ab"), length(bc).alias("bc"), length(ac).alias("ca"), (length(cross) / 2).alias("area"))


def to_screen(matrix: list[float], width: int, height: int) -> Column:
    """Pixel position of x, y, z by a column-major matrix; null behind the eye."""
    row = [matrix[k] * F.col("x") + matrix[k + 4] * F.col("y") + matrix[k + 8] * F.col("z") + matrix[k + 12] for k in range(4)]
    ok = row[3] > 0
    return F.struct(F.when(ok, (row[0] / row[3] + 1) / 2 * width).alias("px"), F.when(ok, (1 - row[1] / row[3]) / 2 * height).alias("py"))


def fixed(v: Column, digits: int) -> Column:
    """Decimals without grouping; empty for null, NaN and infinities."""
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, "").otherwise(F.regexp_replace(F.format_number(v, digits), ",", ""))


def grouped(v: Column, digits: int = 0) -> Column:
    return F.format_number(v, digits)


def axis_line(axis: str, low: Column, high: Column, digits: int = 3) -> Column:
    return F.concat(F.lit(f"{axis}: "), fixed(high - low, digits), F.lit(" ("), fixed(low, digits), F.lit(" : "), fixed(high, digits), F.lit(")"))


def center_line(x: Column, y: Column, z: Column, digits: int = 4) -> Column:
    return F.concat(F.lit("X: "), fixed(x, digits), F.lit("  Y: "), fixed(y, digits), F.lit("  Z: "), fixed(z, digits))


def shift_line(x: Column, y: Column, z: Column) -> Column:
    return F.concat(F.lit("("), fixed(-x, 2), F.lit(";"), fixed(-y, 2), F.lit(";"), fixed(-z, 2), F.lit(")"))


def scale_bar(width: Column) -> Column:
    """The width rounded down to a multiple, at least one, of half its power of ten."""
    step = F.pow(F.lit(10.0), F.floor(F.log10(width))) / 2
    return F.floor(F.greatest(width / step, F.lit(1.0))) * step


def scale_label(value: Column) -> Column:
    """As many decimals as the magnitude asks for, without zeros at the end; empty unless positive and finite."""
    digits = F.greatest(F.lit(0), F.least(F.lit(12), 1 - F.floor(F.log10(value)))).cast("int")
    text = F.format_string("%.0f", value)
    for d in range(1, 13):
        text = F.when(digits == d, F.regexp_replace(F.format_string(f"%.{d}f", value), r"\.?0+$", "")).otherwise(text)
    bad = value.isNull() | F.isnan(value) | (value <= 0) | (value == float("inf"))
    return F.when(bad, "").otherwise(text)


def half_height(fov_degrees: Column, distance: Column) -> Column:
    """Half of what a camera sees at a distance."""
    return distance * F.tan(F.radians(fov_degrees) / 2)


def camera_distance(top: Column, fov_degrees: Column, zoom: Column) -> Column:
    """The distance at which a perspective camera sees as much as an orthographic one."""
    return top / (zoom * F.tan(F.radians(fov_degrees) / 2))


def units_per_pixel(top: Column, zoom: Column, pixels: Column) -> Column:
    return 2 * top / (zoom * pixels)


def packed(node: Column, index: Column, bits: int = 24) -> Column:
    """A chunk number and an index in one number."""
    return F.shiftleft(node.cast("long"), bits).bitwiseOR(index.cast("long"))


def unpacked(code: Column, bits: int = 24) -> Column:
    return F.struct(F.shiftrightunsigned(code, bits).alias("node"), code.bitwiseAND(F.lit((1 << bits) - 1)).alias("index"))


def child_index(mask: Column, octant: Column) -> Column:
    """Place of an octant's child among those that a mask has; -1 where it has none."""
    one = F.lit(1).cast("int")
    bit = F.call_function("shiftleft", one, octant.cast("int"))
    return F.when(mask.bitwiseAND(bit) == 0, -1).otherwise(F.bit_count(mask.bitwiseAND(bit - 1)))


def file_name(name: Column, extension: str) -> Column:
    """A name for saving: without its source's extension, without characters that file systems refuse, cloud if nothing is left."""
    base = F.regexp_replace(name, r"(?i)\.(ply|las|laz|pcd|xyz|txt)$", "")
    safe = F.trim(F.regexp_replace(base, r'[\\/:*?"<>|]', "_"))
    return F.concat(F.when(safe.rlike("^_*$"), "cloud").otherwise(safe), F.lit(f".{extension}"))
