"""Colour functions: sRGB, HSL, labels, classes, elevation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label colours, golden angle of labels and of classes, elevation anchors, class palette.
LABEL_ANGLE, LABEL_SATURATION, LABEL_LIGHTNESS, NOISE_GREY = 137.508, 0.75, 0.55, 110
CLASS_ANGLE, CLASS_SATURATION, CLASS_VALUE = 137.50776405003785, 0.8, 0.95
SHADE_STEP, SHADE_LEAST, SHADE_MOST = 0.2, 0.28, 0.82
ELEVATION_ANCHORS = [(0, 0, 255), (0, 128, 255), (0, 255, 255), (0, 255, 128), (0, 255, 0), (128, 255, 0), (255, 255, 0), (255, 128, 0), (255, 0, 0)]
CLASS_COLOURS = [
    (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (255, 0, 255), (0, 255, 255), (128, 0, 0), (0, 128, 0), (0, 0, 128), (128, 128, 0),
    (128, 0, 128), (0, 128, 128), (192, 192, 192), (128, 128, 128), (255, 165, 0), (128, 0, 64), (64, 128, 0), (0, 64, 128), (128, 64, 0), (0, 102, 204), (255, 102, 0),
]
CLASS_NAMES = [
    "未定义点", "未分类点", "地面点", "低植被", "中等植被", "高植被", "建筑物", "低点", "关键点", "水体", "屋顶",
    "保留字段", "孤立点", "铁轨", "河流", "导线", "电力塔", "电力线", "道路面", "杆状物", "交通标志", "堆方体点",
]


def half_up(v: Column) -> Column:
    """Rounding with halves upward."""
    return F.floor(v + 0.5).cast("int")


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))


def linear_to_srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, 1 / 2.4) - 0.055)


def byte_to_linear(v: Column) -> Column:
    return srgb_to_linear(v / 255)


def linear_to_byte(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), half_up(linear_to_srgb(c) * 255)))


def byte_to_linear_byte(v: Column) -> Column:
    return half_up(byte_to_linear(v) * 255)


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _wheel(hue: Column, c: Column, m: Column) -> Column:
    """Bytes r, g, b on the hue circle for chroma c and offset m."""
    return let(F.struct((F.pmod(hue, F.lit(360.0)) / 60).alias("h"), c.alias("c"), m.alias("m")), lambda v: _sextant(v["h"], v["c"], v["m"]))


def _sextant(h: Column, c: Column, m: Column) -> Column:
    x = c * (1 - F.abs(F.pmod(h, F.lit(2.0)) - 1))
    zero = F.lit(0.0)
    pick = lambda *six: F.when(h < 1, six[0]).when(h < 2, six[1]).when(h < 3, six[2]).when(h < 4, six[3]).when(h < 5, six[4]).otherwise(six[5])
    parts = (pick(c, x, zero, zero, x, c), pick(x, c, c, x, zero, zero), pick(zero, zero, x, c, c, x))
    return F.struct(*[half_up((p + m) * 255).alias(n) for p, n in zip(parts, "rgb", strict=True)])


def hsl_to_rgb(h: Column, s: Column, light: Column) -> Column:
    c = (1 - F.abs(2 * light - 1)) * s
    return _wheel(h, c, light - c / 2)


def rgb_to_hsl(r: Column, g: Column, b: Column) -> Column:
    return let(F.struct((r / 255).alias("r"), (g / 255).alias("g"), (b / 255).alias("b")), lambda v: _hsl(v["r"], v["g"], v["b"]))


def _hsl(r: Column, g: Column, b: Column) -> Column:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = top - low, (top + low) / 2
    hue = F.when(top == r, 60 * (((g - b) / d) % 6)).when(top == g, 60 * ((b - r) / d + 2)).otherwise(60 * ((r - g) / d + 4))
    grey = d == 0
    return F.struct(F.when(grey, 0.0).otherwise(F.pmod(hue + 360, F.lit(360.0))).alias("h"), F.when(grey, 0.0).otherwise(d / (1 - F.abs(2 * light - 1))).alias("s"), light.alias("l"))


def label_colour(label: Column) -> Column:
    return hsl_to_rgb((label - 1) * LABEL_ANGLE, F.lit(LABEL_SATURATION), F.lit(LABEL_LIGHTNESS))


def point_colour(label: Column, kept: Column, base: int = 1) -> Column:
    """Linear bytes of a label's colour; grey where it is not positive or not kept."""
    rgb = label_colour(label + (base - 1))
    grey = byte_to_linear_byte(F.lit(NOISE_GREY))
    return F.struct(*[F.when(kept & (label > 0), byte_to_linear_byte(rgb[n])).otherwise(grey).alias(n) for n in "rgb"])


def derived_shade(r: Column, g: Column, b: Column, index: Column, count: Column) -> Column:
    """The index-th of count shades of one colour, the brightest first."""
    offset = ((count - 1) / 2 - index) * SHADE_STEP
    return let(rgb_to_hsl(r, g, b), lambda v: hsl_to_rgb(v["h"], v["s"], F.least(F.lit(SHADE_MOST), F.greatest(F.lit(SHADE_LEAST), v["l"] + offset))))


def class_colour(value: Column) -> Column:
    """The palette's colour, or a generated one for classes from 22 on."""
    fixed = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(c, "rgb", strict=True)]) for c in CLASS_COLOURS])
    c = CLASS_VALUE * CLASS_SATURATION
    return F.when(value < len(CLASS_COLOURS), F.get(fixed, value.cast("int"))).otherwise(_wheel((value - 32) * CLASS_ANGLE, F.lit(c), F.lit(CLASS_VALUE - c)))


def class_name(value: Column) -> Column:
    names = F.array(*[F.lit(n) for n in CLASS_NAMES])
    text = value.cast("string")
    return F.when(value < len(CLASS_NAMES), F.get(names, value.cast("int"))).when(value <= 63, F.concat(F.lit("保留 "), text)).otherwise(F.concat(F.lit("自定义 "), text))


def elevation_ramp(k: Column, bins: int = 256) -> Column:
    """sRGB bytes of a bin on the elevation ramp."""
    last = len(ELEVATION_ANCHORS) - 1
    t = k / (bins - 1) * last
    i = F.least(F.floor(t), F.lit(last - 1)).cast("int")
    f = t - i
    anchors = [F.array(*[F.lit(a[c]) for a in ELEVATION_ANCHORS]) for c in range(3)]
    return F.struct(*[half_up(F.get(a, i) + (F.get(a, i + 1) - F.get(a, i)) * f).alias(n) for a, n in zip(anchors, "rgb", strict=True)])


def normalize_range(axis_low: Column, axis_high: Column, low: Column, high: Column, bins: int = 256) -> Column:
    """(min, max) of a colour range on an axis: swapped if upside down, clamped, at least one bin wide, else the whole axis."""
    span = axis_high - axis_low
    lo, hi = F.least(low, high), F.greatest(low, high)
    bad = ~(span > 0) | low.isNull() | high.isNull() | F.isnan(low) | F.isnan(high) | (F.abs(low) == float("inf")) | (F.abs(high) == float("inf")) | (hi < axis_low) | (lo > axis_high)
    lo, hi = F.greatest(axis_low, lo), F.least(axis_high, hi)
    least = span / bins
    center = (lo + hi) / 2
    a, b = center - least / 2, center + least / 2
    under, over = a < axis_low, b > axis_high
    narrow_lo = F.when(under, axis_low).when(over, axis_high - least).otherwise(a)
    narrow_hi = F.when(under, axis_low + least).when(over, axis_high).otherwise(b)
    narrow = hi - lo < least
    return F.struct(F.when(bad, axis_low).when(narrow, narrow_lo).otherwise(lo).alias("min"), F.when(bad, axis_high).when(narrow, narrow_hi).otherwise(hi).alias("max"))


def colour_mode(mode: Column, has_label: Column, has_rgb: Column, has_normals: Column) -> Column:
    """The mode that a cloud can show: label falls back to rgb, rgb and normal to none."""
    rgb = F.when(has_rgb, "rgb").otherwise("none")
    return F.when((mode == "label") & ~has_label, rgb).when(mode == "rgb", rgb).when((mode == "normal") & ~has_normals, "none").otherwise(mode)


def normal_colour(nx: Column, ny: Column, nz: Column) -> Column:
    """Linear bytes of a unit normal; black where there is none."""
    none = (nx == 0) & (ny == 0) & (nz == 0)
    return F.struct(*[F.when(none, 0).otherwise(half_up(srgb_to_linear((c + 1) / 2) * 255)).alias(n) for c, n in zip((nx, ny, nz), "rgb", strict=True)])


def las_colour(raw: Column, most: Column) -> Column:
    """The byte of a LAS colour: shifted where the file uses sixteen bits."""
    return F.when(most >= 256, F.shiftright(raw, 8)).otherwise(raw)
