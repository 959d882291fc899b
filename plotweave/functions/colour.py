"""Column expressions between 8-bit RGB and 8-bit CIE Lab (L times 2.55, a and b plus 128)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sRGB primaries under D65, their inverse, the white point, and the branch points of both curves.
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
FROM_XYZ = ((3.240479, -1.53715, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))
WHITE = (0.950456, 1.0, 1.088754)
_GAMMA, _DARK, _LOW, _LOW_F = 2.4, 0.04045, 0.008856, 0.206893


def _mixed(rows: tuple, parts: list[Column]) -> list[Column]:
    return [sum((w * p for w, p in zip(row[1:], parts[1:], strict=True)), row[0] * parts[0]) for row in rows]


def rgb_to_lab(r: Column, g: Column, b: Column) -> list[Column]:
    """L, a and b as doubles of an 8-bit image's scale, not rounded."""
    shares = [c.cast("double") / 255 for c in (r, g, b)]
    linear = [F.when(c <= _DARK, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(_GAMMA))) for c in shares]
    fx, fy, fz = (F.when(t > _LOW, F.cbrt(t)).otherwise(7.787 * t + 16 / 116) for t in (c / w for c, w in zip(_mixed(TO_XYZ, linear), WHITE, strict=True)))
    return [(116 * fy - 16) * 2.55, 500 * (fx - fy) + 128, 200 * (fy - fz) + 128]


def lab_to_rgb(light: Column, a: Column, b: Column) -> list[Column]:
    """Whole r, g and b from 0 to 255 of Lab values on an 8-bit image's scale."""
    fy = (light / 2.55 + 16) / 116
    parts = [fy + (a - 128) / 500, fy, fy - (b - 128) / 200]
    xyz = [F.when(f > _LOW_F, f * f * f).otherwise((f - 16 / 116) / 7.787) * w for f, w in zip(parts, WHITE, strict=True)]
    out = []
    for c in _mixed(FROM_XYZ, xyz):
        c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
        c = F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(c, F.lit(1 / _GAMMA)) - 0.055)
        out.append(F.round(c * 255).cast("int"))
    return out
