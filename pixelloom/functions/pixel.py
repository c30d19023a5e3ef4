"""Per-pixel scalar functions on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luminance weights of linear and encoded RGB, and the knees of the sRGB curves.
LUMA = (0.2126, 0.7152, 0.0722)
KNEE_DECODE, KNEE_ENCODE = 0.04045, 0.0031308


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def quantize_u8(v: Column) -> Column:
    """0..255, halves away from zero; what isn't finite is 0."""
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, 0).otherwise(F.round(clamp(v) * 255)).cast("int")


def truncate_u8(v: Column) -> Column:
    return F.floor(clamp(v) * 255).cast("int")


def js_round(v: Column) -> Column:
    return F.floor(v + 0.5)


def python_round(v: Column) -> Column:
    """Halves to even."""
    return F.bround(v)


def hard_threshold(v: Column, threshold: int) -> Column:
    """1 where floor(255 v) is strictly over the threshold."""
    return (F.floor(v * 255) > threshold).cast("int")


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def srgb_to_linear(v: Column, bounded: bool = True) -> Column:
    v = clamp(v) if bounded else v
    return F.when(v <= KNEE_DECODE, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column, bounded: bool = True) -> Column:
    v = clamp(v) if bounded else v
    return F.when(v <= KNEE_ENCODE, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def composite(alpha: Column, front: Column, back: Column) -> Column:
    return alpha * front + (1 - alpha) * back


def composite_linear(alpha: Column, front: Column, back: Column) -> Column:
    """Composite in linear light, encoded again."""
    return linear_to_srgb(composite(alpha, srgb_to_linear(front), srgb_to_linear(back)))


def complementary_segmenter(r: Column, b: Column, x: Column, y: Column) -> Column:
    return clamp(0.35 + 1.6 * F.abs(r - b) + ((3 * x + 5 * y) % 11) * 0.012)


def mul_div_255(a: Column, b: Column) -> Column:
    """a * b / 255, rounded, in integers."""
    t = a * b + 128
    return F.shiftright(t + F.shiftright(t, 8), 8)


def unpremultiplied(v: Column, alpha: Column) -> Column:
    """255 v / alpha, at most 255; 0 where alpha is 0."""
    return F.when(alpha == 0, 0).otherwise(F.least(F.lit(255), F.floor((255 * v) / alpha).cast("int")))


def sinc(v: Column) -> Column:
    return F.when(F.abs(v) < 1.1920929e-7, 1.0).otherwise(F.sin(math.pi * v) / (math.pi * v))


def kernel_weight(name: str, d: Column) -> Column:
    """Weight at distance d of the kernels nearest, bilinear (tent), bicubic (a = -0.5) and lanczos3."""
    d = F.abs(d)
    if name == "bilinear":
        return F.when(d < 1, 1 - d).otherwise(0.0)
    if name == "bicubic":
        near = 1.5 * d * d * d - 2.5 * d * d + 1
        far = -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2
        return F.when(d < 1, near).when(d < 2, far).otherwise(0.0)
    if name == "lanczos3":
        return F.when(d < 3, sinc(d) * sinc(d / 3)).otherwise(0.0)
    raise ValueError(name)


RADIUS = {"bilinear": 1, "bicubic": 2, "lanczos3": 3}


def texture(x: Column, y: Column) -> Column:
    """The textured background: a 64-bit hash of the place as 0.325..0.675, before it is decoded to linear light."""
    wide = lambda v: v.cast("decimal(18,0)")
    seed = (wide(x.cast("bigint") * 0x9E3779B9 + y.cast("bigint") * 0x85EBCA6B + 15)) * F.lit("6364136223846793005").cast("decimal(19,0)")
    low = seed % F.lit("18446744073709551616").cast("decimal(20,0)")
    top = F.floor(low / F.lit("8589934592").cast("decimal(10,0)")).cast("double")
    return top / 4294967295.0 * 0.35 + 0.325


#: Constant backgrounds of composite metrics, encoded; the texture is the seventh.
BACKGROUNDS = {"black": (0.0, 0.0, 0.0), "white": (1.0, 1.0, 1.0), "grey": (0.5, 0.5, 0.5), "red": (1.0, 0.0, 0.0), "green": (0.0, 1.0, 0.0), "blue": (0.0, 0.0, 1.0)}
