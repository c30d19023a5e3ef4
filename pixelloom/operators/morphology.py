"""Neighbourhood operators: morphology, blurs, trimaps, boundaries, gradients; each maps arrays of one row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.pixel import clamp
from .grid import SIDE, at, each, neighbour


def square(radius: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


def kernel(k: int) -> list[tuple[int, int]]:
    """k x k offsets; an even one reaches further to the left and up."""
    return [(dx, dy) for dy in range(-(k // 2), (k - 1) // 2 + 1) for dx in range(-(k // 2), (k - 1) // 2 + 1)]


def disk(radius: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dx, dy in square(radius) if dx * dx + dy * dy <= radius * radius]


CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]


def eroded(mask: Column, offsets: list[tuple[int, int]], border, width: int = SIDE, height: int = SIDE) -> Column:
    return each(lambda i, x, y: F.least(*[neighbour(mask, x, y, dx, dy, border, width, height) for dx, dy in offsets], F.lit(1)), width, height)


def dilated(mask: Column, offsets: list[tuple[int, int]], border, width: int = SIDE, height: int = SIDE) -> Column:
    return each(lambda i, x, y: F.greatest(*[neighbour(mask, x, y, dx, dy, border, width, height) for dx, dy in offsets], F.lit(0)), width, height)


def convolved(a: Column, taps: dict[tuple[int, int], float], border: str, width: int = SIDE, height: int = SIDE) -> Column:
    """Weighted sums of neighbours, in the order of the taps."""

    def value(i: Column, x: Column, y: Column) -> Column:
        out = F.lit(0.0)
        for (dx, dy), w in taps.items():
            out = out + neighbour(a, x, y, dx, dy, border, width, height) * w
        return out

    return each(value, width, height)


def gaussian_taps(sigma: float, radius: int | None = None) -> list[float]:
    radius = int(4 * sigma + 0.5) if radius is None else radius
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def gaussian_blur(a: Column, sigma: float, width: int = SIDE, height: int = SIDE) -> tuple[Column, list[float]]:
    """The horizontal pass and the taps for the vertical one: bind the first to a column before the second."""
    taps = gaussian_taps(sigma)
    r = len(taps) // 2
    return convolved(a, {(k - r, 0): w for k, w in enumerate(taps)}, "reflect", width, height), taps


def vertical(a: Column, taps: list[float], border: str = "reflect", width: int = SIDE, height: int = SIDE) -> Column:
    r = len(taps) // 2
    return convolved(a, {(0, k - r): w for k, w in enumerate(taps)}, border, width, height)


def box_blur(a: Column, k: int, border: str, width: int = SIDE, height: int = SIDE) -> Column:
    """Means over k x k pixels, anchored at k // 2; border clamp or reflect101."""
    offsets = [(dx, dy) for dy in range(-(k // 2), k - k // 2) for dx in range(-(k // 2), k - k // 2)]
    return convolved(a, {o: 1.0 / (k * k) for o in offsets}, border, width, height)


def boundary(mask: Column, width: int = SIDE, height: int = SIDE) -> Column:
    """1 where the mask is 1 and a 4-neighbour is 0 or outside."""
    return each(lambda i, x, y: ((at(mask, i) == 1) & (F.least(*[neighbour(mask, x, y, dx, dy, 0, width, height) for dx, dy in CROSS[1:]]) == 0)).cast("int"), width, height)


def gradient_magnitude(a: Column, width: int = SIDE, height: int = SIDE) -> Column:
    """Forward differences; 0 past the edge."""

    def value(i: Column, x: Column, y: Column) -> Column:
        dx = neighbour(a, x, y, 1, 0, "clamp", width, height) - at(a, i)
        dy = neighbour(a, x, y, 0, 1, "clamp", width, height) - at(a, i)
        return F.sqrt(dx * dx + dy * dy)

    return each(value, width, height)


def symmetric_trimap(front: Column, back: Column, i: Column) -> Column:
    """2 in eroded foreground, else 0 in eroded background, else 1."""
    return F.when(at(front, i) == 1, 2).when(at(back, i) == 1, 0).otherwise(1)


def fast_foreground_pass(image: Column, alpha: Column, f: Column, b: Column, k: int, eps: float = 1e-5) -> dict[str, Column]:
    """The blurred parts of one pass of blur fusion: blur(a f), blur(a), blur((1-a) b)."""
    zip2 = lambda p, q, g: F.zip_with(p, q, g)
    return {
        "af": box_blur(zip2(alpha, f, lambda x, y: x * y), k, "reflect101"),
        "al": box_blur(alpha, k, "reflect101"),
        "bb": box_blur(zip2(alpha, b, lambda x, y: (1 - x) * y), k, "reflect101"),
    }


def fused_foreground(i: Column, image: Column, alpha: Column, af: Column, al: Column, bb: Column, eps: float = 1e-5) -> tuple[Column, Column]:
    front = at(af, i) / (at(al, i) + eps)
    back = at(bb, i) / ((1 - at(al, i)) + eps)
    a = at(alpha, i)
    return clamp(front + a * (at(image, i) - a * front - (1 - a) * back)), back
