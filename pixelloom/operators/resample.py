"""Resampling by tables of taps: a plane goes through one matrix for each axis, batches of planes at once.

A table has a row for each target place and a column for each source place. Tables with whole numbers are fixed-point
weights of 22 bits; their passes go across first, then down, with values of 8 bits between them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Fractional bits of fixed-point weights.
BITS = 22


def _sinc(x: np.ndarray) -> np.ndarray:
    return np.sinc(x)


# Filters and how far they reach: (weight of a distance, reach).
FILTERS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], float]] = {
    "bilinear": (lambda d: np.maximum(1 - np.abs(d), 0), 1.0),
    "bicubic": (lambda d: np.where(np.abs(d) < 1, 1.5 * np.abs(d) ** 3 - 2.5 * d * d + 1, np.where(np.abs(d) < 2, -0.5 * np.abs(d) ** 3 + 2.5 * d * d - 4 * np.abs(d) + 2, 0.0)), 2.0),
    "lanczos": (lambda d: np.where((d >= -3) & (d < 3), _sinc(d) * _sinc(d / 3), 0.0), 3.0),
}


@lru_cache(256)
def area_taps(name: str, source: int, target: int) -> np.ndarray:
    """Weights of a filter that widens when a plane shrinks, each row with the sum 1; half-pixel centres."""
    weight, reach = FILTERS[name]
    scale = source / target
    wide = max(scale, 1.0)
    out = np.zeros((target, source))
    for i in range(target):
        centre = (i + 0.5) * scale
        low, high = max(0, int(centre - reach * wide + 0.5)), min(source, int(centre + reach * wide + 0.5))
        w = weight((np.arange(low, high) - centre + 0.5) / wide)
        out[i, low:high] = w / w.sum() if w.sum() else 0.0
    return out


@lru_cache(256)
def fixed_taps(name: str, source: int, target: int) -> np.ndarray:
    """area_taps in whole numbers of 2 ** -BITS, halves away from zero."""
    w = area_taps(name, source, target) * (1 << BITS)
    return np.trunc(w + np.where(w < 0, -0.5, 0.5)).astype(np.int64)


@lru_cache(256)
def lanczos4_taps(source: int, target: int) -> np.ndarray:
    """Eight taps, normalised; places beyond the border are those on it. No widening when a plane shrinks."""
    out = np.zeros((target, source))
    for i in range(target):
        centre = (i + 0.5) * source / target - 0.5
        at = int(np.floor(centre)) - 3 + np.arange(8)
        d = at - centre
        w = np.where(np.abs(d) < 4, _sinc(d) * _sinc(d / 4), 0.0)
        np.add.at(out[i], np.clip(at, 0, source - 1), w / w.sum())
    return out


@lru_cache(256)
def linear_taps(source: int, target: int, half_pixel: bool = True) -> np.ndarray:
    """Two taps at half-pixel centres (not before the first), or at k * source / target."""
    out = np.zeros((target, source))
    for i in range(target):
        at = max(0.0, (i + 0.5) * source / target - 0.5) if half_pixel else i * source / target
        low = int(np.floor(at))
        out[i, low] += 1 - (at - low)
        out[i, min(low + 1, source - 1)] += at - low
    return out


@lru_cache(256)
def nearest_places(source: int, target: int, half_pixel: bool) -> np.ndarray:
    k = np.arange(target)
    return np.clip(np.floor((k + 0.5) * source / target if half_pixel else k * source // target), 0, source - 1).astype(np.int64)


def resized(planes: np.ndarray, taps: Callable[[int, int], np.ndarray], height: int, width: int) -> np.ndarray:
    """Real-valued planes (.., h, w) across, then down."""
    return taps(planes.shape[-2], height) @ (planes @ taps(planes.shape[-1], width).T)


def resized_u8(planes: np.ndarray, name: str, height: int, width: int) -> np.ndarray:
    """8-bit planes by fixed-point taps: across, clipped to 8 bits, then down."""
    one = lambda v: np.clip((v + (1 << BITS >> 1)) >> BITS, 0, 255)
    across = one(planes.astype(np.int64) @ fixed_taps(name, planes.shape[-1], width).T)
    return one(fixed_taps(name, planes.shape[-2], height) @ across).astype(np.uint8)


def resized_corner_u8(planes: np.ndarray, height: int, width: int) -> np.ndarray:
    """8-bit planes linearly between corners, halves up."""
    linear = lambda s, t: linear_taps(s, t, False)
    return np.clip(np.floor(resized(planes.astype(np.float64), linear, height, width) + 0.5), 0, 255).astype(np.uint8)


def resized_nearest(planes: np.ndarray, height: int, width: int, half_pixel: bool) -> np.ndarray:
    return planes[..., nearest_places(planes.shape[-2], height, half_pixel)[:, None], nearest_places(planes.shape[-1], width, half_pixel)]


def bilinear_zero(planes: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Linear samples at places (y, x) of planes (.., h, w); what lies beyond the border is 0."""
    h, w = planes.shape[-2:]
    y0, x0 = np.floor(ys).astype(np.int64), np.floor(xs).astype(np.int64)
    out = np.zeros((*planes.shape[:-2], *ys.shape))
    for dy, wy in ((0, 1 - (ys - y0)), (1, ys - y0)):
        for dx, wx in ((0, 1 - (xs - x0)), (1, xs - x0)):
            y, x = y0 + dy, x0 + dx
            inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
            out += np.where(inside, planes[..., np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)], 0.0) * wy * wx
    return out
