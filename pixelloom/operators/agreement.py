"""Metrics of images against references on batches of planes (n, height, width), in numpy.

A blur with clamped borders is a matrix with rows that sum to 1, so a batch is blurred by two matrix products.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ..functions.pixel import BACKGROUNDS, KNEE_DECODE

# Fixed values of the similarity: taps, deviation and the two constants.
REACH, SIGMA, C1, C2 = 5, 1.5, 1e-4, 9e-4
# Fixed values of the texture's hash, and the weights of the agreement.
HASH_X, HASH_Y, HASH_ADD, HASH_BY = 0x9E3779B9, 0x85EBCA6B, 15, 6364136223846793005
W_ERROR, W_BOUNDARY, W_OVERLAP, W_SIMILARITY = 0.35, 0.25, 0.15, 0.25


def decoded(v: np.ndarray) -> np.ndarray:
    """sRGB to linear light, not bounded."""
    return np.where(v <= KNEE_DECODE, v / 12.92, np.power((np.maximum(v, KNEE_DECODE) + 0.055) / 1.055, 2.4))


@lru_cache(maxsize=64)
def blur_matrix(n: int) -> np.ndarray:
    taps = np.arange(-REACH, REACH + 1)
    weights = np.exp(-(taps**2) / (2 * SIGMA**2))
    out = np.zeros((n, n))
    for place in range(n):
        np.add.at(out[place], np.clip(place + taps, 0, n - 1), weights / weights.sum())
    return out


def blurred(v: np.ndarray) -> np.ndarray:
    return blur_matrix(v.shape[-2]) @ v @ blur_matrix(v.shape[-1]).T


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean structural similarity over the last two axes; each pixel's is held to 0..1."""
    ma, mb = blurred(a), blurred(b)
    va, vb = np.maximum(blurred(a * a) - ma * ma, 0), np.maximum(blurred(b * b) - mb * mb, 0)
    cov = blurred(a * b) - ma * mb
    s = (2 * ma * mb + C1) * (2 * cov + C2) / ((ma * ma + mb * mb + C1) * (va + vb + C2))
    return np.clip(s, 0, 1).mean(axis=(-2, -1))


@lru_cache(maxsize=64)
def backgrounds(height: int, width: int) -> np.ndarray:
    """(7, 3, height, width) in linear light: six constants and the texture."""
    flat = np.array([*BACKGROUNDS.values()])[:, :, None, None] * np.ones((height, width))
    y, x = np.mgrid[:height, :width].astype(np.uint64)
    with np.errstate(over="ignore"):
        seed = (x * np.uint64(HASH_X) + y * np.uint64(HASH_Y) + np.uint64(HASH_ADD)) * np.uint64(HASH_BY)
    texture = (seed >> np.uint64(33)).astype(np.float64) / (2**32 - 1) * 0.35 + 0.325
    return decoded(np.concatenate([flat, np.broadcast_to(texture, (1, 3, height, width))]))


def composites(rgb: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """rgb (n, 3, h, w) and alpha (n, h, w) over each background: (n, 7, 3, h, w) in linear light."""
    a = alpha[:, None, None]
    return decoded(rgb)[:, None] * a + backgrounds(*alpha.shape[1:]) * (1 - a)


def boundary(alpha: np.ndarray) -> np.ndarray:
    """Covered pixels with a neighbour (of four) outside the image or not covered."""
    inside = alpha >= 0.5
    p = np.pad(inside, ((0, 0), (1, 1), (1, 1)))
    return inside & ~(p[:, :-2, 1:-1] & p[:, 2:, 1:-1] & p[:, 1:-1, :-2] & p[:, 1:-1, 2:])


def within(points: np.ndarray, reach: int) -> np.ndarray:
    """Pixels with a point at a Chebyshev distance of `reach` at most."""
    n, h, w = points.shape
    p = np.pad(points, ((0, 0), (reach, reach), (reach, reach)))
    rows = np.logical_or.reduce([p[:, k : k + h] for k in range(2 * reach + 1)])
    return np.logical_or.reduce([rows[:, :, k : k + w] for k in range(2 * reach + 1)])


def boundary_f1(a: np.ndarray, t: np.ndarray, reach: int) -> np.ndarray:
    """1 if neither has a boundary, 0 if one has none."""
    p, q = boundary(a), boundary(t)
    n, m = p.sum(axis=(1, 2)), q.sum(axis=(1, 2))
    precision = (p & within(q, reach)).sum(axis=(1, 2)) / np.maximum(n, 1)
    recall = (q & within(p, reach)).sum(axis=(1, 2)) / np.maximum(m, 1)
    return np.where((n == 0) & (m == 0), 1.0, 2 * precision * recall / np.maximum(precision + recall, 1e-300))


def half_up(v: float) -> int:
    """Rounded, halves away from zero."""
    return int(np.floor(v + 0.5))


def region(a: np.ndarray, t: np.ndarray) -> tuple[slice, slice]:
    """The padded box of what either plane (h, w) covers; all of it if nothing is covered."""
    h, w = a.shape
    ys, xs = np.nonzero((a >= 0.5) | (t >= 0.5))
    if not len(xs):
        return slice(0, h), slice(0, w)
    pad = max(1, half_up(0.05 * np.hypot(w, h)))
    return slice(max(0, ys.min() - pad), min(h, ys.max() + pad + 1)), slice(max(0, xs.min() - pad), min(w, xs.max() + pad + 1))


def agreement(rgb: np.ndarray, reference: np.ndarray, a: np.ndarray, t: np.ndarray) -> np.ndarray:
    """(n, 5): agreement, and the error, boundary F1, overlap and similarity that it weighs; all but F1 in the region."""
    n, h, w = a.shape
    f1 = boundary_f1(a, t, max(1, half_up(0.0015 * np.hypot(w, h))))
    out = np.zeros((n, 5))
    for i in range(n):
        y, x = region(a[i], t[i])
        p, q = a[i : i + 1, y, x], t[i : i + 1, y, x]
        high = np.maximum(p, q).sum()
        error, overlap = np.abs(p - q).mean(), np.minimum(p, q).sum() / high if high > 0 else 1.0
        alike = similarity(composites(rgb[i : i + 1, :, y, x], p), composites(reference[i : i + 1, :, y, x], q)).mean()
        total = W_ERROR * (1 - error) + W_BOUNDARY * f1[i] + W_OVERLAP * overlap + W_SIMILARITY * alike
        out[i] = np.clip(total, 0, 1), error, f1[i], overlap, alike
    return out
