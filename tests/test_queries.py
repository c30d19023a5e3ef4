"""Queries against DuckDB on the same tables, and kernels against plain definitions."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from pixelloom import queries as Q
from pixelloom.operators import agreement as A
from pixelloom.queries.experiments import bootstrap_interval, xorshift
from pixelloom.queries.kernels import distance_transform, labelled, topology

SF = "/root/testdata/sf0.001"
SOME = ("alpha_metrics", "erosion_even_anchor", "disk_opening", "gaussian_blur", "trimap_symmetric", "hash_collisions", "tag_aggregates", "resize_nearest", "crop_tiles", "gradient_error", "boundary_f1", "ssim_alpha", "composite_errors")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(records) -> list:
    return sorted([tuple("null" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in records])


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, con, name):
    df = Q.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({Q.oracle_sql()[name]})")
    kinds = [float if str(t) in ("DOUBLE", "HUGEINT") else None for t in want.types]
    got = [[float(v) if k and v is not None else v for v, k in zip(r, kinds, strict=True)] for r in df.select(*columns).collect()]
    expect = [[float(v) if k and v is not None else v for v, k in zip(r, kinds, strict=True)] for r in want.fetchall()]
    assert rows(got) == rows(expect)


def test_components_and_holes():
    ring = np.array([[1, 1, 1, 0], [1, 0, 1, 0], [1, 1, 1, 0], [0, 0, 0, 1]], dtype=float)
    assert topology(ring) == (2, 1)
    assert labelled(np.zeros((2, 2), dtype=bool))[1] == 0


def test_distance_transform_is_the_least_distance():
    draw = np.random.default_rng(3)
    for _ in range(20):
        mask = draw.random((5, 7)) < 0.2
        got = distance_transform(mask)
        for y in range(5):
            for x in range(7):
                want = min(((y - v) ** 2 + (x - u) ** 2 for v, u in zip(*np.nonzero(mask), strict=True)), default=math.inf)
                assert got[y, x] == want


def test_bootstrap_is_reproducible_and_bounds_the_mean():
    values = [0.1, 0.4, 0.2, 0.9]
    low, high = bootstrap_interval(values)
    assert (low, high) == bootstrap_interval(values) and low <= np.mean(values) <= high
    assert int(xorshift(np.uint64(1))) == ((1 ^ 1 << 13) ^ ((1 ^ 1 << 13) >> 7)) ^ (((1 ^ 1 << 13) ^ ((1 ^ 1 << 13) >> 7)) << 17)


def plain_similarity(a, b):
    h, w = a.shape
    total = 0.0
    for y in range(h):
        for x in range(w):
            taps = [(math.exp(-(i * i + j * j) / 4.5), min(max(y + i, 0), h - 1), min(max(x + j, 0), w - 1)) for i in range(-5, 6) for j in range(-5, 6)]
            z = sum(k for k, _, _ in taps)
            mean = lambda f: sum(k * f(v, u) for k, v, u in taps) / z  # noqa: B023, E731
            ma, mb = mean(lambda v, u: a[v, u]), mean(lambda v, u: b[v, u])
            va, vb = max(0, mean(lambda v, u: a[v, u] ** 2) - ma * ma), max(0, mean(lambda v, u: b[v, u] ** 2) - mb * mb)
            cov = mean(lambda v, u: a[v, u] * b[v, u]) - ma * mb
            total += min(1, max(0, (2 * ma * mb + 1e-4) * (2 * cov + 9e-4) / ((ma * ma + mb * mb + 1e-4) * (va + vb + 9e-4))))
    return total / (h * w)


def test_agreement_by_plain_loops():
    draw = np.random.default_rng(4)
    rgb, ref = draw.random((3, 3, 9, 7)), draw.random((3, 3, 9, 7))
    a, t = draw.random((3, 9, 7)), draw.random((3, 9, 7))
    a[0], t[0] = 0.1, 0.2  # nothing is covered: the region is the whole image
    a[1, :5], t[1, :5] = 0.0, 0.0
    got = A.agreement(rgb, ref, a, t)
    for k, (y0, x0) in enumerate(((0, 0), (4, 0), (0, 0))):
        p, q = a[k, y0:, x0:], t[k, y0:, x0:]
        if k:
            ys, xs = np.nonzero((a[k] >= 0.5) | (t[k] >= 0.5))
            assert (ys.min() - 1 <= y0) and xs.min() <= 1
        back = A.backgrounds(*p.shape)
        over = lambda c, m, g: A.decoded(c) * m + g * (1 - m)
        alike = np.mean([plain_similarity(over(rgb[k, c, y0:, x0:], p, back[g, c]), over(ref[k, c, y0:, x0:], q, back[g, c])) for g in range(7) for c in range(3)])
        assert got[k, 4] == pytest.approx(alike)
        assert got[k, 1] == pytest.approx(np.abs(p - q).mean())
        assert got[k, 3] == pytest.approx(np.minimum(p, q).sum() / np.maximum(p, q).sum())
        assert got[k, 0] == pytest.approx(0.35 * (1 - got[k, 1]) + 0.25 * got[k, 2] + 0.15 * got[k, 3] + 0.25 * got[k, 4])
    assert got[0, 2] == 1.0  # neither has a boundary
