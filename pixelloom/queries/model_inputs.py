"""Resized planes, and the tensors that models want of an image or give for one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import resample as R
from .base import query

S = G.SIDE
# Means and deviations of natural images.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def codes(planes: np.ndarray) -> np.ndarray:
    """0..255, halves up."""
    return np.floor(np.clip(planes, 0, 1) * 255 + 0.5).astype(np.uint8)


def _stack(p: pd.DataFrame, name: str) -> np.ndarray:
    return np.stack(p[name].to_numpy()).astype(np.float64).reshape(-1, S, S)


def _long(rows: DataFrame, f: Callable[[pd.DataFrame], dict[str, np.ndarray]], ddl: str) -> DataFrame:
    """image_id, idx and the columns of f, each (images, places)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                found = f(p)
                n = next(iter(found.values())).reshape(len(p), -1).shape[1]
                yield pd.DataFrame({"image_id": np.repeat(p["image_id"].to_numpy(), n), "idx": np.tile(np.arange(n, dtype=np.int32), len(p)), **{k: v.reshape(-1) for k, v in found.items()}})

    return rows.mapInPandas(run, f"image_id long, idx int, {ddl}")


def _planes(spark: SparkSession, sf: str) -> DataFrame:
    return G.planes(spark, sf).select("image_id", "a")


_WEIGHT = {
    "bilinear": ("greatest(0.0, 1 - abs(d))", 1),
    "bicubic": ("CASE WHEN abs(d) < 1 THEN 1.5 * pow(abs(d), 3) - 2.5 * d * d + 1 WHEN abs(d) < 2 THEN -0.5 * pow(abs(d), 3) + 2.5 * d * d - 4 * abs(d) + 2 ELSE 0.0 END", 2),
    "lanczos": ("CASE WHEN abs(d) >= 3 THEN 0.0 WHEN d = 0 THEN 1.0 ELSE sin(pi() * d) / (pi() * d) * sin(pi() * d / 3) / (pi() * d / 3) END", 3),
}


def _taps_sql(name: str, m: int, suffix: str = "") -> str:
    """Tables f{suffix}(k, s, w): fixed-point weights of source place s for target place k of m."""
    weight, reach = _WEIGHT[name]
    wide = max(1.0, S / m)
    return f""", c{suffix} AS (SELECT CAST(k AS INTEGER) AS k, (k + 0.5) * {S} / {m}.0 AS centre FROM range(0, {m}) AS v(k)),
d{suffix} AS (SELECT k, CAST(s AS INTEGER) AS s, (s - centre + 0.5) / {wide} AS d FROM c{suffix}, range(0, {S}) AS v(s) WHERE s >= trunc(centre - {reach * wide} + 0.5) AND s < trunc(centre + {reach * wide} + 0.5)),
w{suffix} AS (SELECT k, s, {weight} AS w FROM d{suffix}), z{suffix} AS (SELECT k, sum(w) AS z FROM w{suffix} GROUP BY k),
f{suffix} AS MATERIALIZED (SELECT k, s, CAST(trunc(w / z * 4194304 + CASE WHEN w / z < 0 THEN -0.5 ELSE 0.5 END) AS BIGINT) AS w FROM w{suffix} JOIN z{suffix} USING (k))"""


def _pass_sql(out: str, source: str, m: int, suffix: str = "", value: str = "c") -> str:
    """Tables {out}h and {out}: source(image_id, x, y, value) across and down."""
    eight = "greatest(0, least(255, (2097152 + sum({0} * w)) >> 22))"
    return f""", {out}h AS MATERIALIZED (SELECT image_id, k AS x, y, CAST({eight.format(value)} AS BIGINT) AS c FROM {source} JOIN f{suffix} ON s = x GROUP BY image_id, k, y),
{out} AS MATERIALIZED (SELECT image_id, x, k AS y, CAST({eight.format("c")} AS INTEGER) AS c FROM {out}h JOIN f{suffix} ON s = y GROUP BY image_id, x, k)"""


_CODES = ", u AS MATERIALIZED (SELECT image_id, idx, x, y, CAST(floor(a * 255 + 0.5) AS BIGINT) AS c FROM px)"


def _fixed(name: str, m: int):
    sql = _CODES + _taps_sql(name, m) + _pass_sql("o", "u", m) + f" SELECT image_id, CAST(y * {m} + x AS INTEGER) AS idx, c AS v FROM o"

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _long(_planes(spark, sf), lambda p: {"v": R.resized_u8(codes(_stack(p, "a")), name, m, m).astype(np.int32)}, "v int")

    run.__name__ = f"resize_{name}_fixed_{'up' if m > S else 'down'}"
    run.__doc__ = f"8-bit planes to {m} x {m} by the {name} filter in fixed point."
    return query(sql, planes=True)(run)


for _name in _WEIGHT:
    for _m in (11, 5):
        _fixed(_name, _m)


def _real_sql(m: int, taps: str) -> str:
    return taps + f" SELECT image_id, CAST(u.k + {m} * v.k AS INTEGER) AS idx, round(sum(a * u.w * v.w), 6) AS v FROM px JOIN f u ON u.s = x JOIN f v ON v.s = y GROUP BY image_id, u.k, v.k"


def _real(p: pd.DataFrame, taps, m: int) -> dict[str, np.ndarray]:
    return {"v": R.resized(_stack(p, "a"), taps, m, m)}


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("v", F.round("v", 6))


@query(
    _real_sql(
        11,
        """, c AS (SELECT CAST(k AS INTEGER) AS k, (k + 0.5) * 8 / 11.0 - 0.5 AS centre FROM range(0, 11) AS v(k)),
d AS (SELECT k, greatest(0, least(7, CAST(floor(centre) AS INTEGER) - 3 + CAST(j AS INTEGER))) AS s, floor(centre) - 3 + j - centre AS d FROM c, range(0, 8) AS v(j)),
w AS (SELECT k, s, CASE WHEN abs(d) >= 4 THEN 0.0 WHEN d = 0 THEN 1.0 ELSE sin(pi() * d) / (pi() * d) * sin(pi() * d / 4) / (pi() * d / 4) END AS w FROM d),
z AS (SELECT k, sum(w) AS z FROM w GROUP BY k), f AS MATERIALIZED (SELECT k, s, sum(w / z) AS w FROM w JOIN z USING (k) GROUP BY k, s)""",
    ),
    planes=True,
)
def resize_lanczos4(spark: SparkSession, sf: str) -> DataFrame:
    """Eight taps on each axis, the border repeated."""
    return _rounded(_long(_planes(spark, sf), lambda p: _real(p, R.lanczos4_taps, 11), "v double"))


@query(
    _real_sql(
        13,
        """, c AS (SELECT CAST(k AS INTEGER) AS k, greatest(0.0, (k + 0.5) * 8 / 13.0 - 0.5) AS pos FROM range(0, 13) AS v(k)),
f AS MATERIALIZED (SELECT k, s, sum(w) AS w FROM (SELECT k, CAST(floor(pos) AS INTEGER) AS s, 1 - (pos - floor(pos)) AS w FROM c UNION ALL SELECT k, least(7, CAST(floor(pos) AS INTEGER) + 1), pos - floor(pos) FROM c) GROUP BY k, s)""",
    ),
    planes=True,
)
def resize_linear(spark: SparkSession, sf: str) -> DataFrame:
    """Two taps at half-pixel centres, not before the first."""
    return _rounded(_long(_planes(spark, sf), lambda p: _real(p, R.linear_taps, 13), "v double"))


@query(
    _real_sql(
        5,
        """, c AS (SELECT CAST(k AS INTEGER) AS k, (k + 0.5) * 8 / 5.0 AS centre FROM range(0, 5) AS v(k)),
w AS (SELECT k, CAST(s AS INTEGER) AS s, greatest(0.0, 1 - abs((s - centre + 0.5) / 1.6)) AS w FROM c, range(0, 8) AS v(s) WHERE s >= trunc(centre - 1.6 + 0.5) AND s < trunc(centre + 1.6 + 0.5)),
z AS (SELECT k, sum(w) AS z FROM w GROUP BY k), f AS MATERIALIZED (SELECT k, s, w / z AS w FROM w JOIN z USING (k))""",
    ),
    planes=True,
)
def resize_area_linear(spark: SparkSession, sf: str) -> DataFrame:
    """A tent that widens when the plane shrinks, in floating point."""
    return _rounded(_long(_planes(spark, sf), lambda p: _real(p, lambda s, t: R.area_taps("bilinear", s, t), 5), "v double"))


_CORNER = """, k AS (SELECT CAST(k AS INTEGER) AS k, k * 8.0 / {m} AS pos FROM range(0, {m}) AS v(k)),
t AS MATERIALIZED (SELECT k, s, sum(w) AS w FROM (SELECT k, CAST(floor(pos) AS INTEGER) AS s, 1 - (pos - floor(pos)) AS w FROM k UNION ALL SELECT k, least(7, CAST(floor(pos) AS INTEGER) + 1), pos - floor(pos) FROM k) GROUP BY k, s)"""


@query(_CODES + _CORNER.format(m=11) + " SELECT image_id, CAST(u.k + 11 * v.k AS INTEGER) AS idx, CAST(floor(round(sum(c * u.w * v.w), 9) + 0.5) AS INTEGER) AS v FROM u p JOIN t u ON u.s = x JOIN t v ON v.s = y GROUP BY image_id, u.k, v.k", planes=True)
def resize_corner_codes(spark: SparkSession, sf: str) -> DataFrame:
    """8-bit planes linearly between corners, rounded up at halves."""
    return _long(_planes(spark, sf), lambda p: {"v": R.resized_corner_u8(codes(_stack(p, "a")), 11, 11).astype(np.int32)}, "v int")


@query(
    """, k AS (SELECT CAST(k AS INTEGER) AS k, CAST(floor((k + 0.5) * 8 / 5.0) AS INTEGER) AS s FROM range(0, 5) AS v(k))
SELECT image_id, CAST(u.k + 5 * v.k AS INTEGER) AS idx, CASE WHEN a > 0.7 THEN 2 WHEN a < 0.3 THEN 0 ELSE 1 END AS v FROM px JOIN k u ON u.s = x JOIN k v ON v.s = y""",
    planes=True,
)
def resize_trimap_classes(spark: SparkSession, sf: str) -> DataFrame:
    """A trimap keeps its classes: the nearest place at half-pixel centres."""
    classes = lambda a: np.where(a > 0.7, 2, np.where(a < 0.3, 0, 1)).astype(np.int32)
    return _long(_planes(spark, sf), lambda p: {"v": R.resized_nearest(classes(_stack(p, "a")), 5, 5, True)}, "v int")


@query(
    """, p AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, j * 0.9 - 0.6 AS x, i * 0.8 - 0.4 AS y FROM range(0, 10) AS u(i), range(0, 10) AS v(j)),
t AS (SELECT i, j, CAST(floor(x) AS INTEGER) + dx AS sx, CAST(floor(y) AS INTEGER) + dy AS sy, CASE dx WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END * CASE dy WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END AS w FROM p, (VALUES (0), (1)) AS a(dx), (VALUES (0), (1)) AS b(dy)),
m AS (SELECT i, j, CASE WHEN sx BETWEEN 0 AND 7 AND sy BETWEEN 0 AND 7 THEN w ELSE 0 END AS w, greatest(0, least(7, sx)) AS sx, greatest(0, least(7, sy)) AS sy FROM t)
SELECT image_id, CAST(i * 10 + j AS INTEGER) AS idx, round(sum(a * w), 6) AS v FROM px JOIN m ON sx = x AND sy = y GROUP BY image_id, i, j""",
    planes=True,
)
def sample_affine_zero(spark: SparkSession, sf: str) -> DataFrame:
    """Linear samples on a scaled and shifted grid; 0 beyond the border."""
    i, j = np.mgrid[:10, :10]
    return _rounded(_long(_planes(spark, sf), lambda p: {"v": R.bilinear_zero(_stack(p, "a"), i * 0.8 - 0.4, j * 0.9 - 0.6)}, "v double"))


# ---- inputs of models: (adapter, divisor of the codes, whether natural-image statistics, subtracted)

T = 12
ADAPTERS = ("u2net", "birefnet", "dis", "corner128")


def tensor(adapter: str, rgb: np.ndarray, size: int = T) -> np.ndarray:
    """(images, 3, size, size) for images of 8-bit channels (images, 3, h, w): resized, scaled by the largest code."""
    if adapter == "corner128":
        return (R.resized_corner_u8(rgb, size, size).astype(np.float64) - 128) / 256
    small = R.resized_u8(rgb, "lanczos", size, size).astype(np.float64)
    high = small.max(axis=(1, 2, 3), keepdims=True)
    if adapter == "dis":
        return small / np.maximum(high, 1) - 0.5
    v = small / np.maximum(high, 1e-6 if adapter == "u2net" else 1.0)
    by = lambda c: np.array(c)[None, :, None, None]
    return (v - by(MEAN)) / by(DEVIATION)


def mask_of(restored: str, raw: np.ndarray, size: int) -> np.ndarray:
    """8-bit masks of raw outputs (images, h, w) at another size: to 0..1 if asked, cut to codes, resized."""
    if restored == "minmax_lanczos":
        low, high = raw.min(axis=(1, 2), keepdims=True), raw.max(axis=(1, 2), keepdims=True)
        raw = np.where(high > low, (raw - low) / np.where(high > low, high - low, 1), 0)
    cut = np.floor(np.clip(raw, 0, 1) * 255).astype(np.uint8)
    if restored == "corner":
        return R.resized_corner_u8(cut, size, size)
    return R.resized_u8(cut, "bilinear" if restored == "bilinear" else "lanczos", size, size)


_CHANNELS = """, u AS MATERIALIZED (SELECT image_id * 3 + ch AS image_id, x, y, CAST(floor(CASE ch WHEN 0 THEN a WHEN 1 THEN g ELSE b END * 255 + 0.5) AS BIGINT) AS c FROM rgb, (VALUES (0), (1), (2)) AS k(ch))"""


@query(
    _CHANNELS
    + _taps_sql("lanczos", T)
    + _pass_sql("o", "u", T)
    + _CORNER.format(m=T)
    + f""", q AS (SELECT image_id, u.k AS x, v.k AS y, floor(round(sum(c * u.w * v.w), 9) + 0.5) AS c FROM u p JOIN t u ON u.s = x JOIN t v ON v.s = y GROUP BY image_id, u.k, v.k),
hi AS (SELECT image_id // 3 AS img, max(c) AS hi FROM o GROUP BY 1),
all_ AS (SELECT image_id // 3 AS image_id, CAST((image_id % 3) * {T * T} + y * {T} + x AS INTEGER) AS idx, CAST(image_id % 3 AS INTEGER) AS ch, c, hi FROM o JOIN hi ON img = image_id // 3),
s AS (SELECT *, [0.485, 0.456, 0.406][ch + 1] AS m, [0.229, 0.224, 0.225][ch + 1] AS d FROM all_)
SELECT s.image_id, s.idx, round((s.c / greatest(hi, 1e-6) - m) / d, 5) AS u2net, round((s.c / greatest(hi, 1.0) - m) / d, 5) AS birefnet, round(s.c / greatest(hi, 1.0) - 0.5, 5) AS dis, round((q.c - 128) / 256, 5) AS corner128
FROM s JOIN q ON q.image_id = s.image_id * 3 + s.ch AND s.idx = s.ch * {T * T} + q.y * {T} + q.x""",
    planes=True,
)
def model_tensors(spark: SparkSession, sf: str) -> DataFrame:
    """Channel-major inputs of four kinds of models."""

    def made(p: pd.DataFrame) -> dict[str, np.ndarray]:
        rgb = codes(np.stack([_stack(p, c) for c in "rgb"], 1))
        return {k: tensor(k, rgb) for k in ADAPTERS}

    found = _long(G.images(spark, sf).select("image_id", "r", "g", "b"), made, ", ".join(f"{k} double" for k in ADAPTERS))
    return found.select("image_id", "idx", *[F.round(k, 5).alias(k) for k in ADAPTERS])


_CUT = ", r AS (SELECT image_id, x, y, 1.2 * a - 0.1 AS v FROM px), e AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM r GROUP BY 1), u AS MATERIALIZED (SELECT image_id, x, y, CAST(floor(greatest(0.0, least(1.0, v)) * 255) AS BIGINT) AS c, CAST(floor(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END * 255) AS BIGINT) AS n FROM r JOIN e USING (image_id))"


@query(
    _CUT
    + _taps_sql("lanczos", 11)
    + _taps_sql("bilinear", 11, "2")
    + _pass_sql("o", "u", 11)
    + _pass_sql("n", "u", 11, value="n").replace("nh AS", "mh AS").replace("n AS MAT", "mm AS MAT").replace("FROM nh", "FROM mh")
    + _pass_sql("b", "u", 11, "2")
    + _CORNER.format(m=11)
    + """, q AS (SELECT image_id, u.k AS x, v.k AS y, CAST(floor(round(sum(c * u.w * v.w), 9) + 0.5) AS INTEGER) AS c FROM u p JOIN t u ON u.s = x JOIN t v ON v.s = y GROUP BY image_id, u.k, v.k)
SELECT o.image_id, CAST(o.y * 11 + o.x AS INTEGER) AS idx, o.c AS lanczos, mm.c AS minmax_lanczos, b.c AS bilinear, q.c AS corner FROM o JOIN mm USING (image_id, x, y) JOIN b USING (image_id, x, y) JOIN q USING (image_id, x, y)""",
    planes=True,
)
def restored_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Raw outputs (here beyond 0..1 on both ends) as 8-bit masks at the image's size, in four ways."""
    kinds = ("lanczos", "minmax_lanczos", "bilinear", "corner")
    return _long(_planes(spark, sf), lambda p: {k: mask_of(k, 1.2 * _stack(p, "a") - 0.1, 11).astype(np.int32) for k in kinds}, ", ".join(f"{k} int" for k in kinds))
