"""Similarity, boundaries and composites of an image against its reference, and the agreement score.

The images' colours are r, g, b, those of the reference g, b, r; the alphas are a and t. Each image is one row, so no
metric shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixel as P
from ..operators import agreement as A
from ..operators import grid as G
from .base import query

S = G.SIDE


def _stacked(p: pd.DataFrame, *names: str) -> list[np.ndarray]:
    return [np.stack(p[k].to_numpy()).reshape(-1, S, S) for k in names]


def _batches(rows: DataFrame, f: Callable[[pd.DataFrame], dict], columns: tuple[str, ...]) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                yield pd.DataFrame({"image_id": p["image_id"], **f(p)})

    found = rows.mapInPandas(run, ", ".join(["image_id long", *[f"{c} double" for c in columns]]))
    return found.select("image_id", *[F.round(c, 6).alias(c) for c in columns])


@query(
    """, g AS (SELECT p.image_id, abs(sqrt(pow(r.a - p.a, 2) + pow(d.a - p.a, 2)) - sqrt(pow(r.t - p.t, 2) + pow(d.t - p.t, 2))) AS e FROM rgb p
 JOIN rgb r ON r.image_id = p.image_id AND r.y = p.y AND r.x = least(7, p.x + 1) JOIN rgb d ON d.image_id = p.image_id AND d.x = p.x AND d.y = least(7, p.y + 1))
SELECT image_id, round(avg(e), 6) AS error FROM g GROUP BY image_id""",
    planes=True,
)
def gradient_error(spark: SparkSession, sf: str) -> DataFrame:
    """Mean difference of the sizes of forward gradients."""

    def size(v: str):
        a = F.col(v)
        step = lambda x, y, dx, dy, i: G.neighbour(a, x, y, dx, dy, "clamp") - G.at(a, i)
        return lambda i, x, y: F.sqrt(F.pow(step(x, y, 1, 0, i), F.lit(2.0)) + F.pow(step(x, y, 0, 1, i), F.lit(2.0)))

    a, t = size("a"), size("t")
    return G.pairs(spark, sf).select("image_id", F.round(G.mean(G.each(lambda i, x, y: F.abs(a(i, x, y) - t(i, x, y)))), 6).alias("error"))


_EDGE = "x IN (0, 7) OR y IN (0, 7) OR EXISTS (SELECT 1 FROM rgb q WHERE q.image_id = p.image_id AND abs(q.x - p.x) + abs(q.y - p.y) = 1 AND q.{0} < 0.5)"


@query(
    f""", pa AS (SELECT image_id, x, y FROM rgb p WHERE a >= 0.5 AND ({_EDGE.format("a")})), pt AS (SELECT image_id, x, y FROM rgb p WHERE t >= 0.5 AND ({_EDGE.format("t")})),
k AS (SELECT unnest([1, 2, 4]) AS reach), i AS (SELECT DISTINCT image_id FROM rgb),
ca AS (SELECT image_id, reach, count(*) AS n, sum(CASE WHEN EXISTS (SELECT 1 FROM pt WHERE pt.image_id = pa.image_id AND greatest(abs(pt.x - pa.x), abs(pt.y - pa.y)) <= reach) THEN 1 ELSE 0 END) AS hit FROM pa, k GROUP BY ALL),
ct AS (SELECT image_id, reach, count(*) AS n, sum(CASE WHEN EXISTS (SELECT 1 FROM pa WHERE pt.image_id = pa.image_id AND greatest(abs(pt.x - pa.x), abs(pt.y - pa.y)) <= reach) THEN 1 ELSE 0 END) AS hit FROM pt, k GROUP BY ALL),
f AS (SELECT i.image_id, k.reach, ca.n AS n, ct.n AS m, CAST(ca.hit AS DOUBLE) / ca.n AS p, CAST(ct.hit AS DOUBLE) / ct.n AS r FROM i CROSS JOIN k LEFT JOIN ca ON ca.image_id = i.image_id AND ca.reach = k.reach LEFT JOIN ct ON ct.image_id = i.image_id AND ct.reach = k.reach),
s AS (SELECT image_id, reach, CASE WHEN n IS NULL AND m IS NULL THEN 1.0 WHEN n IS NULL OR m IS NULL OR p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM f)
SELECT image_id, round(CAST(max(f1) FILTER (reach = 1) AS DOUBLE), 6) AS f1_1, round(CAST(max(f1) FILTER (reach = 2) AS DOUBLE), 6) AS f1_2, round(CAST(max(f1) FILTER (reach = 4) AS DOUBLE), 6) AS f1_4 FROM s GROUP BY image_id""",
    planes=True,
)
def boundary_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Boundaries that match within 1, 2 and 4 pixels."""

    def score(p: pd.DataFrame) -> dict:
        a, t = _stacked(p, "a", "t")
        return {f"f1_{k}": A.boundary_f1(a, t, k) for k in (1, 2, 4)}

    return _batches(G.pairs(spark, sf).select("image_id", "a", "t"), score, ("f1_1", "f1_2", "f1_4"))


@query(
    """, i AS MATERIALIZED (SELECT image_id, x, y, a, t FROM rgb), k AS MATERIALIZED (SELECT d, exp(-d * d / 4.5) AS w FROM (SELECT unnest(range(-5, 6)) AS d)), z AS MATERIALIZED (SELECT sum(w) AS z FROM k),
b AS MATERIALIZED (SELECT x, xx, sum(w) / max(z) AS w FROM (SELECT x, greatest(0, least(7, x + d)) AS xx, w, z FROM (SELECT unnest(range(0, 8)) AS x), k, z) GROUP BY ALL),
h AS MATERIALIZED (SELECT image_id, b.x, y, sum(w * a) AS ma, sum(w * t) AS mt, sum(w * a * a) AS aa, sum(w * t * t) AS tt, sum(w * a * t) AS at_ FROM i JOIN b ON b.xx = i.x GROUP BY ALL),
m AS MATERIALIZED (SELECT image_id, h.x, b.x AS y, sum(w * ma) AS ma, sum(w * mt) AS mt, sum(w * aa) AS aa, sum(w * tt) AS tt, sum(w * at_) AS at_ FROM h JOIN b ON b.xx = h.y GROUP BY ALL),
s AS (SELECT image_id, (2 * ma * mt + 1e-4) * (2 * (at_ - ma * mt) + 9e-4) / ((ma * ma + mt * mt + 1e-4) * (greatest(0.0, aa - ma * ma) + greatest(0.0, tt - mt * mt) + 9e-4)) AS s FROM m)
SELECT image_id, round(avg(greatest(0.0, least(1.0, s))), 6) AS ssim FROM s GROUP BY image_id""",
    planes=True,
)
def ssim_alpha(spark: SparkSession, sf: str) -> DataFrame:
    """Gaussian structural similarity of the alphas."""
    return _batches(G.pairs(spark, sf).select("image_id", "a", "t"), lambda p: {"ssim": A.similarity(*_stacked(p, "a", "t"))}, ("ssim",))


_BACKS = ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(P.BACKGROUNDS.values()))
_DECODE = "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END"
_TEXTURE = "CAST((((x::HUGEINT * 2654435769 + y::HUGEINT * 2246822507 + 15) * 6364136223846793005) % 18446744073709551616) // 8589934592 AS DOUBLE) / 4294967295 * 0.35 + 0.325"


@query(
    f""", back AS MATERIALIZED (SELECT x, y, bg, c, {_DECODE.format("v")} AS v FROM (
 SELECT x, y, bg, c, CAST(CASE c WHEN 0 THEN br WHEN 1 THEN bgr ELSE bb END AS DOUBLE) AS v FROM (VALUES {_BACKS}) AS k(bg, br, bgr, bb), (SELECT unnest(range(0, 8)) AS x), (SELECT unnest(range(0, 8)) AS y), (SELECT unnest([0, 1, 2]) AS c)
 UNION ALL SELECT x, y, 6, c, {_TEXTURE} FROM (SELECT unnest(range(0, 8)) AS x), (SELECT unnest(range(0, 8)) AS y), (SELECT unnest([0, 1, 2]) AS c))),
ch AS MATERIALIZED (SELECT image_id, x, y, a, t, c, CASE c WHEN 0 THEN a WHEN 1 THEN g ELSE b END AS p, CASE c WHEN 0 THEN g WHEN 1 THEN b ELSE a END AS q FROM rgb, (SELECT unnest([0, 1, 2]) AS c)),
d AS (SELECT image_id, ({_DECODE.format("p")}) * a + v * (1 - a) - ({_DECODE.format("q")}) * t - v * (1 - t) AS d FROM ch JOIN back USING (x, y, c))
SELECT image_id, round(avg(abs(d)), 6) AS mae, round(CASE WHEN avg(d * d) = 0 THEN 100.0 ELSE 10 * log10(1 / avg(d * d)) END, 6) AS psnr FROM d GROUP BY image_id""",
    planes=True,
)
def composite_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of composites over seven backgrounds in linear light; a perfect one has the PSNR 100."""

    def score(p: pd.DataFrame) -> dict:
        r, g, b = _stacked(p, "r", "g", "b")
        d = A.composites(np.stack([r, g, b], 1), r) - A.composites(np.stack([g, b, r], 1), g)
        mse = np.square(d).mean(axis=(1, 2, 3, 4))
        return {"mae": np.abs(d).mean(axis=(1, 2, 3, 4)), "psnr": np.where(mse == 0, 100.0, -10 * np.log10(np.where(mse == 0, 1.0, mse)))}

    return _batches(G.images(spark, sf).select("image_id", "r", "g", "b"), score, ("mae", "psnr"))


@query()
def agreement_score(spark: SparkSession, sf: str) -> DataFrame:
    """The agreement and its four parts."""
    columns = ("agreement", "roi_mae", "boundary", "roi_iou", "roi_ssim")

    def score(p: pd.DataFrame) -> dict:
        r, g, b = _stacked(p, "r", "g", "b")
        return dict(zip(columns, A.agreement(np.stack([r, g, b], 1), np.stack([g, b, r], 1), r, g).T, strict=True))

    return _batches(G.images(spark, sf).select("image_id", "r", "g", "b"), score, columns)
