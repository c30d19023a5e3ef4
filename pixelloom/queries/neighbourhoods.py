"""Neighbourhoods of pixels: morphology, blurs, trimaps, features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixel import clamp, luminance
from ..operators import grid as G
from ..operators import morphology as M
from .base import query
from .kernels import labelled

_BITS = ", m AS (SELECT image_id, idx, x, y, CASE WHEN floor(a * 255) > 127 THEN 1 ELSE 0 END AS v FROM px)"
#: All pairs of a pixel and an offset, with what is there (NULL outside).
_OFF = """, o AS (SELECT CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy FROM range({lo}, {hi} + 1) AS u(dx), range({lo}, {hi} + 1) AS w(dy) WHERE {where}),
k AS (SELECT p.image_id, p.idx, p.x, p.y, o.dx, o.dy, q.v FROM m p CROSS JOIN o LEFT JOIN m q ON q.image_id = p.image_id AND q.x = p.x + o.dx AND q.y = p.y + o.dy)"""


def _mask(spark: SparkSession, sf: str) -> DataFrame:
    return G.planes(spark, sf).withColumn("m", F.transform("a", lambda v: (F.floor(v * 255) > 127).cast("int")))


@query(_BITS + _OFF.format(lo=-1, hi=1, where="true") + " SELECT image_id, idx, min(coalesce(v, 0)) AS v FROM k GROUP BY ALL", planes=True)
def erosion_square(spark: SparkSession, sf: str) -> DataFrame:
    return G.by_pixel(_mask(spark, sf), v=M.eroded(F.col("m"), M.square(1), 0))


@query(_BITS + _OFF.format(lo=-2, hi=1, where="true") + " SELECT image_id, idx, min(coalesce(v, 1)) AS v FROM k GROUP BY ALL", planes=True)
def erosion_even_anchor(spark: SparkSession, sf: str) -> DataFrame:
    """4 x 4, with ones beyond the border."""
    return G.by_pixel(_mask(spark, sf), v=M.eroded(F.col("m"), M.kernel(4), 1))


@query(_BITS + _OFF.format(lo=-1, hi=1, where="abs(dx) + abs(dy) <= 1") + " SELECT image_id, idx, min(coalesce(v, 0)) AS v FROM k GROUP BY ALL", planes=True)
def erosion_cross(spark: SparkSession, sf: str) -> DataFrame:
    return G.by_pixel(_mask(spark, sf), v=M.eroded(F.col("m"), M.CROSS, 0))


@query(_BITS + _OFF.format(lo=-1, hi=1, where="true") + " SELECT image_id, idx, max(coalesce(v, 0)) AS v FROM k GROUP BY ALL", planes=True)
def dilation_square(spark: SparkSession, sf: str) -> DataFrame:
    return G.by_pixel(_mask(spark, sf), v=M.dilated(F.col("m"), M.square(1), 0))


_REFLECT = "CASE WHEN {c} + {d} < 0 THEN -1 - ({c} + {d}) WHEN {c} + {d} > 7 THEN 15 - ({c} + {d}) ELSE {c} + {d} END"


@query(
    _BITS
    + f""", o AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS v(dx, dy)),
e AS (SELECT p.image_id, p.idx, p.x, p.y, min(q.v) AS v FROM m p CROSS JOIN o JOIN m q ON q.image_id = p.image_id AND q.x = {_REFLECT.format(c="p.x", d="dx")} AND q.y = {_REFLECT.format(c="p.y", d="dy")} GROUP BY ALL)
SELECT p.image_id, p.idx, max(q.v) AS v FROM e p CROSS JOIN o JOIN e q ON q.image_id = p.image_id AND q.x = {_REFLECT.format(c="p.x", d="dx")} AND q.y = {_REFLECT.format(c="p.y", d="dy")} GROUP BY ALL""",
    planes=True,
)
def disk_opening(spark: SparkSession, sf: str) -> DataFrame:
    """Erosion, then dilation, by a disk of radius 1 with mirrored borders."""
    e = G.bound(_mask(spark, sf), e=M.eroded(F.col("m"), M.disk(1), "reflect"))
    return G.by_pixel(e, v=M.dilated(F.col("e"), M.disk(1), "reflect"))


_W = "CASE abs({d}) " + " ".join(f"WHEN {k} THEN {w!r}" for k, w in enumerate(M.gaussian_taps(0.8)[3:])) + " END"


@query(
    f""", o AS (SELECT CAST(d AS INTEGER) AS d FROM range(-3, 4) AS v(d)),
h AS (SELECT p.image_id, p.idx, p.x, p.y, sum(q.a * {_W.format(d="d")}) AS v FROM px p CROSS JOIN o JOIN px q ON q.image_id = p.image_id AND q.y = p.y AND q.x = {_REFLECT.format(c="p.x", d="d")} GROUP BY ALL)
SELECT p.image_id, p.idx, round(sum(q.v * {_W.format(d="d")}), 6) AS v FROM h p CROSS JOIN o JOIN h q ON q.image_id = p.image_id AND q.x = p.x AND q.y = {_REFLECT.format(c="p.y", d="d")} GROUP BY p.image_id, p.idx""",
    planes=True,
)
def gaussian_blur(spark: SparkSession, sf: str) -> DataFrame:
    """Deviation 0.8, radius floor(4 * 0.8 + 0.5) = 3, mirrored borders."""
    across, taps = M.gaussian_blur(F.col("a"), 0.8)
    return G.by_pixel(G.bound(G.planes(spark, sf), h=across), v=M.vertical(F.col("h"), taps)).withColumn("v", F.round("v", 6))


def _box(fold: str) -> str:
    return f""", o AS (SELECT CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy FROM range(-1, 2) AS u(dx), range(-1, 2) AS w(dy))
SELECT p.image_id, p.idx, round(sum(q.a) / 9, 6) AS v FROM px p CROSS JOIN o JOIN px q ON q.image_id = p.image_id AND q.x = {fold.format(c="p.x", d="dx")} AND q.y = {fold.format(c="p.y", d="dy")} GROUP BY p.image_id, p.idx"""


@query(_box("greatest(0, least(7, {c} + {d}))"), planes=True)
def box_blur_clamp(spark: SparkSession, sf: str) -> DataFrame:
    return G.by_pixel(G.planes(spark, sf), v=M.box_blur(F.col("a"), 3, "clamp")).withColumn("v", F.round("v", 6))


@query(_box("CASE WHEN {c} + {d} < 0 THEN -({c} + {d}) WHEN {c} + {d} > 7 THEN 14 - ({c} + {d}) ELSE {c} + {d} END"), planes=True)
def box_blur_reflect101(spark: SparkSession, sf: str) -> DataFrame:
    return G.by_pixel(G.planes(spark, sf), v=M.box_blur(F.col("a"), 3, "reflect101")).withColumn("v", F.round("v", 6))


@query(", z AS (SELECT 1) SELECT image_id, idx, CASE WHEN a >= 0.9 THEN 2 WHEN a <= 0.1 THEN 0 ELSE 1 END AS v FROM px", planes=True)
def trimap_bands(spark: SparkSession, sf: str) -> DataFrame:
    return G.by_pixel(G.planes(spark, sf), v=F.transform("a", lambda v: F.when(v >= 0.9, 2).when(v <= 0.1, 0).otherwise(1)))


@query(
    """, u AS (SELECT image_id, idx, x, y, CAST(floor(a * 255) AS INTEGER) AS c FROM px),
w AS (SELECT p.image_id, p.idx, min(CASE WHEN q.c > 150 THEN 1 ELSE 0 END) AS f, min(CASE WHEN q.c < 100 THEN 1 ELSE 0 END) AS b, count(q.c) AS k
 FROM u p LEFT JOIN u q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY ALL)
SELECT image_id, idx, CASE WHEN f = 1 AND k = 9 THEN 2 WHEN b = 1 THEN 0 ELSE 1 END AS v FROM w""",
    planes=True,
)
def trimap_symmetric(spark: SparkSession, sf: str) -> DataFrame:
    """Foreground eroded with zeros beyond the border, background with ones; foreground wins."""
    u = G.planes(spark, sf).withColumn("c", F.transform("a", lambda v: F.floor(v * 255).cast("int")))
    u = G.bound(u, f=F.transform("c", lambda c: (c > 150).cast("int")), b=F.transform("c", lambda c: (c < 100).cast("int")))
    u = G.bound(u, f=M.eroded(F.col("f"), M.kernel(3), 0), b=M.eroded(F.col("b"), M.kernel(3), 1))
    return G.by_pixel(u, v=G.each(lambda i, x, y: M.symmetric_trimap(F.col("f"), F.col("b"), i)))


@query(
    """, u AS MATERIALIZED (SELECT image_id, idx, x, y, CAST(floor(a * 255 + 0.5) AS INTEGER) AS c FROM px),
w AS (SELECT p.image_id, p.idx, p.c, max(CASE WHEN q.c > 200 THEN 1 ELSE 0 END) AS near, min(CASE WHEN q.c > 200 THEN 1 ELSE 0 END) AS core
 FROM u p JOIN u q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY ALL)
SELECT image_id, idx, CASE WHEN c > 200 AND core = 1 THEN 255 WHEN c > 0 OR near = 1 THEN 127 ELSE 0 END AS v FROM w""",
    planes=True,
)
def trimap_probability(spark: SparkSession, sf: str) -> DataFrame:
    """Above 200 is foreground (255), as far as an erosion with ones beyond the border leaves it; unknown (127) are what
    that takes away, what a dilation adds, and other probabilities above 0."""
    u = G.planes(spark, sf).select("image_id", F.transform("a", lambda v: F.floor(v * 255 + 0.5).cast("int")).alias("c"))
    u = G.bound(u, f=F.transform("c", lambda c: (c > 200).cast("int")))
    u = G.bound(u, d=M.dilated(F.col("f"), M.square(1), 0), e=M.eroded(F.col("f"), M.square(1), 1))
    return G.by_pixel(u, v=G.zipped(lambda c, f, d, e: F.when((f == 1) & (e == 1), 255).when((d == 1) | (c > 0), 127).otherwise(0), "c", "f", "d", "e"))


@query(
    """, m AS (SELECT image_id, idx, x, y, CASE WHEN a >= 0.5 THEN 1 ELSE 0 END AS v FROM px)
SELECT p.image_id, p.idx, CASE WHEN p.v = 1 AND (count(q.v) < 4 OR min(q.v) = 0) THEN 1 ELSE 0 END AS v
FROM m p LEFT JOIN m q ON q.image_id = p.image_id AND abs(q.x - p.x) + abs(q.y - p.y) = 1 GROUP BY p.image_id, p.idx, p.v""",
    planes=True,
)
def boundary_points(spark: SparkSession, sf: str) -> DataFrame:
    mask = G.planes(spark, sf).withColumn("m", F.transform("a", lambda v: (v >= 0.5).cast("int")))
    return G.by_pixel(mask, v=M.boundary(F.col("m")))


_UNSURE = """, lit AS MATERIALIZED (SELECT image_id, idx, x, y, a, g, b, t, 0.2126 * a + 0.7152 * g + 0.0722 * b AS l FROM rgb),
step AS MATERIALIZED (SELECT p.image_id, p.idx, p.x, p.y, 4 * p.t * (1 - p.t) AS soft, least(1.0, abs(p.t - coalesce(r.t, p.t)) + abs(p.t - coalesce(d.t, p.t))) AS grad, least(1.0, abs(p.l - coalesce(r.l, p.l)) + abs(p.l - coalesce(d.l, p.l))) AS contrast, abs(p.t - p.b) AS other
 FROM lit p LEFT JOIN lit r ON r.image_id = p.image_id AND r.y = p.y AND r.x = p.x + 1 LEFT JOIN lit d ON d.image_id = p.image_id AND d.x = p.x AND d.y = p.y + 1),
unsure AS MATERIALIZED (SELECT *, greatest(0.0, least(1.0, 0.42 * soft + 0.20 * grad + 0.18 * contrast + 0.20 * other)) AS u FROM step)"""


def _features(spark: SparkSession, sf: str) -> DataFrame:
    """image_id, t, and by pixel soft, grad, contrast, other and u; the alpha is t, that of another model b."""
    lit = G.bound(G.images(spark, sf), l=G.zipped(luminance, "r", "g", "b"))

    def steps(c: str):
        a = F.col(c)
        off = lambda x, y, i, dx, dy: F.abs(G.at(a, i) - G.neighbour(a, x, y, dx, dy, "clamp"))
        return G.each(lambda i, x, y: F.least(F.lit(1.0), off(x, y, i, 1, 0) + off(x, y, i, 0, 1)))

    made = G.bound(lit, soft=F.transform("t", lambda v: 4 * v * (1 - v)), grad=steps("t"), contrast=steps("l"), other=G.zipped(lambda t, b: F.abs(t - b), "t", "b"))
    return G.bound(made, u=G.zipped(lambda s, g, c, o: clamp(0.42 * s + 0.20 * g + 0.18 * c + 0.20 * o), "soft", "grad", "contrast", "other"))


@query(_UNSURE + " SELECT image_id, round(avg(soft), 6) AS soft_range, round(avg(grad), 6) AS gradient, round(avg(contrast), 6) AS contrast, round(avg(other), 6) AS disagreement, round(avg(u), 6) AS risk FROM unsure GROUP BY image_id", planes=True)
def uncertainty_features(spark: SparkSession, sf: str) -> DataFrame:
    """Means of softness, alpha steps and luminance steps to the right and below (together 1 at most), of the difference
    from another model, and of the uncertainty that weighs them."""
    names = {"soft": "soft_range", "grad": "gradient", "contrast": "contrast", "other": "disagreement", "u": "risk"}
    return _features(spark, sf).select("image_id", *[F.round(G.mean(F.col(c)), 6).alias(n) for c, n in names.items()])


def topology_risk(a: np.ndarray) -> float:
    """Components of what alpha covers, four and more being the whole risk."""
    return min(1.0, labelled(a >= 0.5)[1] / 4)


def tiles_of(u: np.ndarray, least: float = 0.28, tile: int = 8, overlap: int = 2) -> list[tuple[int, int, int, int]]:
    """(x, y, width, height) of tiles over the padded box of uncertain pixels; those after the first of a row start
    earlier by the overlap, and the next starts where a tile ends."""
    ys, xs = np.nonzero(u >= least)
    if not len(xs):
        return []
    x0, y0 = max(0, int(xs.min()) - overlap), max(0, int(ys.min()) - overlap)
    x1, y1 = min(u.shape[1], int(xs.max()) + overlap + 1), min(u.shape[0], int(ys.max()) + overlap + 1)
    out = []
    for top in range(y0, y1, tile):
        left = x0
        while left < x1:
            start, end = left - (overlap if left > x0 else 0), min(left + tile + overlap, x1)
            out.append((start, top, end - start, min(tile, y1 - top)))
            left = end
    return out


@query(
    _UNSURE
    + """, box AS (SELECT image_id, greatest(0, 3 * min(x) - 2) AS x0, greatest(0, 3 * min(y) - 2) AS y0, least(24, 3 * max(x) + 5) AS x1, least(24, 3 * max(y) + 5) AS y1 FROM unsure WHERE u >= 0.28 GROUP BY image_id),
t AS (SELECT b.*, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM box b, range(0, 3) AS u(i), range(0, 3) AS v(j) WHERE x0 + 10 * i < x1 AND y0 + 8 * j < y1)
SELECT image_id, CAST(x0 + 10 * i - CASE WHEN i > 0 THEN 2 ELSE 0 END AS INTEGER) AS tile_x, CAST(y0 + 8 * j AS INTEGER) AS tile_y, CAST(least(x1, x0 + 10 * i + 10) - x0 - 10 * i + CASE WHEN i > 0 THEN 2 ELSE 0 END AS INTEGER) AS w, CAST(least(8, y1 - y0 - 8 * j) AS INTEGER) AS h FROM t""",
    planes=True,
)
def crop_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles over the uncertain pixels of each image, whose uncertainty is enlarged three times to 24 x 24."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(i, *t) for i, u in zip(p["image_id"], p["u"], strict=True) for t in tiles_of(np.kron(np.array(u).reshape(G.SIDE, G.SIDE), np.ones((3, 3))))]
            yield pd.DataFrame(rows, columns=["image_id", "tile_x", "tile_y", "w", "h"])

    return _features(spark, sf).select("image_id", "u").mapInPandas(run, "image_id long, tile_x int, tile_y int, w int, h int")


_R101 = "CASE WHEN {c} + {d} < 0 THEN -({c} + {d}) WHEN {c} + {d} > 7 THEN 14 - ({c} + {d}) ELSE {c} + {d} END"


@query(
    f""", o AS (SELECT CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy FROM range(-1, 2) AS u(dx), range(-1, 2) AS w(dy)),
s AS (SELECT p.image_id, p.idx, p.a, p.t, sum(q.t * q.a) / 9 AS af, sum(q.t) / 9 AS al, sum((1 - q.t) * q.a) / 9 AS bb FROM rgb p CROSS JOIN o JOIN rgb q ON q.image_id = p.image_id AND q.x = {_R101.format(c="p.x", d="dx")} AND q.y = {_R101.format(c="p.y", d="dy")} GROUP BY ALL)
SELECT image_id, idx, round(greatest(0.0, least(1.0, af / (al + 1e-5) + t * (a - t * (af / (al + 1e-5)) - (1 - t) * (bb / ((1 - al) + 1e-5))))), 5) AS f, round(bb / ((1 - al) + 1e-5), 5) AS b FROM s""",
    planes=True,
)
def fast_foreground_pass(spark: SparkSession, sf: str) -> DataFrame:
    """One pass of blur fusion of channel r with alpha t, over 3 x 3 pixels."""
    rows = G.bound(G.images(spark, sf), **M.fast_foreground_pass(F.col("a"), F.col("t"), F.col("a"), F.col("a"), 3))
    fused = lambda k: G.each(lambda i, x, y: M.fused_foreground(i, F.col("a"), F.col("t"), F.col("af"), F.col("al"), F.col("bb"))[k])
    return G.by_pixel(rows, f=fused(0), b=fused(1)).select("image_id", "idx", F.round("f", 5).alias("f"), F.round("b", 5).alias("b"))
