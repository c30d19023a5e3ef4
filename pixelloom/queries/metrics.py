"""Alpha metrics of an image against its reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixel import srgb_to_linear
from ..operators import grid as G
from .base import query


def _sum(f, *arrays: str):
    return G.total(G.zipped(f, *arrays))


def _count(f, *arrays: str):
    return _sum(lambda *v: f(*v).cast("double"), *arrays)


_P, _T = "CASE WHEN a >= 0.5 THEN 1 ELSE 0 END", "CASE WHEN t >= 0.5 THEN 1 ELSE 0 END"


@query(
    f""", z AS (SELECT 1)
SELECT image_id, round(avg(abs(a - t)), 6) AS mae, round(sqrt(avg((a - t) * (a - t))), 6) AS rmse,
 round(CASE WHEN sum(greatest(a, t)) = 0 THEN 1.0 ELSE sum(least(a, t)) / sum(greatest(a, t)) END, 6) AS soft_iou,
 round(coalesce(CAST(sum(({_P}) * ({_T})) AS DOUBLE) / nullif(sum(greatest({_P}, {_T})), 0), 1.0), 6) AS iou,
 round(CAST(sum(({_P}) * ({_T})) AS DOUBLE) / greatest(sum({_P}), 1), 6) AS "precision", round(CAST(sum(({_P}) * ({_T})) AS DOUBLE) / greatest(sum({_T}), 1), 6) AS recall,
 round(coalesce(avg(CASE WHEN t > 0.02 AND t < 0.98 THEN abs(a - t) END), 0.0), 6) AS fractional FROM rgb GROUP BY image_id""",
    planes=True,
)
def alpha_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Errors and overlaps of each image's alpha; no shuffle but the join with the reference."""
    both = lambda a, t: (a >= 0.5) & (t >= 0.5)
    either = lambda a, t: (a >= 0.5) | (t >= 0.5)
    fraction = lambda t: (t > 0.02) & (t < 0.98)
    sums = G.pairs(spark, sf).select(
        "image_id",
        _sum(lambda a, t: F.abs(a - t), "a", "t").alias("e"), _sum(lambda a, t: (a - t) * (a - t), "a", "t").alias("s"),
        _sum(lambda a, t: F.least(a, t), "a", "t").alias("lo"), _sum(lambda a, t: F.greatest(a, t), "a", "t").alias("hi"),
        _count(both, "a", "t").alias("both"), _count(either, "a", "t").alias("either"),
        _count(lambda a: a >= 0.5, "a").alias("pa"), _count(lambda t: t >= 0.5, "t").alias("pt"),
        _sum(lambda a, t: F.when(fraction(t), F.abs(a - t)).otherwise(0.0), "a", "t").alias("fe"), _count(fraction, "t").alias("fn"),
    )
    c = F.col
    n = G.SIDE * G.SIDE
    return sums.select(
        "image_id", F.round(c("e") / n, 6).alias("mae"), F.round(F.sqrt(c("s") / n), 6).alias("rmse"),
        F.round(F.when(c("hi") == 0, 1.0).otherwise(c("lo") / F.when(c("hi") != 0, c("hi"))), 6).alias("soft_iou"),
        F.round(F.when(c("either") == 0, 1.0).otherwise(c("both") / F.when(c("either") != 0, c("either"))), 6).alias("iou"),
        F.round(c("both") / F.greatest(c("pa"), F.lit(1.0)), 6).alias("precision"), F.round(c("both") / F.greatest(c("pt"), F.lit(1.0)), 6).alias("recall"),
        F.round(F.when(c("fn") == 0, 0.0).otherwise(c("fe") / F.when(c("fn") != 0, c("fn"))), 6).alias("fractional"),
    )


@query(
    """, c AS (SELECT * FROM (VALUES ('all-zero', 0.0::DOUBLE), ('all-one', 1.0::DOUBLE)) AS v(candidate, value)),
m AS (SELECT image_id, candidate, avg(abs(value - a)) AS mae, CASE WHEN sum(greatest(value, a)) = 0 THEN 1 ELSE sum(least(value, a)) / sum(greatest(value, a)) END AS iou FROM px CROSS JOIN c GROUP BY ALL),
s AS (SELECT *, CASE image_id % 3 WHEN 0 THEN 'tune' WHEN 1 THEN 'validation' ELSE 'blind' END AS split FROM m)
SELECT coalesce(split, 'overall') AS split, candidate, count(*) AS n, round(avg(mae), 6) AS mae, round(avg(iou), 6) AS soft_iou FROM s GROUP BY GROUPING SETS ((split, candidate), (candidate))""",
    planes=True,
)
def baseline_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Constant candidates: means overall and by split."""
    rows = G.planes(spark, sf).select("image_id", "a", F.explode(F.array(*[F.struct(F.lit(k).alias("candidate"), F.lit(v).alias("value")) for k, v in (("all-zero", 0.0), ("all-one", 1.0))])).alias("c")).select("image_id", "a", "c.*")
    high = G.total(F.transform("a", lambda a: F.greatest(a, F.col("value"))))
    low = G.total(F.transform("a", lambda a: F.least(a, F.col("value"))))
    m = rows.select("candidate", F.element_at(F.array(F.lit("tune"), F.lit("validation"), F.lit("blind")), (F.col("image_id") % 3 + 1).cast("int")).alias("split"), G.mean(F.transform("a", lambda a: F.abs(F.col("value") - a))).alias("mae"), low.alias("low"), high.alias("high"))
    m = m.withColumn("iou", F.when(F.col("high") == 0, 1.0).otherwise(F.col("low") / F.when(F.col("high") != 0, F.col("high"))))
    sets = m.groupingSets([["split", "candidate"], ["candidate"]], "split", "candidate").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mae"), 6).alias("mae"), F.round(F.avg("iou"), 6).alias("soft_iou"))
    return sets.withColumn("split", F.coalesce("split", F.lit("overall")))


_DECODE = "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END"


@query(
    f""", c AS MATERIALIZED (SELECT image_id, greatest(a, t) AS w, {_DECODE.format("a")} AS r, {_DECODE.format("g")} AS g, {_DECODE.format("b")} AS b FROM rgb)
SELECT image_id, round(coalesce(sum(w * (abs(r - g) + abs(g - b) + abs(b - r)) / 3) FILTER (w > 0.02) / nullif(sum(w) FILTER (w > 0.02), 0), 0.0), 6) AS error FROM c GROUP BY image_id""",
    planes=True,
)
def foreground_colour_error(spark: SparkSession, sf: str) -> DataFrame:
    """Mean difference over three channels in linear light, weighed by the larger alpha where that is above 0.02.

    The colours are r, g, b, those of the reference g, b, r.
    """
    linear = lambda c: F.transform(c, lambda v: srgb_to_linear(v, bounded=False))
    rows = G.bound(G.images(spark, sf), lr=linear("r"), lg=linear("g"), lb=linear("b"))
    w = lambda a, t: F.when(F.greatest(a, t) > 0.02, F.greatest(a, t)).otherwise(0.0)
    error = _sum(lambda a, t, r, g, b: w(a, t) * (F.abs(r - g) + F.abs(g - b) + F.abs(b - r)) / 3, "a", "t", "lr", "lg", "lb")
    sums = rows.select("image_id", error.alias("e"), _sum(w, "a", "t").alias("w"))
    return sums.select("image_id", F.round(F.when(F.col("w") == 0, 0.0).otherwise(F.col("e") / F.when(F.col("w") != 0, F.col("w"))), 6).alias("error"))


@query(
    """, s AS (SELECT image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM rgb WHERE a >= 0.5 OR t >= 0.5 GROUP BY image_id)
SELECT image_id, greatest(0, x0 - 1) AS x0, least(7, x1 + 1) AS x1, greatest(0, y0 - 1) AS y0, least(7, y1 + 1) AS y1 FROM s""",
    planes=True,
)
def roi_bbox(spark: SparkSession, sf: str) -> DataFrame:
    """The box of what either alpha covers, padded by a pixel: max(1, round(0.05 * diagonal))."""
    covered = lambda f: F.filter(G.each(lambda i, x, y: F.when((G.at(F.col("a"), i) >= 0.5) | (G.at(F.col("t"), i) >= 0.5), f(x, y))), lambda v: v.isNotNull())
    rows = G.pairs(spark, sf).select("image_id", covered(lambda x, y: x).alias("xs"), covered(lambda x, y: y).alias("ys")).where(F.size("xs") > 0)
    return rows.select("image_id", *[c for k in "xy" for c in (F.greatest(F.lit(0), F.array_min(k + "s") - 1).alias(k + "0"), F.least(F.lit(7), F.array_max(k + "s") + 1).alias(k + "1"))])
