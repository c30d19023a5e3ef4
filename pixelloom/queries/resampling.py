"""Resampling: weighted gathers inside a row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid as G
from .base import query


def resized(a: Column, taps: list[list[tuple[int, float]]], width: int = G.SIDE) -> Column:
    """Both axes of a square plane by one table of taps: for each target place (source place, weight)."""
    n = len(taps)
    table = F.array(*[F.array(*[F.struct(F.lit(s).alias("s"), F.lit(w).alias("w")) for s, w in row]) for row in taps])

    def value(i: Column) -> Column:
        u, v = F.get(table, (i % n).cast("int")), F.get(table, F.floor(i / n).cast("int"))
        return F.aggregate(v, F.lit(0.0), lambda acc, q: acc + q["w"] * F.aggregate(u, F.lit(0.0), lambda t, p: t + p["w"] * G.at(a, q["s"] * width + p["s"])))

    return F.transform(G.places(n * n), value)


def linear_taps(source: int, target: int, half_pixel: bool) -> list[list[tuple[int, float]]]:
    out = []
    for k in range(target):
        at = (k + 0.5) * source / target - 0.5 if half_pixel else k * source / target
        low = math.floor(at)
        w = at - low
        out.append([(min(max(low, 0), source - 1), 1 - w), (min(max(low + 1, 0), source - 1), w)])
    return out


def _linear_sql(n: int, at: str) -> str:
    return f""", k AS (SELECT CAST(k AS INTEGER) AS k, {at} AS pos FROM range(0, {n}) AS v(k)), w AS (SELECT k, CAST(floor(pos) AS INTEGER) AS lo, pos - floor(pos) AS w FROM k),
t AS (SELECT k, greatest(0, least(7, lo)) AS s, 1 - w AS w FROM w UNION ALL SELECT k, greatest(0, least(7, lo + 1)), w FROM w)
SELECT image_id, CAST(u.k + {n} * v.k AS INTEGER) AS idx, round(sum(a * u.w * v.w), 6) AS v FROM px JOIN t u ON u.s = x JOIN t v ON v.s = y GROUP BY image_id, u.k, v.k"""


@query(_linear_sql(11, "k * 8.0 / 11"), planes=True)
def resize_bilinear_corner(spark: SparkSession, sf: str) -> DataFrame:
    return G.by_pixel(G.planes(spark, sf), v=resized(F.col("a"), linear_taps(8, 11, False))).withColumn("v", F.round("v", 6))


@query(_linear_sql(12, "(k + 0.5) * 8 / 12 - 0.5"), planes=True)
def resize_bilinear_half_pixel(spark: SparkSession, sf: str) -> DataFrame:
    return G.by_pixel(G.planes(spark, sf), v=resized(F.col("a"), linear_taps(8, 12, True))).withColumn("v", F.round("v", 6))


@query(", k AS (SELECT CAST(k AS INTEGER) AS k, CAST(floor(k * 8 / 5.0) AS INTEGER) AS s FROM range(0, 5) AS v(k)) SELECT image_id, CAST(u.k + 5 * v.k AS INTEGER) AS idx, round(a, 9) AS v FROM px JOIN k u ON u.s = x JOIN k v ON v.s = y", planes=True)
def resize_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return G.by_pixel(G.planes(spark, sf), v=resized(F.col("a"), [[(math.floor(k * 8 / 5), 1.0)] for k in range(5)])).withColumn("v", F.round("v", 9))
