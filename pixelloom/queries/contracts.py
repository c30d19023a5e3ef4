"""Contracts over made-up cases: each row's numbers follow from its id, so that all sides of every rule occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks as K
from .base import query


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"))


def _k(n: int, shift: int = 0) -> Column:
    return ((F.col("id") + shift) % n).cast("int")


@query(
    """WITH i AS (SELECT o_orderkey AS id FROM orders), v AS (SELECT id, [0.0, 0.5, CASE id % 5 WHEN 0 THEN 1.5 WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE WHEN 3 THEN -0.1 ELSE 1.0 END, 0.25] AS v, CAST(id % 3 AS INTEGER) AS w, CAST((id + 1) % 4 AS INTEGER) AS h FROM i)
SELECT id, w * h = 4 AS grid, w * h = 4 AND id % 5 = 4 AS mask, w * h = 4 AND id % 5 NOT IN (1, 2) AS colours, id % 4 <> 3 AS trimap, (id % 2 = 0) = (id % 3 = 0) AS matte FROM v"""
)
def image_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Masks, colours and trimaps of the right size and range; foreground and background both there or both not."""
    odd = F.element_at(F.array(*[F.lit(x) for x in (1.5, float("nan"), float("inf"), -0.1, 1.0)]), _k(5) + 1)
    v, w, h = F.array(F.lit(0.0), F.lit(0.5), odd, F.lit(0.25)), _k(3), _k(4, 1)
    some = lambda n: F.when(F.col("id") % n == 0, F.lit(1))
    return _ids(spark, sf).select("id", K.grid(w, h, v).alias("grid"), K.alpha_mask(w, h, v).alias("mask"), K.colours(w, h, v).alias("colours"), K.trimap_codes(F.array(F.lit(0), _k(4), F.lit(2))).alias("trimap"), K.both_or_none(some(2), some(3)).alias("matte"))


@query(
    """WITH i AS (SELECT o_orderkey AS id, o_orderkey % 6 - 1 AS x0, o_orderkey % 5 - 1 AS y0, o_orderkey % 9 AS x1, o_orderkey % 7 AS y1, o_orderkey % 4 AS a, o_orderkey % 3 AS b FROM orders)
SELECT id, x0 <= x1 AND y0 <= y1 AND id % 11 <> 0 AS ordered, x0 <= x1 AND y0 <= y1 AND x0 >= 0 AND y0 >= 0 AND x1 <= 7 AND y1 <= 5 AND id % 11 <> 0 AS inside,
 CASE WHEN id % 2 = 0 THEN a + 10 + b = 10 + id % 5 ELSE id % 13 = 0 AND a + 10 + b = 10 + id % 5 END AS geometry FROM i"""
)
def geometry_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes in order and inside an image; pads or crops that make up the difference of two sizes."""
    x0 = F.when(F.col("id") % 11 == 0, float("nan")).otherwise((_k(6) - 1).cast("double"))
    y0, x1, y1 = ((_k(5) - 1).cast("double"), _k(9).cast("double"), _k(7).cast("double"))
    crop, fits = F.col("id") % 2 == 0, F.col("id") % 13 == 0
    zero, a, b = F.lit(0), _k(4), _k(3)
    # A crop takes a and b away; a padded row is one only if its crops are 0 (every thirteenth).
    rule = K.geometry(
        F.when(crop, "cover-crop").otherwise("contain-pad"), F.when(crop, 10 + _k(5)).otherwise(10), F.when(crop, 10).otherwise(10 + _k(5)),
        F.when(crop, zero).otherwise(a), F.when(crop, zero).otherwise(b), F.when(crop, a).otherwise(F.when(fits, zero).otherwise(1)), F.when(crop, b).otherwise(zero),
    )
    return _ids(spark, sf).select("id", K.box(x0, y0, x1, y1).alias("ordered"), K.box_inside(x0, y0, x1, y1, F.lit(7), F.lit(5)).alias("inside"), rule.alias("geometry"))


@query(
    """WITH i AS (SELECT o_orderkey AS id, o_orderkey % 5 - 1 AS a, o_orderkey % 7 - 1 AS b FROM orders)
SELECT id, CASE WHEN a > 0 AND b > 0 THEN 3 * a * b END AS numel, CASE WHEN a > 0 AND b > 0 AND 3 * a * b <= 20 THEN 3 * a * b END AS capped,
 CASE WHEN id % 2 = 0 THEN a = 2 ELSE a = -1 OR a > 0 END AS size_ok, a > 0 AND b > 0 AND b = 3 AND id % 3 * 9 = 3 * a * b AS output_ok FROM i"""
)
def shape_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Products of shapes, sizes against declared ones, and outputs against the expected shape (-1: any)."""
    a, b = (F.col("id") % 5 - 1).cast("bigint"), (F.col("id") % 7 - 1).cast("bigint")
    shape = F.array(F.lit(3).cast("bigint"), a, b)
    expected = F.array(*[F.lit(v).cast("bigint") for v in (3, -1, 3)])
    return _ids(spark, sf).select("id", K.elements(shape).alias("numel"), K.elements(shape, 20).alias("capped"), K.size_matches(F.when(F.col("id") % 2 == 0, 2), a).alias("size_ok"), K.output_contract(expected, shape, _k(3) * 9).alias("output_ok"))


@query(
    """WITH i AS (SELECT o_orderkey AS id FROM orders)
SELECT id, id % 4 > 0 AND id % 70 BETWEEN 1 AND 64 AND (id % 2 = 0 OR id % 3 > 0) AND id % 5 > 0 AS fast, id % 7 < 5 AND id % 3 > 0 AS multilevel, id % 11 <= 8 AND id % 5 > 0 AND (id % 2 = 0 OR id % 5000 BETWEEN 1 AND 4096) AS closed_form,
 CAST(greatest(1, CASE WHEN id % 2 = 0 THEN floor(9 * greatest(id % 50 + 1, 20) / 40.0 + 0.5) ELSE id % 4 END) AS INTEGER) AS kernel,
 CAST(CASE WHEN id % 3 = 0 THEN CASE WHEN id % 40 <= 30 THEN id % 40 END ELSE CASE WHEN id % 12 <= 10 THEN floor(id % 12 / 10.0 * 20 + 0.5) END END AS INTEGER) AS radius FROM i"""
)
def setting_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Domains of the settings of estimators and solvers, and sizes that follow from an image's."""
    i = F.col("id")
    fast = K.fast_foreground(_k(4), F.lit(5), _k(70), F.lit(3), i % 2 == 1, _k(3), F.when(i % 5 == 0, float("nan")).otherwise(1e-5))
    multi = K.multilevel_foreground(F.when(i % 7 < 5, 1e-5).when(i % 7 == 5, -1.0).otherwise(float("inf")), F.lit(0.1), _k(3))
    closed = K.closed_form(F.lit(1e-7), _k(11), F.when(i % 5 == 0, 0.0).otherwise(1e-7), [F.lit(10), F.lit(1)], F.when(i % 2 == 1, _k(5000)))
    kernel = K.kernel_width(F.when(i % 2 == 0, 9).otherwise(_k(4)), i % 2 == 0, _k(50) + 1, F.lit(20), F.lit(40))
    radius = K.radius(F.when(i % 3 == 0, _k(40)), F.when(i % 3 != 0, _k(12) / 10), F.lit(30), F.lit(20))
    return _ids(spark, sf).select("id", fast.alias("fast"), multi.alias("multilevel"), closed.alias("closed_form"), kernel.alias("kernel"), radius.alias("radius"))


_NAMES = "['cpu', 'CUDA', 'OpenVINO', 'tpu', '']"


@query(
    f"""WITH i AS (SELECT o_orderkey AS id, {_NAMES}[o_orderkey % 5 + 1] AS p, {_NAMES}[o_orderkey % 3 + 1] AS q FROM orders),
s AS (SELECT *, ['P0-u2-cf', 'P3-biref-vit', 'P9-none'][id % 3 + 1] || '+' || ['none', 'symmetric', 'rembg'][id % 4 % 3 + 1] || '+' || ['vitmatte', '', 'closed-form'][id % 5 % 3 + 1] || CASE WHEN id % 7 = 0 THEN '' ELSE '+fba' END AS line FROM i)
SELECT id, CASE WHEN lower(p) IN ('cpu', 'coreml', 'cuda', 'openvino') THEN lower(p) END AS provider, CASE WHEN p <> '' AND q <> '' THEN CASE WHEN p = q THEN false WHEN id % 2 = 0 THEN true END END AS fallback,
 CASE id % 3 WHEN 0 THEN 'assisted-non-automatic' WHEN 1 THEN CASE WHEN id % 2 = 0 THEN 'automatic-derived' END END AS eligible, CASE WHEN id % 4 < 3 THEN ['upper', 'lower', 'full'][id % 4 + 1] END AS cloth,
 CASE WHEN id % 3 < 2 THEN ['multiply-predicted', 'replace-source-alpha'][id % 3 + 1] END AS policy, id % 3 < 2 AND id % 4 % 3 < 2 AND id % 5 % 3 <> 1 AND id % 7 > 0 AS strict, id % 3 < 2 AND id % 5 > 0 AS config FROM s"""
)
def name_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Names of closed vocabularies, stand-ins of providers, and pipelines of four parts."""
    pick = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), k + 1)
    names = ("cpu", "CUDA", "OpenVINO", "tpu", "")
    p, q = pick(names, _k(5)), pick(names, _k(3))
    line = F.concat(pick(("P0-u2-cf", "P3-biref-vit", "P9-none"), _k(3)), F.lit("+"), pick(("none", "symmetric", "rembg"), _k(4) % 3), F.lit("+"), pick(("vitmatte", "", "closed-form"), _k(5) % 3), F.when(F.col("id") % 7 == 0, "").otherwise("+fba"))
    config = K.pipeline_config(pick((*K.SCHEMAS, "m3.pipeline.v1"), _k(3)), F.lit("noop"), F.when(F.col("id") % 5 == 0, "  ").otherwise("x"))
    return _ids(spark, sf).select(
        "id", K.provider(p).alias("provider"), K.fallback(p, q, F.col("id") % 2 == 0).alias("fallback"), K.eligibility(pick(("manual", "auto-derived", "other"), _k(3)), F.col("id") % 2 == 0).alias("eligible"),
        K.one_of(pick((*K.CLOTHS, "Full"), _k(4)), K.CLOTHS).alias("cloth"), K.one_of(pick((*K.POLICIES, "none"), _k(3)), K.POLICIES).alias("policy"), K.strict_pipeline(line).alias("strict"), config.alias("config"),
    )
