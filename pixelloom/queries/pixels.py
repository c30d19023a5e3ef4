"""Per-pixel projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixel as P
from ..operators import grid as G
from .base import query


@query(", x AS (SELECT 1) SELECT image_id, idx, round(a, 9) AS v FROM px", planes=True)
def minmax_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return G.by_pixel(G.planes(spark, sf), v=F.col("a")).withColumn("v", F.round("v", 9))


@query(", x AS (SELECT 1) SELECT image_id, idx, CAST(floor(a * 255 + 0.5) AS INTEGER) AS q, CAST(floor(a * 255) AS INTEGER) AS c FROM px", planes=True)
def quantise_u8(spark: SparkSession, sf: str) -> DataFrame:
    return G.by_pixel(G.planes(spark, sf), a=F.col("a")).select("image_id", "idx", P.quantize_u8(F.col("a")).alias("q"), P.truncate_u8(F.col("a")).alias("c"))


@query(", x AS (SELECT 1) SELECT image_id, idx, CASE WHEN floor(a * 255) > 127 THEN 1 ELSE 0 END AS v FROM px", planes=True)
def hard_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return G.by_pixel(G.planes(spark, sf), a=F.col("a")).select("image_id", "idx", P.hard_threshold(F.col("a"), 127).alias("v"))


@query(", x AS (SELECT 1) SELECT image_id, idx, round(1 / (1 + exp(-(8 * a - 4))), 6) AS s, round(greatest(0.0, least(1.0, 1.5 * a - 0.25)), 6) AS c FROM px", planes=True)
def sigmoid_clamp(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("a")
    return G.by_pixel(G.planes(spark, sf), a=a).select("image_id", "idx", F.round(P.sigmoid(8 * a - 4), 6).alias("s"), F.round(P.clamp(1.5 * a - 0.25), 6).alias("c"))


@query(
    """, lin AS (SELECT image_id, idx, CASE WHEN a <= 0.04045 THEN a / 12.92 ELSE pow((a + 0.055) / 1.055, 2.4) END AS l FROM px)
SELECT image_id, idx, round(l, 6) AS l, round(CASE WHEN l <= 0.0031308 THEN l * 12.92 ELSE 1.055 * pow(l, 1 / 2.4) - 0.055 END, 6) AS e FROM lin""",
    planes=True,
)
def srgb_linear_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = G.by_pixel(G.planes(spark, sf), a=F.col("a")).select("image_id", "idx", P.srgb_to_linear(F.col("a")).alias("l"))
    return rows.select("image_id", "idx", F.round("l", 6).alias("l"), F.round(P.linear_to_srgb(F.col("l")), 6).alias("e"))


@query(
    """, lum AS (SELECT *, 0.2126 * a + 0.7152 * g + 0.0722 * b AS l FROM rgb), m AS (SELECT image_id, avg(l) AS m FROM lum GROUP BY image_id)
SELECT lum.image_id, idx, round(l, 6) AS l, round(greatest(0.0, least(1.0, 0.5 + 2.4 * (l - m + 0.12 + ((x + y) % 7 - 3) * 0.008))), 6) AS v FROM lum JOIN m USING (image_id)""",
    planes=True,
)
def luminance_segmenter(spark: SparkSession, sf: str) -> DataFrame:
    """Luminance, and a mask that is affine in it about the image's mean."""
    lit = G.bound(G.bound(G.images(spark, sf), l=G.zipped(P.luminance, "r", "g", "b")), m=G.mean(F.col("l")))
    mask = G.each(lambda i, x, y: P.clamp(0.5 + 2.4 * (G.at(F.col("l"), i) - F.col("m") + 0.12 + ((x + y) % 7 - 3) * 0.008)))
    return G.by_pixel(lit, l=F.col("l"), v=mask).select("image_id", "idx", F.round("l", 6).alias("l"), F.round("v", 6).alias("v"))


@query(", z AS (SELECT 1) SELECT image_id, idx, round(greatest(0.0, least(1.0, 0.35 + 1.6 * abs(a - b) + ((3 * x + 5 * y) % 11) * 0.012)), 6) AS v FROM rgb", planes=True)
def complementary_segmenter(spark: SparkSession, sf: str) -> DataFrame:
    mask = G.each(lambda i, x, y: P.complementary_segmenter(G.at(F.col("r"), i), G.at(F.col("b"), i), x, y))
    return G.by_pixel(G.images(spark, sf), v=mask).withColumn("v", F.round("v", 6))


_D = "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END"


@query(
    f""", c AS (SELECT image_id, idx, a, t, t * b + (1 - t) AS w, t * ({_D.format("b")}) + (1 - t) AS lw FROM rgb)
SELECT image_id, idx, round(w, 6) AS white, round(a * t, 6) AS black, round(CASE WHEN lw <= 0.0031308 THEN lw * 12.92 ELSE 1.055 * pow(lw, 1 / 2.4) - 0.055 END, 6) AS white_linear FROM c""",
    planes=True,
)
def composite_white_black(spark: SparkSession, sf: str) -> DataFrame:
    """Channel b over white with alpha t, in encoded and in linear light; channel r over black."""
    rows = G.by_pixel(G.images(spark, sf), r=F.col("r"), t=F.col("t"), b=F.col("b"))
    t, one = F.col("t"), F.lit(1.0)
    return rows.select("image_id", "idx", F.round(P.composite(t, F.col("b"), one), 6).alias("white"), F.round(P.composite(t, F.col("r"), F.lit(0.0)), 6).alias("black"), F.round(P.composite_linear(t, F.col("b"), one), 6).alias("white_linear"))


@query(
    """, u AS (SELECT image_id, idx, CAST(floor(a * 255) AS INTEGER) AS a, CAST(floor(t * 255) AS INTEGER) AS t FROM rgb), m AS (SELECT *, ((a * t + 128) + ((a * t + 128) >> 8)) >> 8 AS p FROM u)
SELECT image_id, idx, CAST(p AS INTEGER) AS p, CAST(CASE WHEN t = 0 THEN 0 ELSE least(255, floor((255 * p) / t)) END AS INTEGER) AS u FROM m""",
    planes=True,
)
def integer_premultiply(spark: SparkSession, sf: str) -> DataFrame:
    rows = G.by_pixel(G.images(spark, sf), a=F.col("a"), t=F.col("t")).select("image_id", "idx", P.truncate_u8(F.col("a")).alias("a"), P.truncate_u8(F.col("t")).alias("t"))
    rows = rows.withColumn("p", P.mul_div_255(F.col("a"), F.col("t")))
    return rows.select("image_id", "idx", F.col("p").cast("int").alias("p"), P.unpremultiplied(F.col("p"), F.col("t")).alias("u"))


@query(", z AS (SELECT 1) SELECT image_id, idx, floor(a * 10 + 0.5) AS js, round_even(a * 10, 0) AS py FROM px", planes=True)
def rounding_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = G.by_pixel(G.planes(spark, sf), a=F.col("a"))
    return rows.select("image_id", "idx", P.js_round(F.col("a") * 10).cast("double").alias("js"), P.python_round(F.col("a") * 10).alias("py"))


@query(
    """, z AS (SELECT 1), c AS (SELECT image_id, idx, unnest([0, 1, 2]) AS channel, unnest([a, g, b]) AS v, unnest([0.485, 0.456, 0.406]) AS m, unnest([0.229, 0.224, 0.225]) AS s FROM rgb)
SELECT image_id, CAST(channel * 64 + idx AS INTEGER) AS pos, round((v - m) / s, 6) AS v FROM c""",
    planes=True,
)
def tensor_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Channel-major tensor values, normalised with the usual means and deviations of natural images."""
    kinds = (("r", 0.485, 0.229), ("g", 0.456, 0.224), ("b", 0.406, 0.225))
    flat = F.concat(*[_scaled(c, m, s) for c, m, s in kinds])
    return G.images(spark, sf).select("image_id", F.posexplode(flat).alias("pos", "v")).withColumn("v", F.round("v", 6))


def _scaled(column: str, mean: float, deviation: float):
    return F.transform(column, lambda v: (v - mean) / deviation)


@query(
    """, z AS (SELECT 1), g AS (SELECT image_id, 40 + image_id % 50 AS w, 30 + image_id % 37 AS h FROM px WHERE idx = 0),
c AS (SELECT *, least(32.0 / w, 32.0 / h) AS s FROM g), d AS (SELECT *, CAST(greatest(1, floor(w * s + 0.5)) AS INTEGER) AS iw, CAST(greatest(1, floor(h * s + 0.5)) AS INTEGER) AS ih FROM c)
SELECT image_id, iw, ih, CAST((32 - iw) // 2 AS INTEGER) AS left_pad, CAST((32 - ih) // 2 AS INTEGER) AS top_pad, CAST(32 - iw - (32 - iw) // 2 AS INTEGER) AS right_pad, CAST(32 - ih - (32 - ih) // 2 AS INTEGER) AS bottom_pad FROM d""",
    planes=True,
)
def geometry_contain_pad(spark: SparkSession, sf: str) -> DataFrame:
    """Scaled to fit into 32 x 32, the rest padded; of an odd rest the smaller half is left and on top."""
    rows = G.planes(spark, sf).select("image_id", (40 + F.col("image_id") % 50).alias("w"), (30 + F.col("image_id") % 37).alias("h"))
    s = F.least(32.0 / F.col("w"), 32.0 / F.col("h"))
    rows = rows.select("image_id", *[F.greatest(F.lit(1), F.floor(F.col(c) * s + 0.5)).cast("int").alias(f"i{c}") for c in ("w", "h")])
    left, top = F.floor((32 - F.col("iw")) / 2).cast("int"), F.floor((32 - F.col("ih")) / 2).cast("int")
    return rows.select("image_id", "iw", "ih", left.alias("left_pad"), top.alias("top_pad"), (32 - F.col("iw") - left).alias("right_pad"), (32 - F.col("ih") - top).alias("bottom_pad"))


@query(
    """, z AS (SELECT 1), g AS (SELECT image_id, (image_id % 11) / 10.0 AS s FROM px WHERE idx = 0)
SELECT image_id, round(200 + 55 * s, 6) AS foreground, round(8 + 24 * s, 6) AS background, CAST(1 + floor(3 * s + 0.5) AS INTEGER) AS erode FROM g""",
    planes=True,
)
def strength_config(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds and erosion that a strength from 0 to 1 stands for."""
    s = (F.col("image_id") % 11) / 10.0
    return G.planes(spark, sf).select("image_id", F.round(200 + 55 * s, 6).alias("foreground"), F.round(8 + 24 * s, 6).alias("background"), (1 + F.floor(3 * s + 0.5)).cast("int").alias("erode"))
