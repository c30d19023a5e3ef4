"""Images that follow from formulas: test inputs of any number, made where they are needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixel import clamp, luminance
from .base import query

# Tags by place, and the bias that stands for a model.
PORTRAIT, EMISSIVE = "portrait-character", "emissive-artwork"
BIAS = {"P0-u2-cf": 0.018, "P1-isnet-fast": -0.011, "P2-tracer-fba": 0.008, "P3-biref-vit": -0.004}
OTHER_BIAS = 0.014


def _places(rows: DataFrame) -> DataFrame:
    """A row for each pixel of rows with w and h."""
    idx = F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)).alias("idx")
    return rows.select("*", idx).withColumn("x", (F.col("idx") % F.col("w")).cast("int")).withColumn("y", F.floor(F.col("idx") / F.col("w")).cast("int"))


def ramps(spark: SparkSession) -> DataFrame:
    """id, split, local, w, h, tag, idx, x, y, r, g, b, t: twelve images of colour ramps with a diamond's alpha."""
    k = spark.range(12).select((F.col("id") % 6).cast("int").alias("local"), F.when(F.col("id") < 6, "tune").otherwise("validation").alias("split"))
    k = k.select(
        F.concat(F.lit("synthetic-"), "split", F.lit("-"), F.col("local") + 1).alias("id"), "split", "local", (24 + F.col("local") % 3 * 3).alias("w"), (20 + F.col("local") % 2 * 4).alias("h"),
        F.when(F.col("local") % 2 == 0, PORTRAIT).otherwise(EMISSIVE).alias("tag"),
    )
    p = _places(k)
    edge = F.abs(F.col("x") - F.floor(F.col("w") / 2)) + F.abs(F.col("y") - F.floor(F.col("h") / 2))
    radius = F.least("w", "h") * (0.29 + F.col("local") * 0.008 + F.when(F.col("split") == "tune", 0.0).otherwise(0.003))
    return p.select("*", (0.15 + F.col("x") / F.col("w") * 0.7).alias("r"), (0.2 + F.col("y") / F.col("h") * 0.6).alias("g"), (0.35 + F.col("local") * 0.03).alias("b"), clamp((radius + 1.5 - edge) / 3.0).alias("t"))


_RAMPS = """k AS (SELECT CAST(i % 6 AS INTEGER) AS loc, CASE WHEN i < 6 THEN 'tune' ELSE 'validation' END AS split FROM range(0, 12) AS v(i)),
w AS (SELECT *, 'synthetic-' || split || '-' || (loc + 1) AS id, 24 + loc % 3 * 3 AS w, 20 + loc % 2 * 4 AS h, CASE WHEN loc % 2 = 0 THEN 'portrait-character' ELSE 'emissive-artwork' END AS tag FROM k),
p AS (SELECT w.*, CAST(unnest(range(0, w * h)) AS INTEGER) AS idx FROM w), q AS (SELECT *, idx % w AS x, idx // w AS y FROM p),
ramps AS MATERIALIZED (SELECT id, split, tag, idx, 0.15 + CAST(x AS DOUBLE) / w * 0.7 AS r, 0.2 + CAST(y AS DOUBLE) / h * 0.6 AS g, 0.35 + loc * 0.03 AS b,
 greatest(0.0, least(1.0, (least(w, h) * (0.29 + loc * 0.008 + CASE split WHEN 'tune' THEN 0.0 ELSE 0.003 END) + 1.5 - (abs(x - w // 2) + abs(y - h // 2))) / 3.0)) AS t FROM q)"""


def _six(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


@query(f"WITH {_RAMPS} SELECT id, split, tag, idx, round(CAST(r AS DOUBLE), 6) AS r, round(CAST(g AS DOUBLE), 6) AS g, round(CAST(b AS DOUBLE), 6) AS b, round(CAST(t AS DOUBLE), 6) AS t FROM ramps")
def synthetic_images(spark: SparkSession, sf: str) -> DataFrame:
    return ramps(spark).select("id", "split", "tag", "idx", *_six("r", "g", "b", "t"))


@query(
    f"""WITH {_RAMPS}, m AS (SELECT * FROM (VALUES ('P0-u2-cf', 0.018), ('P1-isnet-fast', -0.011), ('P2-tracer-fba', 0.008), ('P3-biref-vit', -0.004), ('P4-bria-vit', 0.014)) AS v(model, bias))
SELECT id, model, idx, round(CAST(greatest(0.0, least(1.0, 0.28 + (0.2126 * r + 0.7152 * g + 0.0722 * b) * 0.72 + bias + ((idx * 17 + length(model) * 3) % 11 - 5) * 0.001)) AS DOUBLE), 6) AS v FROM ramps, m"""
)
def synthetic_raw_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-ins for inference: functions of colour and place alone, with a bias for each model."""
    models = F.explode(F.array(*[F.lit(m) for m in (*BIAS, "P4-bria-vit")])).alias("model")
    rows = ramps(spark).select("id", "idx", "r", "g", "b", models)
    bias = F.coalesce(*[F.when(F.col("model") == m, F.lit(v)) for m, v in BIAS.items()], F.lit(OTHER_BIAS))
    noise = ((F.col("idx") * 17 + F.length("model") * 3) % 11 - 5) * 0.001
    return rows.select("id", "model", "idx", F.round(clamp(0.28 + luminance(F.col("r"), F.col("g"), F.col("b")) * 0.72 + bias + noise), 6).alias("v"))


def bodies(spark: SparkSession) -> DataFrame:
    """id, k, w, h, tag, idx, x, y, r, g, b, t, fr, fg, fb: six images of an ellipse with straps over a background."""
    k = spark.range(6).select(F.col("id").cast("int").alias("k")).select(
        F.concat(F.lit("hybrid-validation-"), F.col("k") + 1).alias("id"), "k", (32 + F.col("k") % 2 * 8).alias("w"), (24 + F.col("k") % 3 * 4).alias("h"), F.when(F.col("k").isin(2, 3), EMISSIVE).otherwise(PORTRAIT).alias("tag")
    )
    p = _places(k).withColumn("u", F.col("x") / F.col("w")).withColumn("v", F.col("y") / F.col("h"))
    dx, dy = (F.col("u") - 0.5) / (0.22 + F.col("k") * 0.008), (F.col("v") - 0.5) / (0.34 + F.col("k") * 0.006)
    strap = F.when(((F.col("x") + F.col("k") * 3) % 13 == 0) & (F.col("v") > 0.2) & (F.col("v") < 0.85), 0.72).otherwise(0.0)
    p = p.withColumn("t", clamp(clamp(1 - F.sqrt(dx * dx + dy * dy)) * 0.92 + strap))
    u, v, t = F.col("u"), F.col("v"), F.col("t")
    p = p.withColumn("fr", 0.78 - 0.12 * v).withColumn("fg", 0.24 + 0.28 * u).withColumn("fb", 0.18 + 0.16 * (u + v))
    noise = F.when((t >= 0.02) & (t < 0.98), 0.004 * ((F.col("x") + F.col("y")) % 3)).otherwise(0.0)
    back = {"r": 0.08 + 0.12 * u, "g": 0.14 + 0.10 * v, "b": 0.28 + 0.08 * (1 - u)}
    return p.withColumns({c: clamp(t * F.col("f" + c) + (1 - t) * b + noise) for c, b in back.items()}).drop("u", "v")


_BODIES = """k AS (SELECT CAST(k AS INTEGER) AS k, 32 + k % 2 * 8 AS w, 24 + k % 3 * 4 AS h FROM range(0, 6) AS v(k)),
p AS (SELECT k.*, CAST(unnest(range(0, w * h)) AS INTEGER) AS idx FROM k), q AS (SELECT *, CAST(idx % w AS INTEGER) AS x, CAST(idx // w AS INTEGER) AS y, CAST(idx % w AS DOUBLE) / w AS u, CAST(idx // w AS DOUBLE) / h AS v FROM p),
a AS (SELECT *, greatest(0.0, least(1.0, greatest(0.0, least(1.0, 1 - sqrt(pow((u - 0.5) / (0.22 + k * 0.008), 2) + pow((v - 0.5) / (0.34 + k * 0.006), 2)))) * 0.92 + CASE WHEN (x + k * 3) % 13 = 0 AND v > 0.2 AND v < 0.85 THEN 0.72 ELSE 0.0 END)) AS t FROM q),
n AS (SELECT *, CASE WHEN t >= 0.02 AND t < 0.98 THEN 0.004 * ((x + y) % 3) ELSE 0.0 END AS n FROM a),
bodies AS MATERIALIZED (SELECT 'hybrid-validation-' || (k + 1) AS id, k, w, h, idx, x, y, t, CASE WHEN k IN (2, 3) THEN 'emissive-artwork' ELSE 'portrait-character' END AS tag,
 greatest(0.0, least(1.0, t * (0.78 - 0.12 * v) + (1 - t) * (0.08 + 0.12 * u) + n)) AS r, greatest(0.0, least(1.0, t * (0.24 + 0.28 * u) + (1 - t) * (0.14 + 0.10 * v) + n)) AS g, greatest(0.0, least(1.0, t * (0.18 + 0.16 * (u + v)) + (1 - t) * (0.28 + 0.08 * (1 - u)) + n)) AS b FROM n)"""


@query(f"WITH {_BODIES} SELECT id, tag, idx, round(CAST(r AS DOUBLE), 6) AS r, round(CAST(g AS DOUBLE), 6) AS g, round(CAST(b AS DOUBLE), 6) AS b, round(CAST(t AS DOUBLE), 6) AS t FROM bodies")
def fixture_images(spark: SparkSession, sf: str) -> DataFrame:
    return bodies(spark).select("id", "tag", "idx", *_six("r", "g", "b", "t"))
