"""Planes: an image is one row with arrays in row-major order.

Neighbourhoods are array expressions over the places of one row, so they need no shuffle, whatever the number of
images; only operations between images join, on image_id. The long form (a row for each pixel) is made where a result
is wanted by pixel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8


def normalised(v: Column) -> Column:
    """An array to 0..1 by its least and largest value; a constant one is 0."""
    # Bound by a one-element array, so that both are found once and not for each element.
    ends = F.array(F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high")))
    return F.transform(ends, lambda s: F.transform(v, lambda e: F.when(s["high"] == s["low"], F.lit(0.0)).otherwise((e - s["low"]) / (s["high"] - s["low"]))))[0]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("image_id"), F.col("label").alias("tag"), F.col("embedding").cast("array<double>").alias("a"))


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, tag, a: an 8 x 8 plane for each vector of the test table."""
    return _vectors(spark, sf_dir).withColumn("a", normalised(F.col("a")))


def following(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with further columns: the vectors of the next ids, modulo the number of images.

    Plain columns are joined; planes are made of them afterwards, so the joins' plans stay small.
    """
    count = rows.agg(F.max("image_id")).first()[0] + 1
    out = rows
    for k, name in enumerate(columns, 1):
        other = rows.select(F.pmod(F.col("image_id") - k, F.lit(count)).alias("image_id"), F.col("a").alias(name))
        out = out.join(other, "image_id")
    return out


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, tag, a and the reference t."""
    rows = following(_vectors(spark, sf_dir), "t")
    return rows.select("image_id", "tag", normalised(F.col("a")).alias("a"), normalised(F.col("t")).alias("t"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, tag, r, g, b; also a (that is r) and t (g)."""
    rows = following(planes(spark, sf_dir), "g", "b")
    return rows.select("image_id", "tag", F.col("a").alias("r"), "g", "b", "a", F.col("g").alias("t"))


def places(n: int = SIDE * SIDE) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def each(f: Callable[[Column, Column, Column], Column], width: int = SIDE, height: int = SIDE) -> Column:
    """The array of f(i, x, y) over all places."""
    return F.transform(places(width * height), lambda i: f(i, (i % width).cast("int"), F.floor(i / width).cast("int")))


def at(a: Column, i: Column) -> Column:
    return F.get(a, i.cast("int"))


def neighbour(a: Column, x: Column, y: Column, dx: int, dy: int, border, width: int = SIDE, height: int = SIDE) -> Column:
    """The value at (x + dx, y + dy). border: a value outside, or clamp, reflect (half-sample) or reflect101."""
    u, v = x + dx, y + dy
    if border in ("clamp", "reflect", "reflect101"):
        u, v = folded(u, width, border), folded(v, height, border)
        return at(a, v * width + u)
    inside = (u >= 0) & (u < width) & (v >= 0) & (v < height)
    return F.when(inside, at(a, v * width + u)).otherwise(F.lit(border))


def folded(u: Column, n: int, border: str) -> Column:
    if border == "clamp":
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), u))
    if border == "reflect":
        m = F.pmod(u, F.lit(2 * n))
        return F.when(m < n, m).otherwise(2 * n - 1 - m)
    m = F.pmod(u, F.lit(max(1, 2 * n - 2)))
    return F.when(m < n, m).otherwise(2 * n - 2 - m)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def bound(rows: DataFrame, **arrays: Column) -> DataFrame:
    """rows with further columns, each worked out once a row.

    The optimiser puts plain columns into the expressions over them, also into those for each pixel; it doesn't go
    through the generator here.
    """
    made = rows.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in arrays.items()]))).alias("bound"))
    return made.select(*[c for c in rows.columns if c not in arrays], *[F.col("bound")[k].alias(k) for k in arrays])


def zipped(f: Callable[..., Column], *arrays: str) -> Column:
    """The array of f over the elements of several arrays of one length."""
    return F.transform(F.arrays_zip(*arrays), lambda s: f(*[s[name] for name in arrays]))


def by_pixel(rows: DataFrame, **arrays: Column) -> DataFrame:
    """image_id, idx and a column for each array: the long form."""
    packed = rows.select("image_id", *[c.alias(k) for k, c in arrays.items()])
    long = packed.select("image_id", F.posexplode(F.arrays_zip(*arrays)).alias("idx", "s"))
    return long.select("image_id", "idx", *[F.col("s")[k].alias(k) for k in arrays])
