"""Images, tensors, records and lines written to bytes and read back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agreement as A
from ..operators import grid as G
from ..sources import codecs as C
from ..sources import records as R
from .base import query

S = G.SIDE


def _each(rows: DataFrame, f: Callable[..., list[tuple]], ddl: str) -> DataFrame:
    """The rows that f makes of each row."""
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([x for row in p.itertuples(index=False) for x in f(*row)], columns=names)

    return rows.mapInPandas(run, ddl)


def _plane(a) -> np.ndarray:
    return np.asarray(a, dtype=np.float64).reshape(S, S)


@query(", z AS (SELECT 1) SELECT image_id, idx, CAST(floor(a * 255 + 0.5) AS INTEGER) AS grey FROM px", planes=True)
def png_mask_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Masks as 8-bit grey images, written and read back."""
    back = lambda i, a: [(i, k, int(v)) for k, v in enumerate(C.png_pixels(C.png(C.codes(_plane(a)))).ravel())]
    return _each(G.planes(spark, sf).select("image_id", "a"), back, "image_id long, idx int, grey int")


@query(", z AS (SELECT 1) SELECT image_id, idx, CAST(floor(a * 255 + 0.5) AS INTEGER) AS r, CAST(floor(g * 255 + 0.5) AS INTEGER) AS g, CAST(floor(b * 255 + 0.5) AS INTEGER) AS b, CAST(floor(t * 255 + 0.5) AS INTEGER) AS alpha FROM rgb", planes=True)
def png_cutout_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Colours with a straight alpha as 8-bit RGBA images, read back as 0..1 and as codes again."""

    def back(i, r, g, b, t) -> list[tuple]:
        rgb, alpha = C.canonical(C.png(C.straight_rgba(np.stack([_plane(x) for x in (r, g, b)], 2), _plane(t))), S * S)
        return [(i, k, *map(int, v)) for k, v in enumerate(C.straight_rgba(rgb, alpha).reshape(-1, 4))]

    return _each(G.images(spark, sf).select("image_id", "r", "g", "b", "t"), back, "image_id long, idx int, r int, g int, b int, alpha int")


@query(
    f""", z AS (SELECT 1) SELECT image_id, 8 AS width, 8 AS height, 8 AS depth, CASE image_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 6 END AS colour_type, image_id % 3 > 0 AS has_alpha,
 CAST(CASE image_id % 3 WHEN 0 THEN 1 ELSE count(DISTINCT floor(t * 255 + 0.5)) END AS INTEGER) AS levels, CASE image_id % 5 WHEN 0 THEN 'sRGB' WHEN 1 THEN 'ICC' WHEN 2 THEN '{C.PROFILES[2][1]}' ELSE '{C.UNPROFILED}' END AS profile FROM rgb GROUP BY image_id""",
    planes=True,
)
def png_inspection(spark: SparkSession, sf: str) -> DataFrame:
    """What an image file says of itself, and how many levels its alpha has."""
    extra = {0: (b"gAMA", b"sRGB"), 1: (b"gAMA", b"iCCP"), 2: (b"gAMA",), 3: (), 4: ()}

    def told(i, r, t) -> list[tuple]:
        parts = [_plane(r), _plane(t)]
        raw = C.png(C.codes([parts[0], np.stack(parts, 2), np.stack([parts[0]] * 3 + parts[1:], 2)][i % 3]))
        raw = raw[:33] + b"".join(C._chunk(k, b"\0" * 4) for k in extra[i % 5]) + raw[33:]  # after the header
        depth, kind, profile = C.png_metadata(raw)
        _, alpha = C.canonical(raw)
        return [(i, *C.png_size(raw), depth, kind, kind in (4, 6), len(np.unique(C.codes(alpha))), profile)]

    return _each(G.images(spark, sf).select("image_id", "r", "t"), told, "image_id long, width int, height int, depth int, colour_type int, has_alpha boolean, levels int, profile string")


@query(
    """, s AS (SELECT image_id, round(sum(CAST(CAST(a AS FLOAT) AS DOUBLE)), 4) AS s FROM px GROUP BY image_id)
SELECT image_id, CASE WHEN image_id % 7 = 0 THEN 'miss' WHEN image_id % 7 IN (1, 2) THEN 'damaged' ELSE 'hit' END AS found, CASE WHEN image_id % 7 > 2 THEN 64 END AS n, CASE WHEN image_id % 7 > 2 THEN s END AS total FROM s""",
    planes=True,
)
def cache_records(spark: SparkSession, sf: str) -> DataFrame:
    """Masks as cache records, read back; some have another magic, a flipped bit or a byte too few."""

    def back(i, a) -> list[tuple]:
        raw = C.record(f"{i:064x}", f"{i + 1:064x}", S, S, np.asarray(a, dtype=np.float32))
        start, _ = C.payload_range(raw)
        raw = {0: b"other" + raw, 1: raw[:start] + bytes([raw[start] ^ 1]) + raw[start + 1 :], 2: raw[:-1]}.get(i % 7, raw)
        try:
            got = C.read_record(raw)
        except ValueError:
            return [(i, "damaged", None, None)]
        return [(i, "miss", None, None)] if got is None else [(i, "hit", len(got[4]), round(float(got[4].astype(np.float64).sum()), 4))]

    return _each(G.planes(spark, sf).select("image_id", "a"), back, "image_id long, found string, n int, total double").withColumn("n", F.col("n").cast("int"))


@query(
    """SELECT doc_id, doc_id % 4 <> 1 AND doc_id % 5 <> 2 AND doc_id % 6 <> 3 AS ok, CASE WHEN doc_id % 4 <> 1 AND doc_id % 5 <> 2 AND doc_id % 6 <> 3 THEN 'doc-' || doc_id END AS id,
 CASE WHEN doc_id % 4 <> 1 AND doc_id % 5 <> 2 AND doc_id % 6 <> 3 THEN n_chars / 2.0 END AS reported FROM documents WHERE doc_id % 9 <> 4"""
)
def arena_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Record lines with strict fields: some have a field too many, one too few, or aren't JSON; blank ones don't count."""
    d = F.col("doc_id")
    whole = F.struct(
        F.concat(F.lit("doc-"), d).alias("id"), F.lit("a.png").alias("input"), F.lit("b.png").alias("target"), F.lit("hair").alias("challenge"), F.lit("tune").alias("split"),
        F.when(d % 5 != 2, F.lit("g")).alias("duplicate_group"), (F.col("n_chars") / 2).alias("fractional_alpha_reported"), F.when(d % 4 == 1, F.lit(1)).alias("unknown"),
    )
    line = F.when(d % 9 == 4, "  ").when(d % 6 == 3, F.concat(F.to_json(whole), F.lit("}{"))).otherwise(F.to_json(whole))
    lines = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", line.alias("line"))
    return R.parsed_lines(lines, R.ARENA).select("doc_id", "ok", "id", F.col("fractional_alpha_reported").alias("reported"))


_EDGE = "x IN (0, 7) OR y IN (0, 7) OR EXISTS (SELECT 1 FROM rgb q WHERE q.image_id = p.image_id AND abs(q.x - p.x) + abs(q.y - p.y) = 1 AND q.t < 0.5)"
_DECODE = "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END"


@query(
    f""", pt AS MATERIALIZED (SELECT image_id, x, y FROM rgb p WHERE t >= 0.5 AND ({_EDGE})),
band AS MATERIALIZED (SELECT DISTINCT p.image_id, p.idx, p.a, p.t, (abs({_DECODE.format("p.a")} - {_DECODE.format("p.g")}) + abs({_DECODE.format("p.g")} - {_DECODE.format("p.b")}) + abs({_DECODE.format("p.b")} - {_DECODE.format("p.a")})) / 3 AS colour
 FROM rgb p JOIN pt ON pt.image_id = p.image_id AND greatest(abs(pt.x - p.x), abs(pt.y - p.y)) <= 1)
SELECT image_id, count(*)::INTEGER AS n, round(avg(abs(a - t)), 6) AS mae, round(sqrt(avg((a - t) * (a - t))), 6) AS rmse, round(CASE WHEN sum(greatest(a, t)) = 0 THEN 1.0 ELSE sum(least(a, t)) / sum(greatest(a, t)) END, 6) AS soft_iou,
 round(coalesce(CAST(count(*) FILTER (a >= 0.1 AND t >= 0.1) AS DOUBLE) / nullif(count(*) FILTER (a >= 0.1 OR t >= 0.1), 0), 1.0), 6) AS iou_1, round(coalesce(CAST(count(*) FILTER (a >= 0.9 AND t >= 0.9) AS DOUBLE) / nullif(count(*) FILTER (a >= 0.9 OR t >= 0.9), 0), 1.0), 6) AS iou_9, round(avg(colour), 6) AS colour FROM band GROUP BY image_id""",
    planes=True,
)
def boundary_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of alpha and colour within a pixel of the reference's boundary; images without one have no row."""

    def told(i, r, g, b) -> list[tuple]:
        r, g, b = _plane(r), _plane(g), _plane(b)
        band = A.within(A.boundary(g[None]), 1)[0]
        if not band.any():
            return []
        a, t, (p, q, s) = r[band], g[band], (A.decoded(x[band]) for x in (r, g, b))
        high = np.maximum(a, t).sum()
        cut = lambda k: (((a >= k) & (t >= k)).sum() / n if (n := ((a >= k) | (t >= k)).sum()) else 1.0)
        colour = (np.abs(p - q) + np.abs(q - s) + np.abs(s - p)).mean() / 3
        return [(i, int(band.sum()), np.abs(a - t).mean(), np.sqrt(np.square(a - t).mean()), np.minimum(a, t).sum() / high if high else 1.0, cut(0.1), cut(0.9), colour)]

    names = ("mae", "rmse", "soft_iou", "iou_1", "iou_9", "colour")
    found = _each(G.images(spark, sf).select("image_id", "r", "g", "b"), told, "image_id long, n int, " + ", ".join(f"{c} double" for c in names))
    return found.select("image_id", "n", *[F.round(c, 6).alias(c) for c in names])
