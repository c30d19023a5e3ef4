"""Sequential kernels over one image in a row: components, distances; numpy inside mapInPandas, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators import grid as G
from .base import query


def labelled(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """4-connected components of a mask: labels from 1 in row-major order of their first pixel, and their number."""
    h, w = mask.shape
    out, n = np.zeros((h, w), dtype=np.int32), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if out[y, x]:
            continue
        n += 1
        out[y, x], todo = n, [(y, x)]
        while todo:
            v, u = todo.pop()
            for b, a in ((v - 1, u), (v + 1, u), (v, u - 1), (v, u + 1)):
                if 0 <= b < h and 0 <= a < w and mask[b, a] and not out[b, a]:
                    out[b, a] = n
                    todo.append((b, a))
    return out, n


def topology(a: np.ndarray, threshold: float = 0.5) -> tuple[int, int]:
    """Components of the foreground, and holes: components of the background that don't touch the border."""
    mask = a >= threshold
    back, n = labelled(~mask)
    edge = set(np.unique(np.concatenate([back[0], back[-1], back[:, 0], back[:, -1]]))) - {0}
    return labelled(mask)[1], n - len(edge)


def connectivity_similarity(a: np.ndarray, t: np.ndarray) -> float:
    scores = []
    for k in range(1, 10):
        (c, h), (d, g) = topology(a, k / 10), topology(t, k / 10)
        scores.append(1 / (1 + abs(c - d) + abs(h - g)))
    return float(np.mean(scores))


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Squared distances to the nearest pixel of the mask, by rows and then columns; infinite without one."""
    h, w = mask.shape
    x = np.arange(w)
    rows = np.where(mask[:, None, :], (x[:, None] - x[None, :]) ** 2, np.inf).min(axis=2)
    y = np.arange(h)
    return (rows[None, :, :] + ((y[:, None] - y[None, :]) ** 2)[:, :, None]).min(axis=1)


@query()
def topology_metrics(spark: SparkSession, sf: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for i, a, t in zip(p["image_id"], p["a"], p["t"], strict=True):
                a, t = np.array(a).reshape(8, 8), np.array(t).reshape(8, 8)
                (c, h), (d, g) = topology(a), topology(t)
                rows.append((i, c, h, 1 / (1 + abs(c - d) + abs(h - g)), connectivity_similarity(a, t)))
            yield pd.DataFrame(rows, columns=["image_id", "components", "holes", "bridge", "connectivity"])

    return G.pairs(spark, sf).select("image_id", "a", "t").mapInPandas(run, "image_id long, components int, holes int, bridge double, connectivity double")


@query(
    """, m AS (SELECT image_id, x, y FROM px WHERE a >= 0.5)
SELECT p.image_id, p.idx, CAST(min((p.x - m.x) * (p.x - m.x) + (p.y - m.y) * (p.y - m.y)) AS DOUBLE) AS d FROM px p JOIN m ON m.image_id = p.image_id GROUP BY ALL""",
    planes=True,
)
def distance_to_mask(spark: SparkSession, sf: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = [distance_transform(np.array(a).reshape(8, 8) >= 0.5).ravel() for a in p["a"]]
            if out:
                yield pd.DataFrame({"image_id": np.repeat(p["image_id"].to_numpy(), 64), "idx": np.tile(np.arange(64, dtype=np.int32), len(p)), "d": np.concatenate(out)}).query("d < inf")

    return G.planes(spark, sf).select("image_id", "a").mapInPandas(run, "image_id long, idx int, d double")
