"""The register of queries, and the SQL that stands for the test planes."""

from __future__ import annotations

from collections.abc import Callable

REGISTER: dict[str, Callable] = {}
SQL: dict[str, str] = {}

PX = """px AS MATERIALIZED (SELECT vec_id AS image_id, label AS tag, idx, idx % 8 AS x, idx // 8 AS y, CASE WHEN mx = mn THEN 0.0 ELSE (v - mn) / (mx - mn) END AS a
  FROM (SELECT vec_id, label, CAST(list_min(embedding) AS DOUBLE) AS mn, CAST(list_max(embedding) AS DOUBLE) AS mx, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(unnest(range(0, 64)) AS INTEGER) AS idx FROM embeddings)),
n AS MATERIALIZED (SELECT max(vec_id) + 1 AS n FROM embeddings),
pn AS MATERIALIZED (SELECT px.*, (image_id + 1) % n.n AS n1, (image_id + 2) % n.n AS n2 FROM px, n),
rgb AS MATERIALIZED (SELECT p.image_id, p.tag, p.idx, p.x, p.y, p.a, q.a AS g, s.a AS b, q.a AS t FROM pn p JOIN px q ON q.image_id = p.n1 AND q.idx = p.idx JOIN px s ON s.image_id = p.n2 AND s.idx = p.idx)"""


def query(sql: str | None = None, planes: bool = False):
    """Register a function as a query. planes: the SQL is a body after the tables px, n and rgb; it may add tables."""

    def add(f: Callable) -> Callable:
        REGISTER[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {PX}{sql}" if planes else sql
        return f

    return add
