"""Named queries over the test tables, each with SQL where SQL can express it."""

from __future__ import annotations

#: The query that the driver runs as a smoke test.
FLAGSHIP = "alpha_metrics"


def _all() -> None:
    from . import agreement, codecs, contracts, data_quality, experiments, generators, kernels, metrics, model_inputs, neighbourhoods, pixels, resampling  # noqa: F401


def queries() -> dict:
    from .base import REGISTER

    _all()
    return dict(REGISTER)


def oracle_sql() -> dict[str, str]:
    from .base import SQL

    _all()
    return dict(SQL)
