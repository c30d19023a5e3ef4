"""String, hash and date-shape functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_hex(v: Column) -> Column:
    return F.sha2(v.cast("binary"), 256)


def is_sha256_hex(v: Column) -> Column:
    return F.coalesce(v.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def is_iso_date_shape(v: Column) -> Column:
    """YYYY-MM-DD with month 1..12 and day 1..31, then nothing, or T and at least one byte; 2024-02-31 has the shape."""
    return F.coalesce(v.rlike(r"\A[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])(T(?s:.+))?\z"), F.lit(False))


def cache_key(input_hash: Column, manifest_hash: Column) -> Column:
    """sha256 of both with a zero byte between."""
    return F.sha2(F.concat(input_hash.cast("binary"), F.unhex(F.lit("00")), manifest_hash.cast("binary")), 256)


def escape_html(v: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


def pipeline_part(v: Column, part: int, default: str) -> Column:
    """Part (from 1) of an id a+b+c+d; the default where it is missing."""
    return F.coalesce(F.try_element_at(F.split(v, r"\+"), F.lit(part)), F.lit(default))


def contained_path(v: Column) -> Column:
    """A relative path that doesn't leave its folder."""
    return ~(v.startswith("/") | F.array_contains(F.split(v, "/"), "..") | (v == ""))
