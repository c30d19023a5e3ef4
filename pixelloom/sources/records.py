"""Scans: record lines with strict fields, image files, tensors of 32-bit floats; and files with their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codecs

ARENA = "id string, input string, target string, challenge string, split string, duplicate_group string, fractional_alpha_reported double"
_HASHES = ", ".join(f"{k}_{h} string" for h in ("sha256", "decoded_sha256") for k in ("input", "reference"))
_SIZES = ", ".join(f"{k}{d} bigint" for k in ("", "input_", "reference_") for d in ("width", "height"))
MANIFEST = (
    f"schema_version string, id string, input string, reference string, {_HASHES}, {_SIZES}, input_orientation string, reference_orientation string, input_alpha_present boolean, reference_alpha_present boolean, "
    "reference_png_bit_depth smallint, reference_png_color_type smallint, reference_png_color_metadata string, reference_alpha_levels int, tags array<string>, split string, subject_policy string, shadow_policy string, "
    "prompt string, reference_created_at string, reference_tool string, reference_tool_version string, duplicate_group string, notes string"
)
OPTIONAL = ("reference_png_bit_depth", "reference_png_color_type", "prompt", "reference_created_at", "reference_tool", "reference_tool_version", "notes")


def strict(line: Column, ddl: str, optional: tuple[str, ...] = ()) -> Column:
    """A line's record, null if it isn't JSON, has other fields, or lacks one that isn't optional."""
    names = [f.split()[0] for f in ddl.split(", ")]
    # Read as the one element of a list, so that nothing may follow the record.
    fields = ", ".join(": ".join(f.split(" ", 1)) for f in ddl.split(", "))
    every = F.from_json(F.concat(F.lit("["), line, F.lit("]")), f"array<struct<{fields}>>")
    record, keys = F.when(F.size(every) == 1, F.get(every, 0)), F.json_object_keys(line)
    known = F.size(F.array_except(keys, F.array(*[F.lit(n) for n in names]))) == 0
    whole = F.lit(True)
    for n in names:
        if n not in optional:
            whole = whole & record[n].isNotNull()
    return F.when(F.coalesce(known & whole, F.lit(False)), record)


def parsed_lines(lines: DataFrame, ddl: str, optional: tuple[str, ...] = ()) -> DataFrame:
    """The other columns of lines (a column `line`), ok, and the fields; blank lines are left out."""
    others = [c for c in lines.columns if c != "line"]
    rows = lines.where(F.trim("line") != "").select(*others, strict(F.col("line"), ddl, optional).alias("record"))
    return rows.select(*others, F.col("record").isNotNull().alias("ok"), "record.*")


def read_lines(spark: SparkSession, path: str, ddl: str, optional: tuple[str, ...] = ()) -> DataFrame:
    """The records of a file of lines; a line that isn't one is an error that names the line."""
    rows = parsed_lines(spark.read.text(path).withColumnRenamed("value", "line").withColumn("raw", F.col("line")), ddl, optional)
    checked = F.when(F.col("ok"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("not a record: "), F.substring("raw", 1, 200))))
    return rows.withColumn("id", checked).drop("ok", "raw")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height of PNG files, from their headers."""
    head = F.substring("content", 1, 24)
    number = lambda at: F.conv(F.hex(F.substring(head, at, 4)), 16, 10).cast("bigint")
    files = spark.read.format("binaryFile").load(path)
    return files.where(F.substring("content", 1, 8) == F.lit(codecs.PNG)).select("path", number(17).alias("width"), number(21).alias("height"))


def images(spark: SparkSession, path: str, most_pixels: int | None = None) -> DataFrame:
    """path, width, height, rgb (by pixel, three values each) and alpha of PNG files, as 0..1."""

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for name, raw in zip(p["path"], p["content"], strict=True):
                rgb, alpha = codecs.canonical(bytes(raw), most_pixels)
                rows.append((name, rgb.shape[1], rgb.shape[0], rgb.ravel(), alpha.ravel()))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "rgb", "alpha"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, "path string, width int, height int, rgb array<float>, alpha array<float>")
