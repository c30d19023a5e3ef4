"""What the operators share: column selection, the shared folder, hashing and cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as all the contracts mean it: \x20 and \x09-\x0D.
SPACE = r"\x20\x09-\x0D"

#: Bits of a bitmap of numbers: 8 MB, whatever the corpus.
BITMAP = 1 << 26

DOCUMENT_TYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of these exact names, cast to the types of `documents`; a missing one is null.

    Other columns, whatever their names, go: also those that differ from a wanted one in case alone.
    Of two columns with the very same name, the first counts.
    """
    at = {n: i for i, n in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[(F.col(f"c{at[n]}") if n in at else F.lit(None)).cast(DOCUMENT_TYPES[n]).alias(n) for n in names])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, as in tests, a new one.

    A new one lies on this machine, so it is made only for a local master; a cluster must name a shared folder.
    """
    conf = spark.sparkContext.getConf()
    if named := conf.get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = os.environ.get("PIXELLOOM_SHARED_DIR") or tempfile.mkdtemp(prefix="pixelloom-")
    os.environ["PIXELLOOM_SHARED_DIR"] = made
    return f"file://{made}"


#: Folders that this process has made in the shared folder.
_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def remove_saved(spark: SparkSession) -> None:
    """Delete what this process has written to the shared folder so far: only when no result over it is read any more."""
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and lost executors don't matter."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bitmap(numbers: DataFrame, name: str) -> Broadcast:
    """The lowest bits of the numbers in a column, as a bitmap that all tasks can read."""
    place = F.col(name).bitwiseAND(F.lit(BITMAP - 1))
    words = numbers.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({name} & 63 as int))")).alias("b"))
    bits = np.zeros(BITMAP // 64, dtype="<i8")
    for part in words.toArrow().to_batches():  # 2 ** 20 rows at most
        bits[part.column("w").to_numpy()] = part.column("b").to_numpy()
    return numbers.sparkSession.sparkContext.broadcast(np.flatnonzero(bits).astype("<i4").tobytes() + bits[bits != 0].tobytes())


def bits_of(sent: bytes) -> np.ndarray:
    n = len(sent) // 12
    bits = np.zeros(BITMAP // 64, dtype="<i8")
    bits[np.frombuffer(sent, "<i4", n)] = np.frombuffer(sent, "<i8", n, 4 * n)
    return bits


def in_bitmap(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """False for numbers that the column didn't have; true for all that it had, and some others."""
    at = numbers & (BITMAP - 1)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def id_crc32(doc_id: Column) -> Column:
    """crc32 of doc_id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def crc32_of(ids) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def as_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def batches_of(items: Iterable, n: int):
    batch = []
    for x in items:
        batch.append(x)
        if len(batch) == n:
            yield batch
            batch = []
    if batch:
        yield batch


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Arrow batches of so many rows and bytes at most, since single texts can be long; lower settings stay.

    Plans read these settings when they run, so they stay set in the session.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
