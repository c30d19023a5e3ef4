"""Token ids in directly addressable codes.

A segment holds the ids of whole documents that follow each other in ascending doc_id order. Ids are split into
chunks of 8 bits. Level k has the k-th chunk of every id that is long enough, one byte each, and a bitmap that says
which of them go on at level k + 1; a rank directory counts the bitmap's ones before each 512 bits. The chunk of an id
at the next level stands at the rank of its bit, so any token is read with one rank for each level; no block is decoded.

Files: segments are rows of Parquet in the shared folder (Spark's commit protocol makes them whole; lost tasks run
again), with the documents' ids and lengths beside the codes. A segment closes at SEGMENT tokens, at a document's end.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import pick, small_batches
from .tokens import encoder

MAGIC = b"DAC1"
#: Bits for each entry of a rank directory.
RANK_BITS = 512
#: Tokens from which a segment closes.
SEGMENT = 1 << 18


class Codes:
    """A segment's codes, read in place."""

    def __init__(self, raw: bytes) -> None:
        magic, self.n, n_levels = struct.unpack_from("<4sQB", raw)
        if magic != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.levels, at, n = [], 13, self.n
        for k in range(n_levels):
            chunks = np.frombuffer(raw, np.uint8, n, at)
            at += n
            if k == n_levels - 1:
                self.levels.append((chunks, None, None))
                break
            bitmap = np.frombuffer(raw, np.uint8, -(-n // 8), at)
            at += len(bitmap)
            ranks = np.frombuffer(raw, "<u4", n // RANK_BITS + 1, at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bitmap, ranks))
            (n,) = struct.unpack_from("<I", raw, at)
            at += 4

    @staticmethod
    def write(ids: np.ndarray) -> bytes:
        rest, out, levels = ids.astype(np.uint32), [], 0
        while True:
            levels += 1
            out.append((rest & 255).astype(np.uint8).tobytes())
            more = rest > 255
            if not more.any():
                break
            ones = np.concatenate([[0], np.cumsum(more)])[: len(rest) + 1 : RANK_BITS]
            rest = rest[more] >> 8
            out += [np.packbits(more, bitorder="little").tobytes(), ones[: len(more) // RANK_BITS + 1].astype("<u4").tobytes(), struct.pack("<I", len(rest))]
        return struct.pack("<4sQB", MAGIC, len(ids), levels) + b"".join(out)

    @staticmethod
    def rank(bitmap: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before bit i."""
        block = i // RANK_BITS
        bits = np.unpackbits(bitmap[block * RANK_BITS // 8 : -(-i // 8)], bitorder="little")
        return int(ranks[block]) + int(bits[: i - block * RANK_BITS].sum())

    def token(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i = self.rank(bitmap, ranks, i)
        return value

    def slice(self, start: int, end: int, level: int = 0) -> np.ndarray:
        """The ids at places start to end, without those before."""
        chunks, bitmap, ranks = self.levels[level]
        out = chunks[start:end].astype(np.uint32)
        if bitmap is not None and end > start:
            first = start & ~7
            more = np.unpackbits(bitmap[first >> 3 : -(-end // 8)], bitorder="little")[start - first : end - first].astype(bool)
            if n := int(more.sum()):
                at = self.rank(bitmap, ranks, start)
                out[more] |= self.slice(at, at + n, level + 1) << 8
        return out


SEGMENTS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("codes", T.BinaryType()),
])
_ARROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("codes", pa.binary())])


def write_token_codes(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end_id: int | None = 1) -> None:
    """Encode the whole text of every document and write the codes to path, in ascending doc_id order.

    Null and empty texts have no ids but end_id. Null doc_ids come first; equal ones stand in their texts' order, null
    first, and repeated rows are all written. An empty table makes files without rows. Other columns don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        ids, doc_ids, lengths, segment, before, held = [], [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            return pa.RecordBatch.from_pydict({"part": [part], "segment": [segment], "before": [before], "n_tokens": [len(flat)], "doc_ids": [doc_ids], "lengths": [lengths], "codes": [Codes.write(flat)]}, schema=_ARROW)

        for batch in batches:
            names = iter(batch.column("doc_id").to_pylist())
            for some, counts in enc.column(batch.column("text")):
                if end_id is not None:
                    some, counts = np.insert(some, np.cumsum(counts), end_id), counts + 1
                at = 0
                for doc_id, n in zip(islice(names, len(counts)), counts.tolist(), strict=True):
                    ids.append(some[at : at + n])
                    doc_ids.append(doc_id)
                    lengths.append(n)
                    at, held = at + n, held + n
                    if held >= SEGMENT:
                        yield closed()
                        segment, before = segment + 1, before + held
                        ids, doc_ids, lengths, held = [], [], [], 0
        if doc_ids:
            yield closed()

    ordered = pick(docs, "doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, SEGMENTS).write.option("compression", "zstd").parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with `start`, the number of all ids before each."""
    rows = spark.read.schema(SEGMENTS).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # One row of two numbers for each writing task: bounded by the number of partitions, so it is broadcast.
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("before"))


def map_documents(spark: SparkSession, path: str, row: Callable[[int | None, int, np.ndarray], tuple], schema: pa.Schema, ddl: str) -> DataFrame:
    """row(doc_id, start, ids) of every document of the files, one segment after the other."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, doc_ids, lengths, raw = (batch.column(c)[i].as_py() for c in ("start", "doc_ids", "lengths", "codes"))
                codes, at, out = Codes(raw), 0, []
                for doc_id, n in zip(doc_ids, lengths, strict=True):
                    out.append(row(doc_id, start + at, codes.slice(at, at + n)))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return segments(spark, path).select("start", "doc_ids", "lengths", "codes").mapInArrow(decode, ddl)


def read_token_codes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array) of every document, from the files."""
    return map_documents(spark, path, lambda d, s, ids: (d, s, ids.tolist()), pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))]), "doc_id bigint, start bigint, ids array<bigint>")


def tokens_at(positions: DataFrame, path: str) -> DataFrame:
    """position, id: random access to the ids at the places that the column `position` names; null beyond the ends.

    Segments are found by range keys: each stands under the multiples of SEGMENT that it covers. A segment's codes are
    read once for all its places. Null places give null; repeated ones come out as often. Without rows there are none.
    """
    spark = positions.sparkSession
    small_batches(spark)
    own, wanted = segments(spark, path), positions.select(F.col("position").cast("bigint"))
    covers = F.sequence(F.floor(F.col("start") / SEGMENT), F.floor((F.col("start") + F.col("n_tokens") - 1) / SEGMENT))
    keyed = own.where("n_tokens > 0").select("part", "segment", "start", F.col("n_tokens").alias("n"), F.explode(covers).alias("key"))
    asked = wanted.where("position >= 0").distinct().withColumn("key", F.floor(F.col("position") / SEGMENT))
    met = asked.join(keyed, "key").where((F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n")))
    # Different places of one segment: no more than it has tokens.
    grouped = met.groupBy("part", "segment").agg(F.first("start").alias("start"), F.collect_list("position").alias("positions"))
    schema = pa.schema([("position", pa.int64()), ("id", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, places, raw = (batch.column(c)[i].as_py() for c in ("start", "positions", "codes"))
                codes = Codes(raw)
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([codes.token(p - start) for p in places], pa.int64())], schema=schema)

    codes = spark.read.schema(SEGMENTS).parquet(path).select("part", "segment", "codes")
    got = grouped.join(codes, ["part", "segment"]).select("start", "positions", "codes").mapInArrow(read, "position bigint, id bigint")
    return wanted.join(got, "position", "left")
